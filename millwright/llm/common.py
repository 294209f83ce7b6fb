"""Helpers shared by the operators of this subpackage.

Every operator takes the two or three columns it needs by name and ignores the
rest, so extra input columns never clash with what it adds.  A null text counts
as empty.  Words are runs of bytes other than space and 0x09-0x0D of the UTF-8
text with A-Z lower-cased: ``bytes.lower`` and ``bytes.split`` mean exactly that.
"""

from __future__ import annotations

import gc
import os
import uuid
from array import array
from contextlib import contextmanager
from functools import cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.session import ensure_checkpoint_dir

MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table to work on; from now on Python workers look for this package where the driver found it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark's setting that removes an execution's shuffle files at its end.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def released(spark: SparkSession):
    """What is run inside leaves no shuffle files: they would stay until the driver's collector finds them unused."""
    was = spark.conf.get(RELEASE, None)
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(RELEASE)
        else:
            spark.conf.set(RELEASE, was)


def store(df: DataFrame, name: str, compression: str = "zstd", partition_by: str | None = None) -> DataFrame:
    """Write ``df`` into the shared checkpoint folder and read it back.

    This cuts the lineage: what follows reads files that every executor sees,
    so a lost executor costs its running tasks only; the shuffles on the way to the
    files are released with them.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    with released(spark):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the files of stored tables that no later step reads."""
    for df in frames:
        spark = df.sparkSession
        folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for folder in folders:
            if "/llm-" in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(name: str, columns: list[str]) -> str:
    """``name``, or the first longer form of it that is no column yet (whatever the case of letters)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_crc(col: str = "doc_id") -> Column:
    """Unsigned crc32 of the id written as text; null for a null id."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def held_out(folds: int, col: str = "doc_id") -> Column:
    """True where crc32(id) mod folds is 0; a row without an id is never learned from."""
    return F.coalesce(id_crc(col) % folds == 0, F.lit(True))


def words(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


class Ragged:
    """chunk of text -> its token ids, remembered between documents.

    ``encode_many(chunks)`` gives the ids of chunks not seen yet: a list of each, or all
    in one array and how many each has.  The memory is
    bounded: past ``limit`` chunks or ``4 * limit`` ids everything is forgotten.
    """

    def __init__(self, encode_many, limit: int = 300_000):
        self.encode_many, self.limit = encode_many, limit
        self.clear()

    def clear(self) -> None:
        self.index: dict = {}
        self.flat, self.starts, self.lens = array("I"), array("q"), array("q")

    def _add(self, new: list) -> dict:
        """Encode ``new`` and say where each of it is."""
        got, first = self.encode_many(new), len(self.lens)
        if not isinstance(got, tuple):
            got = np.fromiter(chain.from_iterable(got), np.uint32), np.fromiter(map(len, got), np.int64, len(got))
        flat, lens = got
        self.starts.frombytes((len(self.flat) + np.cumsum(lens) - lens).astype(np.int64).tobytes())
        self.lens.frombytes(lens.astype(np.int64).tobytes())
        self.flat.frombytes(flat.astype(np.uint32).tobytes())
        return dict(zip(new, range(first, first + len(new))))

    def known(self, chunk) -> list[int] | None:
        if (i := self.index.get(chunk)) is None:
            return None
        return self.flat[self.starts[i] : self.starts[i] + self.lens[i]].tolist()

    def ids(self, chunks: list) -> np.ndarray:
        """The ids of all chunks in order, as one uint32 array."""
        return self.batch([chunks])[0]

    def batch(self, groups: list[list]) -> list[np.ndarray]:
        """``ids`` of each list of chunks; the lists are looked up together."""
        flat, lens = self.together([c for g in groups for c in g])
        cuts = np.concatenate([[0], np.cumsum(lens)])[np.cumsum([0, *map(len, groups)])].tolist()
        return [flat[a:b] for a, b in zip(cuts, cuts[1:])]

    def together(self, chunks: list) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks in order, and how many each chunk has."""
        if not chunks:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        if len(self.index) > self.limit or len(self.flat) > 8 * self.limit:
            self.clear()
        at = np.fromiter(map(self.index.get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = list(dict.fromkeys(chunks[i] for i in missing.tolist()))
            own = self._add(new)
            self.index.update(own if max(map(len, new)) <= 64 else {c: i for c, i in own.items() if len(c) <= 64})
            at[missing] = [own[chunks[i]] for i in missing.tolist()]
        starts, lens = np.frombuffer(self.starts, np.int64)[at], np.frombuffer(self.lens, np.int64)[at]
        ends = np.cumsum(lens)
        where = np.repeat(starts - (ends - lens), lens) + np.arange(ends[-1])
        return np.frombuffer(self.flat, np.uint32)[where] if len(where) else np.empty(0, np.uint32), lens


def runs_of(texts: list[str | None], chars: int = 1 << 19):
    """The texts in runs of some ``chars`` characters; a longer text is a run of its own."""
    run, size = [], 0
    for t in texts:
        run.append(t or "")
        size += len(run[-1])
        if size >= chars:
            yield run
            run, size = [], 0
    if run:
        yield run


def texts_of(batch: pa.RecordBatch, rows: int = 512):
    """The texts of a batch one after another; some rows at a time are Python strings."""
    for lo in range(0, batch.num_rows, rows):
        yield from batch["text"].slice(lo, rows).to_pylist()


def rarer_gc() -> None:
    """Large tables of remembered ids hold no cycles; let the collector walk them less often."""
    gc.freeze()
    gc.set_threshold(200_000, 20, 100)


_REMEMBERED: dict = {}


def remembered(key, make):
    """What ``make`` builds, kept by the Python worker for its next tasks with this ``key``.

    Workers outlive their stage, and each holds the tables of one key at a time.
    """
    if key not in _REMEMBERED:
        forget()
        _REMEMBERED[key] = make()
        rarer_gc()
    return _REMEMBERED[key]


def forget() -> None:
    """Give back what an earlier stage's tasks left in this worker; the first thing a task does that needs none of it."""
    if _REMEMBERED:
        _REMEMBERED.clear()
        gc.unfreeze()
        gc.collect()
        pa.default_memory_pool().release_unused()


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


@cache
def _segment_powers(base: int) -> np.ndarray:
    """Those of a whole segment, 8 MB: one copy for all operators of a process, built when first needed."""
    return _powers(base, RunHash.SEGMENT)


class RunHash:
    """64-bit hashes of all runs of word bytes of a text, without a loop over them.

    With prefix sums P of byte * B**place (mod 2**64), a run's hash is (P[end] - P[start]) *
    B**-start.  Word bytes: ASCII letters and digits, and all bytes over 127; with ``marks``
    all but space and 0x09-0x0D.
    """

    SEGMENT = 1 << 20
    BASE = 0x9E3779B97F4A7C15

    def __init__(self, marks: bool = False):
        blank = b" \t\n\x0b\x0c\r"
        self.inside = np.array([c not in blank if marks else c > 127 or chr(c).isalnum() for c in range(256)])

    def of(self, text: str | None, *cuts: int) -> np.ndarray:
        """The hashes; with ``cuts`` a row for the whole runs and for each cut those of their first bytes."""
        raw = text.encode().lower() if text else b""
        if len(raw) <= self.SEGMENT:
            return self._segment(raw, cuts)
        out, at = [], 0
        while at < len(raw):
            end = self._cut(raw, at)
            out.append(self._segment(raw[at:end], cuts))
            at = end
        return np.concatenate(out, axis=-1)

    def _cut(self, raw: bytes, at: int) -> int:
        """Where the segment from ``at`` ends: after its last byte outside a run; it grows to the next one if it has none."""
        if at + self.SEGMENT >= len(raw):
            return len(raw)
        gaps = np.flatnonzero(~self.inside[np.frombuffer(raw, np.uint8, self.SEGMENT, at)])
        if len(gaps):
            return at + int(gaps[-1]) + 1
        for lo in range(at + self.SEGMENT, len(raw), self.SEGMENT):
            gaps = np.flatnonzero(~self.inside[np.frombuffer(raw[lo : lo + self.SEGMENT], np.uint8)])
            if len(gaps):
                return lo + int(gaps[0]) + 1
        return len(raw)

    def _segment(self, raw: bytes, cuts: tuple[int, ...]) -> np.ndarray:
        if not raw:
            return np.empty((1 + len(cuts), 0) if cuts else 0, np.uint64)
        b = np.frombuffer(raw, np.uint8)
        inside = np.zeros(len(b) + 2, np.int8)
        inside[1:-1] = self.inside[b]
        edges = np.flatnonzero(np.diff(inside))
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(len(b) + 1, np.uint64)
        powers = _segment_powers if len(b) <= self.SEGMENT else lambda base: _powers(base, len(b))
        up, down = powers(self.BASE), powers(pow(self.BASE, -1, 2**64))
        np.cumsum(b * up[: len(b)], out=sums[1:])
        back = down[starts]
        cut = [ends, *(np.minimum(ends, starts + c) for c in cuts)]
        rows = [self._hash(sums, back, starts, e) for e in cut]
        return np.stack(rows) if cuts else rows[0]

    def _hash(self, sums: np.ndarray, back: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (sums[ends] - sums[starts]) * back + (ends - starts).astype(np.uint64) * MIX
        h = (h ^ (h >> np.uint64(32))) * MIX2
        return h ^ (h >> np.uint64(29))
