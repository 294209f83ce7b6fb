"""Operator 3: token ids in files, frequency-ranked and byte-aligned.

Ids are replaced by their rank by corpus frequency (rank 0: the commonest; ties:
the smaller id), so that common tokens take one byte.  A document's block keeps
two streams apart: control bytes, each holding the sizes less one of four values
in two bits each (the first value in the lowest bits), and data bytes, the
values' low 1-4 bytes, little end first.  Blocks lie in Parquet files in
ascending doc_id order, beside a table of ranks and one of the totals of each file.
Parquet is the container because any store Spark writes to can hold it, and its
commit survives a lost executor.

Decoding looks each control byte up in two numpy tables (four sizes, their sum).

Defined cases: a null text counts as empty and holds only the end id; equal
doc_ids follow each other in the order of their lengths and bytes; rows without
a doc_id come first; an empty table gives empty files.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.llm.common import Ragged, discard, remembered, runs_of, store, words
from millwright.session import ensure_checkpoint_dir

SIZES = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)], np.int64)


def encode_rows(values: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes, where each row's begin and the last row's end, and the same of the data bytes.

    ``values``: unsigned 32-bit values of all rows one after another; ``n``: how many each row has.
    """
    v = np.ascontiguousarray(values, "<u4")
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    quads = -(-n // 4)
    padded = np.zeros(4 * int(quads.sum()), np.uint8)
    before = np.cumsum(4 * quads - n) - (4 * quads - n)  # unused places of the rows before
    padded[np.arange(len(v)) + np.repeat(before, n)] = size - 1
    control = padded[0::4] | padded[1::4] << 2 | padded[2::4] << 4 | padded[3::4] << 6
    ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    data = np.empty(ends[-1], np.uint8)
    data[ends[:-1]] = v.astype(np.uint8)
    for i in (1, 2, 3):
        at = np.flatnonzero(size > i)
        data[ends[at] + i] = (v[at] >> np.uint32(8 * i)).astype(np.uint8)
    return control, _cuts(quads), data, ends[_cuts(n)]


def decode_rows(control: np.ndarray, data: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The values of all rows one after another, from their control and data bytes, which follow each other."""
    quads = -(-n // 4)
    used, ends = np.ones(4 * len(control), bool), np.cumsum(4 * quads)
    for i in (1, 2, 3):
        used[(ends - i)[4 * quads - n >= i]] = False
    size = SIZES[control].ravel()[used]
    start = np.cumsum(size) - size
    raw = np.concatenate([data, np.zeros(4, np.uint8)])
    out = raw[start].astype(np.uint32)
    for i in (1, 2, 3):
        at = np.flatnonzero(size > i)
        out[at] |= raw[start[at] + i].astype(np.uint32) << np.uint32(8 * i)
    return out


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    control, _, data, _ = encode_rows(values, np.array([len(values)]))
    return control.tobytes(), data.tobytes()


def decode_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    return decode_rows(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), np.array([n]))


def _cuts(n: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(n)])


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column's rows one after another, and how many each row has; no row is null."""
    if not len(column):
        return np.empty(0, np.uint8), np.empty(0, np.int64)
    column = column.cast(pa.large_binary())
    _, ends, held = column.buffers()
    ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(held, np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.empty(0, np.uint8)), np.diff(ends)


def column_of(held: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """A binary column of rows that end where ``cuts`` says."""
    rows = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(held))]
    )
    return rows.cast(pa.binary())


def parts_of(batches, rows: int = 512):
    """The batches in slices of some rows, as their temporary arrays are several times as large."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


#: How the tokenizer cuts lower-cased words of printable ASCII and Latin-1 letters (no "<", which
#: could begin a special token): the fixed pattern of its pre-tokenizer over these characters.
#: ``OTHER`` finds runs of what such words do not hold.
OTHER = re.compile("[^!-;=-~ß-öø-ÿ\n]+")
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\\n]+|\\n")
#: Byte-level alphabet: bytes without a printable Latin-1 character take the code points from 256 on.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
ALPHABET = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _SHOWN)}
SHOWN = np.array([ALPHABET.get(b, b) if b != 10 else b for b in range(256)], "<u4")


class WordEncoder:
    """Asks the library for each new word once.

    Plain words are cut as the tokenizer does, all that are new at once, and its
    BPE model asked for each new piece; every other word goes through the whole tokenizer.
    """

    def __init__(self, tok, limit: int = 900_000):
        self.tok, self.model = tok, tok.model
        self.pieces = Ragged(self.models, 300_000)
        self.words = Ragged(self.many, limit)

    def models(self, pieces: list[str]) -> list[list[int]]:
        """What the BPE model makes of pieces in its alphabet; a line feed stands between words and has no ids."""
        shown = "\n".join("" if p == "\n" else p for p in pieces)
        if not shown.isascii():
            shown = SHOWN[np.frombuffer(shown.encode(), np.uint8)].tobytes().decode("utf-32-le")
        return [[t.id for t in self.model.tokenize(p)] if p else [] for p in shown.split("\n")]

    def many(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks one after another, and how many each has; chunks hold no line feed."""
        whole = b"\n".join(chunks).decode()
        lower = whole if whole.isascii() else whole.lower()  # a line feed ends a word for the final sigma too
        cut = lower.split("\n")
        ends = np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)) + 1)
        odd = np.fromiter((m.start() for m in OTHER.finditer(lower)), np.int64)
        rest = np.unique(np.searchsorted(ends, odd, side="right")).tolist()
        if rest:
            for i in rest:
                cut[i] = ""
            lower = "\n".join(cut)
        found = PIECES.findall(lower + "\n")
        flat, sizes = self.pieces.together(found)
        ends = np.flatnonzero(np.fromiter(map("\n".__eq__, found), bool, len(found)))
        lens = np.diff(np.cumsum(sizes)[ends], prepend=0)
        if rest:
            others = [e.ids for e in self.tok.encode_batch_fast([chunks[i].decode() for i in rest], add_special_tokens=False)]
            parts = np.split(flat, np.cumsum(lens)[rest])  # a chunk of the rest has no ids yet
            flat = np.concatenate([x for p, o in zip(parts, [*others, []]) for x in (p, np.array(o, np.uint32))])
            lens[rest] = [len(o) for o in others]
        return flat, lens


def word_encoder(path: str) -> Ragged:
    """Encodes runs of bytes between ASCII blanks, each on its own.

    Only for tokenizers that lower-case, drop white space and never look across it,
    as those of vocabularies with word ends ("</w>").
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return remembered(path, lambda: WordEncoder(Tokenizer.from_file(path)).words)


def chunks(text: str | None) -> list[bytes]:
    """``words``, but what could hold a special token keeps its case, in which the tokenizer looks for those."""
    if not text or "<|" not in text:
        return words(text)
    return [w if b"<|" in w else w.lower() for w in text.encode().split()]


def tokenize(docs: DataFrame, path: str, end_id: int, rows: int = 256) -> DataFrame:
    """doc_id, and the ids with the end id as little-endian 32-bit integers."""

    def run(batches):
        enc = word_encoder(path)
        tail = np.array([end_id], np.uint32)
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                ids = [
                    np.concatenate([x, tail]).astype("<u4").tobytes()
                    for run in runs_of(part["text"].to_pylist())
                    for x in enc.batch([chunks(t) for t in run])
                ]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary")


def id_counts(tokens: DataFrame, vocab: int) -> DataFrame:
    """id, n: how often each id occurs; each task sends one row for each id at most."""

    def run(batches):
        total = np.zeros(vocab, np.int64)
        for part in parts_of(batches):
            total += np.bincount(bytes_of(part["ids"])[0].view("<u4"), minlength=vocab)[:vocab]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    return tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_files(tokens: DataFrame, folder: str, vocab: int, files: int) -> None:
    """Write ``blocks``, ``ranks`` and ``totals`` under ``folder``; a stored ``tokens`` is deleted once coded.

    What goes through the driver is the vocabulary's counts, at most ``vocab`` rows.
    """
    spark = tokens.sparkSession
    counts = sorted((-r["n"], r["id"]) for r in id_counts(tokens, vocab).collect())
    by_rank = np.array([i for _, i in counts], np.uint32)
    spark.createDataFrame([(r, int(i)) for r, i in enumerate(by_rank)], "rank int, id int").coalesce(1).write.parquet(
        f"{folder}/ranks"
    )
    rank_of = np.zeros(vocab, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank_of)

    def code(batches):
        rank = shared.value
        for part in parts_of(batches):
            ids, n = bytes_of(part["ids"])
            control, control_cuts, data, data_cuts = encode_rows(rank[ids.view("<u4")], n // 4)
            yield pa.RecordBatch.from_arrays(
                [
                    part["doc_id"],
                    pa.array(n // 4, pa.int64()),
                    column_of(control, control_cuts),
                    column_of(data, data_cuts),
                ],
                names=["doc_id", "n_tokens", "control", "data"],
            )

    def number(batches):
        file, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch["n_tokens"].to_numpy()
            local = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), file, np.int32)), pa.array(local), *batch.columns],
                names=["file", "local_start", *batch.schema.names],
            )

    # stored, as a range partitioner reads its input twice
    coded = store(
        tokens.mapInArrow(code, "doc_id long, n_tokens long, control binary, data binary"), "token-blocks"
    )
    discard(tokens)
    (
        coded.repartitionByRange(files, "doc_id")
        .sortWithinPartitions("doc_id", "n_tokens", "data")
        .mapInArrow(number, "file int, local_start long, doc_id long, n_tokens long, control binary, data binary")
        .write.option("compression", "zstd")
        .parquet(f"{folder}/blocks")
    )
    discard(coded)
    (
        spark.read.parquet(f"{folder}/blocks")
        .groupBy("file")
        .agg(F.sum("n_tokens").alias("n"))
        .coalesce(1)
        .write.parquet(f"{folder}/totals")
    )


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (tokens of all documents before it), n_tokens, ids (32-bit little-endian).

    The files' offsets go to the tasks as a list of one number for each file.
    """
    before, offset = {}, 0
    for r in sorted(spark.read.parquet(f"{folder}/totals").collect()):
        before[r["file"]], offset = offset, offset + r["n"]
    by_rank = np.array(
        [r["id"] for r in sorted(spark.read.parquet(f"{folder}/ranks").collect())], np.uint32
    )  # at most the vocabulary
    shared = spark.sparkContext.broadcast((before, by_rank))

    def run(batches):
        offsets, ids = shared.value
        for b in parts_of(batches):
            n = b["n_tokens"].to_numpy()
            back = ids[decode_rows(bytes_of(b["control"])[0], bytes_of(b["data"])[0], n)].astype("<u4")
            start = [offsets[f] + s for f, s in zip(b["file"].to_pylist(), b["local_start"].to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array(start, pa.int64()), b["n_tokens"], column_of(back.view(np.uint8), _cuts(4 * n))],
                names=["doc_id", "start", "n_tokens", "ids"],
            )

    return spark.read.parquet(f"{folder}/blocks").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids binary"
    )


def op3_token_files(docs: DataFrame, path: str, vocab: int, end_id: int = 1, folder: str | None = None) -> DataFrame:
    """Encode, write, read back; the contract's columns of what was read.

    ``path``: a tokenizers file; ``vocab``: its size; ``folder``: where to write.
    """
    spark = docs.sparkSession
    folder = folder or f"{ensure_checkpoint_dir(spark)}/llm-tokens-{uuid.uuid4().hex}"
    tokens = store(tokenize(docs, path, end_id), "token-ids")
    files = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    write_files(tokens, folder, vocab, files)
    return read_files(spark, folder).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").cast("long").alias("ids_crc32")
    )
