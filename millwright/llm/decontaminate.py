"""Operator 6: benchmark decontamination by CGK embedding and bit-sampling LSH.

An item and a window of a document, both sequences of words, are close if few word edits
turn one into the other.  The CGK random walk maps edit distance to Hamming distance: at
each step it puts out the current word and a random function of step and word says
whether to go on to the next word, so that two walks that differ by an edit fall into
step again.  ``WALKS`` independent walks are taken from each window start; ``SAMPLES``
times a few steps of a walk are sampled and the words put out there hashed to a key.  A
window and an item that share a key are a candidate pair, confirmed by the exact edit
distance between the item and the best piece of text around the window.

Windows are as long as the items: for an item of m words only the steps that a walk takes
within m words are sampled, and sampling is repeated for each class of item sizes.

Only windows that can hold an item are walked: by the pigeonhole principle an item of m
words with d edits keeps an unbroken run of at least ceil((m - d) / (d + 1)) words, so a
window without any run of that many words of an item is further away.  This leaves out no
pair within the distance; which windows and items are compared is decided by the keys.

An item leaks into a document if at most ``share`` of its words need edits, so that the shortest
items must be there word for word.
Words are runs of ASCII letters and digits and of all other characters past ASCII; A-Z count as a-z.

Defined cases: null and empty texts and items have no words and never match; repeated
items and documents each give their rows; items and documents without an id take no
part; an empty table of either kind gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import MIX, MIX2, RunHash, forget, store, texts_of

WALKS, SAMPLES, PICK = 6, 6, 3
STEPS = 2.0  # steps of a walk for each word of an item that are sampled from, at most
_HASH = RunHash()


def word_hashes(text: str | None) -> np.ndarray:
    return _HASH.of(text)


def allowed(m: int, share: float) -> int:
    return int(m * share)


def run_length(m: int, share: float) -> int:
    d = allowed(m, share)
    return max(1, -(-(m - d) // (d + 1)))


def runs(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of the run of ``size`` words at each place."""
    n = len(h) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    for i in range(1, size):
        out = (out ^ (out >> np.uint64(31))) * MIX + h[i : i + n]
    return (out ^ (out >> np.uint64(29))) * MIX2


def walk(h: np.ndarray, starts: np.ndarray, steps: int, turn: int) -> np.ndarray:
    """The words put out by the walks from ``starts``: one row for each step."""
    padded = np.append(h, np.uint64(0))
    at = starts.copy()
    out = np.empty((steps, len(starts)), np.uint64)
    for j in range(steps):
        word = padded[np.minimum(at, len(h))]
        out[j] = word
        at += (((word ^ np.uint64(j * 1_000_003 + turn * 7919 + 1)) * MIX) >> np.uint64(63)).astype(np.int64)
    return out


class Items:
    """Benchmark items with their keys; ``sizes`` are the classes of item sizes, each a quarter over the last."""

    def __init__(self, ids: list, texts: list, share: float):
        self.share = share
        told = [(i, word_hashes(t)) for i, t in zip(ids, texts)]
        told = [(i, h) for i, h in told if i is not None and len(h)]
        self.ids, self.words = [i for i, _ in told], [h for _, h in told]
        lens = np.array([len(h) for h in self.words], np.int64)
        self.cls = np.floor(np.log(np.maximum(lens, 1)) / np.log(1.25)).astype(np.int64)
        self.steps = {c: max(PICK, int(STEPS * lens[self.cls == c].min())) for c in set(self.cls.tolist())}
        self.longest = int(lens.max(initial=0))
        r = np.random.default_rng(17)
        self.picks = {c: np.sort(r.integers(0, n, (WALKS, SAMPLES, PICK)), axis=2) for c, n in sorted(self.steps.items())}
        # runs that a window must have one of, by their size
        self.seeds: dict[int, np.ndarray] = {}
        for h in self.words:
            q = run_length(len(h), share)
            self.seeds[q] = np.append(self.seeds.get(q, np.empty(0, np.uint64)), runs(h, q))
        self.seeds = {q: np.unique(x) for q, x in self.seeds.items()}
        self.maps = {q: self._map(x) for q, x in self.seeds.items()}
        keys, owners = [], []
        for place, h in enumerate(self.words):
            k = self.keys(h, np.zeros(1, np.int64), [int(self.cls[place])])[0][1].ravel()
            keys.append(k)
            owners.append(np.full(len(k), place))
        keys = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        owners = np.concatenate(owners) if owners else np.empty(0, np.int64)
        order = np.argsort(keys, kind="stable")
        self.key, self.owner = keys[order], owners[order]

    @staticmethod
    def _map(seeds: np.ndarray) -> np.ndarray:
        """2**22 places, those of the seeds set: a quick first look."""
        m = np.zeros(1 << 22, bool)
        m[(seeds >> np.uint64(42)).astype(np.int64)] = True
        return m

    def keys(self, h: np.ndarray, starts: np.ndarray, classes: list[int]) -> list[tuple[int, np.ndarray]]:
        """For each class: the keys (repetitions x starts)."""
        out = {c: [] for c in classes}
        most = max(self.steps[c] for c in classes)
        for turn in range(WALKS):
            put = walk(h, starts, most, turn)
            for c in classes:
                for s, (first, *more) in enumerate(self.picks[c][turn]):
                    key = put[first]
                    for step in more:
                        key = (key ^ (key >> np.uint64(31))) * MIX + put[step]
                    tag = np.full(1, (c * 64 + turn) * 64 + s + 1, np.uint64) * MIX
                    out[c].append((key ^ (key >> np.uint64(29)) ^ tag) * MIX2)
        return [(c, np.stack(k)) for c, k in out.items()]

    def starts(self, h: np.ndarray) -> np.ndarray:
        """Where a window can start: up to an item's length (and its edits) before a seed."""
        hit = np.zeros(len(h) + 1, np.int64)
        for q, seeds in self.seeds.items():
            r = runs(h, q)
            at = np.flatnonzero(self.maps[q][(r >> np.uint64(42)).astype(np.int64)])
            if len(at):
                found = r[at]
                at = at[seeds[np.minimum(np.searchsorted(seeds, found), len(seeds) - 1)] == found]
                lo = np.maximum(0, at - int(self.longest * (1 + self.share)))
                np.add.at(hit, lo, 1)
                np.add.at(hit, at + 1, -1)
        return np.flatnonzero(np.cumsum(hit[:-1]) > 0)

    def leaks(self, h: np.ndarray) -> list[tuple[int, int, int]]:
        """(place of the item, edits, start of the window) of the items that the words hold."""
        starts = self.starts(h) if len(h) else np.empty(0, np.int64)
        if not len(starts):
            return []
        found: dict[int, set] = {}
        for _, k in self.keys(h, starts, sorted(self.steps)):
            left = np.searchsorted(self.key, k)
            for row, col in zip(*np.nonzero((left < len(self.key)) & (self.key[np.minimum(left, len(self.key) - 1)] == k))):
                i, key = left[row, col], k[row, col]
                while i < len(self.key) and self.key[i] == key:
                    found.setdefault(int(self.owner[i]), set()).add(int(starts[col]))
                    i += 1
        out = []
        for place, where in sorted(found.items()):
            item = self.words[place]
            d = allowed(len(item), self.share)
            best, done = None, -1
            for start in sorted(where):
                # one look covers the starts up to d further on
                if start <= done:
                    continue
                done = start + d
                lo, hi = max(0, start - d), start + 2 * d + len(item)
                n = edits(item, h[lo:hi])
                if n <= d and (best is None or n < best[0]):
                    best = (n, start)
            if best:
                out.append((place, *best))
        return out


def edits(item: np.ndarray, text: np.ndarray) -> int:
    """Fewest word edits that turn ``item`` into some piece of ``text``."""
    row = np.zeros(len(text) + 1, np.int64)
    places = np.arange(len(text) + 1)
    for i, word in enumerate(item.tolist(), 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (text != word), row[1:] + 1)
        row = np.minimum.accumulate(new - places) + places  # insertions
    return int(row.min())


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = 0.2, block: int = 2000) -> DataFrame:
    """doc_id, item_id, edits, item_words, start (word of the window) for each leak found.

    Items go to the tasks in blocks of at most ``block`` rows, one pass over the documents
    for each block, so what is sent does not grow with the table.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null")
    n = max(1, -(-items.count() // block))
    dealt = items.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(n))) if n > 1 else items.withColumn("part", F.lit(0))
    texts = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null and text is not null")
    out = None
    for part in range(n):
        rows = sorted((r["item_id"], r["text"]) for r in dealt.where(F.col("part") == part).collect())
        shared = spark.sparkContext.broadcast(Items([i for i, _ in rows], [t for _, t in rows], share))

        def run(batches, shared=shared):
            forget()
            own = shared.value
            for batch in batches:
                found = [
                    (i, own.ids[p], e, len(own.words[p]), s)
                    for i, t in zip(batch["doc_id"].to_pylist(), texts_of(batch))
                    for p, e, s in (own.leaks(word_hashes(t)) if own.ids else ())
                ]
                columns = list(zip(*found)) if found else [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns],
                    names=["doc_id", "item_id", "edits", "item_words", "start"],
                )

        found = texts.mapInArrow(run, "doc_id long, item_id long, edits long, item_words long, start long")
        out = found if out is None else out.unionByName(found)
    return out


def op6_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return leaks(docs, benchmark)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    bad = store(leaks(docs, benchmark).select(F.col("doc_id").alias("leaked_id")).distinct(), "leaks")
    return docs.join(bad, docs["doc_id"] == bad["leaked_id"], "left_anti")
