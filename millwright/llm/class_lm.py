"""Operator 4: Brown class-based bigram language model.

Words are put into classes by exchange clustering; the probability of a word after
another is that of its class after the other's class, times that of the word in its
class, both smoothed.

Everything is counted over the whole training texts.  Every word that occurs ``least`` times
gets a class, however many there are; the others form one class of rare words, which also
holds the unseen; the end of a text is a class of its own.  Counts of all words stay a
distributed table.  The ``common`` most frequent words are looked up while texts are read,
all others are joined with the table of counts, once: from then on texts are stored as
numbers of words.  What is broadcast besides the common words is a byte, the class, for
each word that has one, and the class by class counts.

Exchange: given the classes, a pass over the numbers says how often each word that may move stands
before and after each class; these counts go by blocks of words to the tasks that look for the
class of each word that raises the likelihood of the class bigrams most.  Half of the words
(another half each time) move at once, until the likelihood stops rising; the classes of
the highest likelihood count.  The ``clustered`` most frequent words start out in classes, the others
join them from the rare class in the first two rounds.

Smoothing: a class c follows class b with (N(b, c) + MU * P(c)) / (N(b) + MU), P(c) =
(N(c) + 1) / (N + classes); a rare word has (n + 0.1) / (N(rare) + 0.1 * (V(rare) + 1)),
of which one part is left for all unseen words; the end is certain in its class.

Defined cases: a null or empty text is just an end; with no training text all counts are
zero and the formulas still hold; repeated rows count each time; a row without a doc_id is
held out.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import discard, held_out, released, store, words
from millwright.llm.token_files import decode_values, encode_values, parts_of

MU = 20.0
#: Words that occur less often share the rare class.
LEAST = 10
#: The exchange ends when the likelihood rises by less than this for a token.
RISE = 1e-3
END = 1  # class numbers: 0 rare words, 1 the end of a text, then the clusters


def word_counts(texts: DataFrame, flush: int = 400_000) -> DataFrame:
    """word, n over all texts; each task adds up before it sends."""

    def sent(c: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c.keys()), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["word", "n"]
        )

    def run(batches):
        c: Counter = Counter()
        for batch in batches:
            for text in batch["text"].to_pylist():
                c.update(words(text))
                if len(c) > flush:
                    yield sent(c)
                    c = Counter()
        yield sent(c)

    return texts.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Numbers of words: 0 rare or unseen, from 1 the common ones, ``end``, then all others that occur ``least`` times."""

    def __init__(self, texts: DataFrame, common: int, least: int):
        self.counts = store(word_counts(texts), "word-counts")
        self.n_texts = texts.count()
        row = self.counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
        self.tokens, self.types = row["n"] + self.n_texts, row["v"] + (1 if self.n_texts else 0)
        top = self.frequent(common)
        self.common, self.n = [bytes(r["word"]) for r in top], np.array([r["n"] for r in top], float)
        self.end = len(top) + 1
        self.often = int((self.n >= least).sum())  # common words that get classes
        outside = self.counts.where(F.col("n") < self.floor) if top else self.counts
        numbered = outside.where(F.col("n") >= least).withColumn("number", F.monotonically_increasing_id())
        rest = outside.where(F.col("n") < least).withColumn("number", F.lit(None).cast("long"))
        self.outside = store(numbered.unionByName(rest), "word-numbers")
        # a number holds the task (from bit 33) and the place in it; one offset for each task makes them dense
        sizes = self.outside.where("number is not null").groupBy(F.shiftright("number", 33).alias("task")).count().collect()
        self.offsets = np.zeros(1 + max((r["task"] for r in sizes), default=0), np.int64)
        self.size = self.end + 1
        for task, n in sorted((r["task"], r["count"]) for r in sizes):
            self.offsets[task], self.size = self.size, self.size + n
        self.rare_types = max(0, self.types - 1 - self.often - (self.size - self.end - 1)) if self.n_texts else 0


    def frequent(self, common: int) -> list:
        """The words that occur ``floor`` times or more, the most frequent first: no more than ``common``.

        The floor comes from a histogram of the counts by their eight highest bits, so that only the
        words above it are collected, not each task's best.
        """
        low = F.greatest(F.length(F.bin("n")) - 8, F.lit(0))
        bins = self.counts.select("n", low.alias("low")).select(F.expr("shiftleft(shiftright(n, low), low)").alias("at"))
        room, self.floor = common, None
        for b in bins.groupBy("at").count().orderBy(F.desc("at")).collect():
            room -= b["count"]
            if room < 0:
                break
            self.floor = b["at"]
        if self.floor is None:
            return []
        found = self.counts.where(F.col("n") >= self.floor).collect()
        return sorted(found, key=lambda r: (-r["n"], bytes(r["word"])))


def encode(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """doc_id, ids (32-bit numbers of the words), and of the words that are not common: ``found`` of them in
    training, ``logs`` (log10 of counts + 0.1) and ``own_logs`` (the same, but log10 of counts for those with a class)."""
    shared = docs.sparkSession.sparkContext.broadcast((v.common, v.offsets))

    def look(batches):
        place = {w: i + 1 for i, w in enumerate(shared.value[0])}
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                ids, rest = [], []
                for text in part["text"].to_pylist():
                    own = words(text)
                    p = np.fromiter(map(place.get, own, repeat(0)), np.int32, len(own))
                    ids.append(p.tobytes())
                    rest.append([own[i] for i in np.flatnonzero(p == 0).tolist()])
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array(ids, pa.binary()), pa.array(rest, pa.list_(pa.binary()))],
                    names=["doc_id", "ids", "rest"],
                )

    def fill(batches):
        offsets = shared.value[1]
        for batch in batches:
            ids = []
            at, m = (batch[c].flatten().to_numpy(zero_copy_only=False) for c in ("at", "number"))
            number = offsets[m >> 33] + (m & (1 << 33) - 1)
            cuts = np.cumsum([0, *(x or 0 for x in pc.list_value_length(batch["at"]).to_pylist())]).tolist()
            for own, lo, hi in zip(batch["ids"].to_pylist(), cuts, cuts[1:]):
                if lo < hi:
                    p = np.frombuffer(own, np.int32).copy()
                    p[np.flatnonzero(p == 0)[at[lo:hi]]] = number[lo:hi]
                    own = p.tobytes()
                ids.append(own)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(ids, pa.binary()), batch["found"], batch["logs"], batch["own_logs"]],
                names=["doc_id", "ids", "found", "logs", "own_logs"],
            )

    looked = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(look, "doc_id long, ids binary, rest array<binary>")
    parts = store(looked.withColumn("row_id", F.monotonically_increasing_id()), "lm-parts")
    asked = parts.select("row_id", F.posexplode("rest").alias("at", "word"))
    log = F.log10(F.coalesce("n", F.lit(0)) + 0.1)
    known = F.collect_list(F.when(F.col("number").isNotNull(), F.struct("at", "number")))
    joined = (
        asked.join(v.outside.hint("shuffle_hash"), "word", "left")
        .groupBy(F.col("row_id").alias("joined_id"))
        .agg(
            F.count("n").alias("found"),
            F.sum(log).alias("logs"),
            F.sum(F.when(F.col("number").isNull(), log).otherwise(F.log10("n"))).alias("own_logs"),
            known.alias("known"),
        )
    )
    whole = parts.drop("rest").join(joined, F.col("row_id") == F.col("joined_id"), "left").select(
        "doc_id",
        "ids",
        F.coalesce("found", F.lit(0)).alias("found"),
        F.coalesce("logs", F.lit(0.0)).alias("logs"),
        F.coalesce("own_logs", F.lit(0.0)).alias("own_logs"),
        F.col("known.at").alias("at"),
        F.col("known.number").alias("number"),
    )
    coded = store(whole.mapInArrow(fill, "doc_id long, ids binary, found long, logs double, own_logs double"), "lm-ids")
    discard(parts)
    return coded


def stream(ids: list[bytes], end: int) -> np.ndarray:
    """The texts one after another, with the end before, between and after them."""
    cut = np.int32(end).tobytes()
    return np.frombuffer(cut + b"".join(x + cut for x in ids), np.int32).astype(np.int64)


def _log(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def _free(number: np.ndarray, often: int, end: int, step: int) -> np.ndarray:
    """The words that a step may move: every other one of those with a class, the others in the next step."""
    return (number % 2 != step % 2) & (number > 0) & ((number <= often) | (number > end))


def _by_block(number: np.ndarray, blocks: int) -> np.ndarray:
    """Ascending numbers in order of their blocks; small keys are sorted by radix."""
    return number[np.argsort((number % blocks).astype(np.uint16 if blocks <= 2**16 else np.int64), kind="stable")]


def contexts(coded: DataFrame, of: np.ndarray, often: int, end: int, total: int, blocks: int, step: int) -> DataFrame:
    """block, size, control, data: for each block of words (number mod ``blocks``) and task, what stands beside its
    words that this step may move.

    A code is (place in the block * 2 + side) * total + class of the neighbour; block -1 has the class by class counts
    of all words. The ``size`` codes, each less the one before, and then how often each occurs are packed by
    ``encode_values``. Words are counted in rows that are in order of their blocks, so that codes need no sort.
    """
    shared, width = coded.sparkSession.sparkContext.broadcast(of), 2 * total

    def added(dense, codes):
        return dense + np.bincount(np.concatenate(codes), minlength=len(dense)) if codes else dense

    def run(batches):
        cls = shared.value
        free = np.flatnonzero(_free(np.arange(len(cls)), often, end, step))
        common = int(np.searchsorted(free, end))
        rows = np.concatenate([_by_block(free[:common], blocks), _by_block(free[common:], blocks)])
        first = np.full(len(cls), -1, np.int64)  # code of each word's row
        first[rows] = width * np.arange(len(rows))
        grid, dense = np.zeros(total * total, np.int64), np.zeros(common * width, np.int64)
        waiting, others = [], []
        for batch in parts_of(batches):
            p = stream(batch["ids"].to_pylist(), end)
            c = cls[p]
            grid += np.bincount(c[:-1] * np.int64(total) + c[1:], minlength=len(grid))
            code = first[p]
            at = np.flatnonzero(code >= 0)  # never the first or last place, which are ends
            code = code[at]
            code = np.concatenate([code + c[at + 1], code + total + c[at - 1]])
            few = code < len(dense)
            waiting.append(code[few])
            others.append(code[~few])
            if sum(map(len, waiting)) > len(dense):
                dense, waiting = added(dense, waiting), []
        dense = added(dense, waiting)
        code = np.flatnonzero(dense)
        found = [(code, dense[code]), np.unique(np.concatenate([np.empty(0, np.int64), *others]), return_counts=True)]
        parts = []
        for code, n in found:
            row = code // width
            number = rows[row]
            cuts = np.searchsorted(number % blocks, np.arange(blocks + 1)).tolist()
            parts.append((number // blocks * width + code - row * width, n, cuts))
        each = [tuple(np.concatenate([x[i][x[2][b] : x[2][b + 1]] for x in parts]) for i in (0, 1)) for b in range(blocks)]
        full = [b for b in range(blocks) if len(each[b][0])]
        packed = [_packed(*each[b]) for b in full]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([-1, *full], pa.int64()),
                pa.array([len(grid), *(len(each[b][0]) for b in full)], pa.int64()),
                pa.array([b"", *(c for c, _ in packed)], pa.binary()),
                pa.array([grid.tobytes(), *(d for _, d in packed)], pa.binary()),
            ],
            names=["block", "size", "control", "data"],
        )

    return coded.select("ids").mapInArrow(run, "block long, size long, control binary, data binary")


def _packed(code: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes]:
    """Ascending codes and their counts in a byte or two each."""
    return encode_values(np.concatenate([np.diff(code, prepend=0), n]))


def _unpacked(size: int, control: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = decode_values(control, data, 2 * size).astype(np.int64)
    return np.cumsum(both[:size]), both[size:]


def exchange(coded: DataFrame, v: Vocabulary, clustered: int, classes: int, rounds: int, block: int = 4096):
    """(class of each number, class by class counts); rare words and the end keep theirs."""
    total, sc = classes + 2, coded.sparkSession.sparkContext
    of = np.zeros(v.size, np.uint8 if total <= 256 else np.int32)
    k = min(clustered, v.often)
    of[1 : k + 1] = 2 + np.arange(k) % classes
    of[v.end] = END
    blocks = 2 * (v.size // block) + 1  # odd, so that each has words of both halves
    end, often, best = v.end, v.often, None
    for step in range(rounds + 1):
        found = store(contexts(coded, of, often, end, total, blocks, step), "class-contexts")
        counts = np.zeros((total, total))
        for r in found.where("block = -1").select("data").collect():
            counts += np.frombuffer(r["data"], np.int64).reshape(total, total)
        likely = float(_log(counts).sum() - _log(counts.sum(0)).sum() - _log(counts.sum(1)).sum())
        rise = math.inf if best is None else likely - best[0]
        if rise > 0 or step < 3:  # all words have had their first move after two rounds
            best = likely, of.copy(), counts
        if step == rounds or step > 2 and rise <= RISE * counts.sum():
            discard(found)
            return best[1:]
        shared = sc.broadcast((of, counts, blocks, often, end, step))
        with released(coded.sparkSession):
            new = found.where("block >= 0").groupBy("block").applyInArrow(_mover(shared), "block long, cls binary").collect()
        of = of.copy()
        for r in new:
            of[r["block"] :: blocks] = np.frombuffer(r["cls"], of.dtype)
        discard(found)
        shared.unpersist()


def _mover(shared):
    """Sums up what ``contexts`` says of a block and moves half of its words."""

    def move(table: pa.Table) -> pa.Table:
        of, counts, blocks, often, end, step = shared.value
        at = table["block"][0].as_py()
        own = of[at::blocks]
        m = np.zeros(len(own) * 2 * len(counts))
        for part in zip(*(table[c].to_pylist() for c in ("size", "control", "data"))):
            code, n = _unpacked(*part)
            m[code] += n  # a code comes once
        m = m.reshape(len(own), 2, len(counts))
        number = at + blocks * np.arange(len(own))
        free = _free(number, often, end, step)
        new = own.copy()
        for i in np.array_split(np.flatnonzero(free), -(-len(own) // 256)):
            new[i] = _moved(own[i].astype(np.int64), m[i, 0], m[i, 1], counts)
        return pa.table({"block": pa.array([at]), "cls": pa.array([new.tobytes()], pa.binary())})

    return move


def _risen(left: np.ndarray, more: np.ndarray) -> np.ndarray:
    """What the terms of ``left`` gain by ``more`` in each column; logarithms are taken only where there is more."""
    out = np.zeros_like(left)
    i, j = np.nonzero(more)
    was = left[i, :, j]
    out[i, :, j] = _log(was + more[i, j, None]) - _log(was)
    return out


def _moved(a: np.ndarray, after: np.ndarray, before: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The best classes of words against fixed counts; ``a``: their classes, ``after``, ``before``: counts with each class."""
    i = np.arange(len(a))
    # take each word out of its class
    left = np.repeat(counts[None], len(a), 0)
    left[i, a] -= after
    left[i, :, a] -= before
    out, into = np.repeat(counts.sum(1)[None], len(a), 0), np.repeat(counts.sum(0)[None], len(a), 0)
    n_out, n_in = after.sum(1), before.sum(1)
    out[i, a] -= n_out
    into[i, a] -= n_in
    # bringing it to c changes row c and column c; the corner is counted with the row
    gain = _risen(left, after).sum(2) + _risen(left.transpose(0, 2, 1), before).transpose(0, 2, 1).sum(1)
    gain -= _log(out + n_out[:, None]) - _log(out) + _log(into + n_in[:, None]) - _log(into)
    gain[:, :2] = -np.inf
    best = gain.argmax(1)
    return np.where(gain[i, best] > gain[i, a] + 1e-9, best, a)


class Model:
    """What scoring needs; bounded by the number of classes but for the common words and a byte for each word with a class."""

    def __init__(self, v: Vocabulary, of: np.ndarray, class_pairs: np.ndarray):
        self.tokens, self.ends = v.tokens, v.n_texts
        self.common, self.end, self.cls = v.common, v.end, of
        total = class_pairs.shape[0]
        size = class_pairs.sum(0)  # how often each class occurs
        share = (size + 1) / (size.sum() + total)
        self.step = np.log10((class_pairs + MU * share) / (class_pairs.sum(1, keepdims=True) + MU))
        self.base_size = math.log10(v.tokens + 0.1 * (v.types + 1))
        self.rare_size = math.log10(size[0] + 0.1 * (v.rare_types + 1))
        self.sizes = np.log10(np.maximum(size, 1))
        n = np.concatenate([[0], v.n, [v.n_texts]])
        self.base = np.log10(n + 0.1)
        cls = of[: v.end + 1]
        with np.errstate(divide="ignore"):
            self.emit = np.where(cls > 1, np.log10(n) - self.sizes[cls], self.base)
        self.emit[0] = self.base[0] = 0.0  # joined
        self.emit[-1] = 0.0

    def of_text(self, ids: bytes) -> tuple:
        """(tokens, common tokens, base and score without what is joined)."""
        p = np.append(np.frombuffer(ids, np.int32), np.int32(self.end))
        cls = self.cls[p]
        before = np.concatenate([cls[-1:], cls[:-1]])
        base, common = -len(p) * self.base_size, p <= self.end
        base += float(self.base[p[common]].sum())
        score = float(self.step[before, cls].sum() + self.emit[p[common]].sum() - self.sizes[cls[~common]].sum())
        known = int((common & (p > 0)).sum()) - (0 if self.ends else 1)
        return len(p), known, base, score - int((cls == 0).sum()) * self.rare_size


def learn(coded: DataFrame, v: Vocabulary, clustered: int = 2_000, classes: int = 32, rounds: int = 20) -> Model:
    """The model of training rows that ``encode`` gave."""
    return Model(v, *exchange(coded, v, clustered, classes, rounds))


def train(texts: DataFrame, common: int = 100_000, clustered: int = 2_000, classes: int = 32, rounds: int = 20, least: int = LEAST):
    """(model, word counts) from the columns ``doc_id`` and ``text`` of the training rows."""
    v = Vocabulary(texts, common, least)
    return learn(encode(texts, v), v, clustered, classes, rounds), v.counts


def score(coded: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every row that ``encode`` gave."""
    shared = coded.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            n, known, base, total = zip(*map(m.of_text, batch["ids"].to_pylist())) if batch.num_rows else ((),) * 4
            logs, own = batch["logs"].to_numpy(), batch["own_logs"].to_numpy()
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array(n, pa.int64()),
                    pa.array(np.array(known, np.int64) + batch["found"].to_numpy()),
                    pa.array(np.array(base, float) + logs),
                    pa.array(np.array(total, float) + own),
                ],
                names=["doc_id", "n_tokens", "n_known", "base_score", "score"],
            )

    return coded.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def op4_class_lm(docs: DataFrame, folds: int = 10, common: int = 100_000, least: int = LEAST) -> DataFrame:
    v = Vocabulary(docs.where(~held_out(folds)), common, least)
    coded = encode(docs, v)
    model = learn(coded.where(~held_out(folds)), v)
    return score(coded, model).select(
        "doc_id",
        held_out(folds).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
