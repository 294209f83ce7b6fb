"""Operator 5: toxicity by FTRL-proximal logistic regression over hashed n-grams.

Features of a text are present or absent: its words and their stems (first bytes), pairs
of neighbouring words and pairs with one word between (skip-grams), of lower-cased
letters and digits, hashed to 2**BITS places.  FTRL-proximal keeps an adaptive rate for each coordinate
and an L1 term that leaves most weights exactly zero; what is broadcast is the short
list of the others, at most 2**BITS.

The fit takes a bounded sample of labelled rows: the ``sample`` texts of each label with
the smallest hash of their id, outside the held-out fold.  They are dealt to ``SHARDS``
tasks; after each round the shards' weights are averaged (iterative parameter mixing)
and start the next.  Where the sample leaves out labels, the bias is moved by what that changed
in the log-odds of the labels.  Scoring reads every whole text once, map-only.

Defined cases: a null or empty text has no feature and gets the bias alone; without
labelled rows of both labels every score is the share of label 1 seen (0 without any);
conflicting labels of a doc_id count as their largest; repeated rows are each scored;
a row without a doc_id is held out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import MIX, MIX2, RunHash, forget, held_out, store, texts_of

BITS = 20
SHARDS = 2
ALPHA, BETA, L1, L2 = 2.0, 1.0, 4.0, 0.1
#: Compounds of one stem share its first bytes.
STEMS = (5, 7)
_HASH = RunHash()


def features(text: str | None) -> np.ndarray:
    """Places of the words, pairs and skip-pairs, with repeats."""
    h, *stems = _HASH.of(text, *STEMS)
    pair = (h[:-1] ^ (h[:-1] >> np.uint64(31))) * MIX + h[1:]
    skip = (h[:-2] ^ (h[:-2] >> np.uint64(29))) * MIX2 + h[2:]
    stems = [x * (MIX ^ np.uint64(2 * i + 2)) for i, x in enumerate(stems)]
    out = np.concatenate([h * MIX2, *stems, pair * MIX2, skip * MIX])
    return (out >> np.uint64(64 - BITS)).astype(np.int64)


class Ftrl:
    """Per-coordinate FTRL-proximal; place 2**BITS is the bias, which has no L1 term."""

    def __init__(self, z: np.ndarray | None = None, n: np.ndarray | None = None):
        self.z = np.zeros(2**BITS + 1) if z is None else z
        self.n = np.zeros(2**BITS + 1) if n is None else n

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == 2**BITS, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, 2**BITS)
        w = self.weights(at)
        p = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(w.sum())))))
        g = p - label
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g


def training_labels(labels: DataFrame, folds: int) -> DataFrame:
    """label_id, label, place: one row for each labelled doc_id outside the held-out fold."""
    return (
        labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("label"))
        .where("label_id is not null and label in (0, 1)")
        .where(~held_out(folds, "label_id"))
        .groupBy("label_id")
        .agg(F.max("label").alias("label"))
        .withColumn("place", F.xxhash64("label_id"))
    )


def training_rows(docs: DataFrame, told: DataFrame, sample: int) -> DataFrame:
    """shard, place in it, label, text of the sample; the same rows on every run."""
    pick = lambda y: told.where(F.col("label") == y).orderBy("place", "label_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    rows = texts.join(pick(0).unionByName(pick(1)), F.col("doc_id") == F.col("label_id"))
    # learned in another order than picked, else the label with the longer reach comes last
    order = F.xxhash64("label_id", F.lit(1)).alias("place")
    return rows.select(F.pmod("place", F.lit(SHARDS)).cast("int").alias("shard"), order, "label", "text")


def prior_shift(told: DataFrame, sample: int) -> float:
    """Log-odds of label 1 among all training labels less those among the sampled ones; 0 where all are sampled."""
    n = {r["label"]: r["count"] for r in told.groupBy("label").count().collect()}
    return math.log(n[1] / n[0]) - math.log(min(n[1], sample) / min(n[0], sample))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4000, folds: int = 5, rounds: int = 2, epochs: int = 2):
    """(places, weights, bias): the weights that are not zero, from ``2 * sample`` rows at most."""
    spark = docs.sparkSession
    told = training_labels(labels, folds)
    rows = store(training_rows(docs, told, sample), "toxic-sample")
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        share = 1e-6 if 1 not in counts else 1 - 1e-6
        return np.empty(0, np.int64), np.empty(0), math.log(share / (1 - share))
    z, n = np.zeros(2**BITS + 1), np.zeros(2**BITS + 1)
    for _ in range(rounds):
        start = spark.sparkContext.broadcast((z, n))

        def run(batches, start=start):
            forget()
            model, dealt = Ftrl(start.value[0].copy(), start.value[1].copy()), []
            for batch in batches:
                for place, label, text in zip(batch["place"].to_pylist(), batch["label"].to_pylist(), texts_of(batch)):
                    dealt.append((place, label, np.unique(features(text)).astype(np.int32)))
            if not dealt:
                return
            dealt.sort(key=lambda x: (x[0], x[1], len(x[2])))
            for _ in range(epochs):
                for _, label, at in dealt:
                    model.learn(at, label)
            at = np.flatnonzero(model.n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at), pa.array(model.z[at]), pa.array(model.n[at])], names=["at", "z", "n"]
            )

        shards = rows.repartition(SHARDS, "shard").select("place", "label", "text")
        mixed = shards.mapInArrow(run, "at long, z double, n double").groupBy("at").agg(
            F.avg("z").alias("z"), F.avg("n").alias("n")
        )
        # only places whose weight can be other than zero come to the driver, at most 2**BITS + 1
        back = mixed.where((F.abs("z") > L1) | (F.col("at") == 2**BITS)).toPandas()
        z, n = np.zeros(2**BITS + 1), np.zeros(2**BITS + 1)
        z[back["at"]], n[back["at"]] = back["z"], back["n"]
        start.unpersist()
    w = Ftrl(z, n).weights(np.arange(2**BITS + 1))
    at = np.flatnonzero(w[:-1])
    return at, w[at], float(w[-1]) + prior_shift(told, sample)


def scores(docs: DataFrame, model) -> DataFrame:
    """doc_id, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2**BITS weights

    def run(batches):
        forget()
        at, w, bias = shared.value
        dense = np.zeros(2**BITS, np.float32)
        dense[at] = w
        for batch in batches:
            out = []
            for text in texts_of(batch):
                f = features(text)
                hit = np.unique(f[dense[f] != 0])
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, float(dense[hit].sum()) + bias)))))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(out, pa.float64())], names=["doc_id", "score"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def op5_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    found = scores(docs, fit(docs, labels, folds=folds))
    return found.select(
        "doc_id",
        held_out(folds).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
