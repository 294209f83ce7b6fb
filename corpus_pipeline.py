"""The corpus pipeline: five stages, each taking the documents that the last one kept.

Every stage but the last returns the columns it was given.  A null ``doc_id`` is never
rejected; a stage that rejects rows does so by ``doc_id``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.llm import bpe_bytes, decontaminate, line_dedup, minhash_dedup, toxicity
from millwright.llm.common import store, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that operator 5 predicts to be toxic go."""
    found = toxicity.op5_toxicity(docs, table(spark, sf_dir, "labels")).where("predicted = 1")
    bad = store(found.select(F.col("doc_id").alias("toxic_id")).distinct(), "toxic-ids")
    return docs.join(bad, docs["doc_id"] == bad["toxic_id"], "left_anti")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9's lines go; texts, and their lengths in ``n_chars``, are what is left."""
    return line_dedup.replace_texts(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies by operator 1 (five words, 0.8) the smallest doc_id stays."""
    found = minhash_dedup.near_dedup(docs, size=5, share=80).where("not kept")
    bad = store(found.select(F.col("doc_id").alias("copy_id")).distinct(), "copy-ids")
    return docs.join(bad, docs["doc_id"] == bad["copy_id"], "left_anti")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item by operator 6 go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7's ids of what is left: their number and digests by doc_id."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe_bytes.op7_byte_bpe(docs, path, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontaminate", drop_leaks),
    ("byte_bpe", encode),
]

#: Learned scores and the tokenizer's merges have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is stored as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
