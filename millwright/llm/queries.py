"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millwright.llm import (
    bpe_bytes,
    class_lm,
    decontaminate,
    filter_audit,
    line_dedup,
    merkle,
    minhash_dedup,
    secrets,
    token_files,
    tool_calls,
    topk,
    toxicity,
    url_filter,
)
from millwright.llm.common import table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("op1_near_dedup", minhash_dedup.ORACLE)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.op1_near_dedup(table(spark, sf_dir, "documents"))


@query("op2_tool_calls", tool_calls.ORACLE)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.op2_tool_calls(table(spark, sf_dir, "conversations"))


@query("op3_token_files")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.op3_token_files(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), vocab=49_408
    )


@query("op4_class_lm")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.op4_class_lm(table(spark, sf_dir, "documents"))


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op5_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_decontaminate")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op6_decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_byte_bpe")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe_bytes.op7_byte_bpe(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@query("op8_secrets")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op8_secrets(table(spark, sf_dir, "documents"))


@query("op9_line_dedup", line_dedup.ORACLE)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.op9_line_dedup(table(spark, sf_dir, "documents"))


@query("op10_topk", topk.ORACLE)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.op10_topk(table(spark, sf_dir, "embeddings"))


@query("op11_url_filter", url_filter.ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.op11_url_filter(table(spark, sf_dir, "pages"))


@query("op12_merkle", merkle.ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.op12_merkle(table(spark, sf_dir, "documents"))


@query("op13_filter_audit", filter_audit.ORACLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.op13_filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
