"""Readings sources: the reference's CSV layout, Parquet, and the test fixture.

The fixture derives a machine-readings table from the driver's TPC-H-like
tables with row-wise arithmetic only (no shuffle); it follows the recipe in
``FIXTURES.md`` so Spark and DuckDB give identical rows.
"""

from __future__ import annotations

import math
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright import schema as S
from millwright.functions.expressions import flag, to_double


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def load_readings(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Read readings with the reference's CSV header (or a Parquet copy) and type them.

    A CSV's columns are taken by the names in its header, in any order and all as
    text (no inference pass over the data); files of one folder must agree on them.
    Absent columns stay absent, others are passed on.
    """
    if fmt == "csv":
        raw = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    elif fmt == "parquet":
        raw = spark.read.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")
    return type_readings(raw)


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def type_readings(raw: DataFrame) -> DataFrame:
    """Canonical names for the header's names, then :func:`clean_readings`."""
    return clean_readings(raw.select([_quoted(c).alias(S.CSV_COLUMNS.get(c, c)) for c in raw.columns]))


def clean_readings(df: DataFrame) -> DataFrame:
    """Type the columns: sensors to DOUBLE (bad text and NaN to NULL), flags to INT, type as text."""
    out = []
    for c in df.columns:
        if c in S.SENSORS:
            out.append(to_double(c).alias(c))
        elif c == S.UDI:
            out.append(F.expr(f"try_cast({c} AS BIGINT)").alias(c))
        elif c == S.PRODUCT_ID:
            out.append(F.col(c).cast("string").alias(c))
        elif c == S.TYPE:
            out.append(F.col(c).cast("string").alias(c))
        elif c in S.MODE_COLS or c == S.LABEL:
            out.append(F.expr(f"try_cast(try_cast({c} AS DOUBLE) AS INT)").alias(c))
        else:
            out.append(_quoted(c))
    return df.select(out)


def _synthesize(src: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Sensor values and labels from two integer keys ``k`` and ``a`` (see FIXTURES.md)."""
    k, a = F.col("k"), F.col("a")
    air = F.lit(295.3) + (a % 93).cast("double") / F.lit(10.0)
    proc = air + F.lit(7.9) + ((k * 7 + a) % 41).cast("double") / F.lit(10.0)
    rpm = (F.lit(1250) + (k * 31 + a * 17) % 500).cast("double")
    torque = F.lit(16.0) + ((k * 13 + a) % 51).cast("double") * F.lit(0.5) + ((k + a * 29) % 51).cast("double") * F.lit(0.5)
    wear = ((k % 16) * ((k * 5 + a * 3) % 17)).cast("double")
    typ = F.when(k % 10 < 6, "L").when(k % 10 < 9, "M").otherwise("H")
    keep = keep or []
    base = src.select(
        "udi", "product_id", "k", *keep,
        typ.alias(S.TYPE), air.alias(S.AIR), proc.alias(S.PROCESS), rpm.alias(S.RPM),
        torque.alias(S.TORQUE), wear.alias(S.WEAR),
    )
    pw = F.col(S.TORQUE) * F.col(S.RPM) * F.lit(math.pi) / F.lit(30.0)
    limit = F.when(F.col(S.TYPE) == "L", 11000.0).when(F.col(S.TYPE) == "M", 12000.0).otherwise(13000.0)
    modes = {
        "twf": flag((F.col(S.WEAR) > 200.0) & (k % 3 == 0)),
        "hdf": flag((F.col(S.PROCESS) - F.col(S.AIR) < 8.6) & (F.col(S.RPM) < 1380)),
        "pwf": flag((pw < 3500.0) | (pw > 9000.0)),
        "osf": flag(F.col(S.WEAR) * F.col(S.TORQUE) > limit),
        "rnf": flag(k % 1000 == 7),
    }
    with_modes = base.select("*", *[v.alias(n) for n, v in modes.items()])
    total: Column = sum((F.col(m) for m in S.MODE_COLS), F.lit(0))
    return with_modes.select(
        S.UDI, S.PRODUCT_ID, S.TYPE, *S.SENSORS, *S.MODE_COLS,
        F.when(total > 0, 1).otherwise(0).alias(S.LABEL),
        *keep,
    )


def readings_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch readings: one per line item (udi not unique)."""
    li = table(spark, sf_dir, "lineitem")
    src = li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("udi"),
        F.col("l_partkey").alias("product_id"),
        (F.col("l_orderkey") * 7 + F.col("l_partkey") * 3 + F.col("l_linenumber")).alias("k"),
        (F.col("l_suppkey") + F.col("l_quantity").cast("bigint") * 11).alias("a"),
    )
    return _synthesize(src)


def readings_from_events(spark: SparkSession, sf_dir: str, with_ts: bool = False) -> DataFrame:
    """Readings with a unique ``udi`` (the event id), optionally keeping the event time."""
    ev = table(spark, sf_dir, "events")
    return readings_from_event_frame(ev, with_ts)


def readings_from_event_frame(ev: DataFrame, with_ts: bool = False) -> DataFrame:
    cols = [
        F.col("event_id").alias("udi"),
        F.col("user_id").alias("product_id"),
        (F.col("event_id") * 7919 + F.col("user_id") * 3).alias("k"),
        (F.col("user_id") + F.floor(F.col("value") * 100.0).cast("bigint")).alias("a"),
    ]
    if with_ts:
        cols.append(F.col("ts"))
    return _synthesize(ev.select(*cols), keep=["ts"] if with_ts else [])
