"""Input quality: out-of-range flags, z-scores, anomaly score, operating-limit checks.

The feature profile (min, max, mean, sample std of five sensors) is fitted
state of five rows. It is taken once as plain values and applied as literals,
so scoring is a projection with no join and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright import schema as S
from millwright.functions import expressions as X
from millwright.functions import json as J
from millwright.operators import fleet

Profile = dict[str, dict[str, float]]


def fit_profile(df: DataFrame) -> Profile:
    """``{feature: {min, max, mean, std}}`` from the readings (at most five rows reach the driver)."""
    return {r["feature"]: {k: r[k] for k in ("min", "max", "mean", "std")}
            for r in fleet.feature_profile(df).collect()}


def _oor(c: str, p: dict) -> Column:
    v = F.col(c)
    return F.when((v < F.lit(p["min"])) | (v > F.lit(p["max"])),
                  F.struct(F.lit(S.SENSOR_LONG_NAMES[c]).alias("feature"), v.alias("value"),
                           F.lit(p["min"]).alias("min"), F.lit(p["max"]).alias("max")))


def _z(c: str, p: dict) -> Column:
    return (F.col(c) - F.lit(p["mean"])) / F.lit(p["std"])


def assess_quality(df: DataFrame, profile: Profile | None) -> DataFrame:
    """Adds ``z_<sensor>``, ``max_abs_z``, ``out_of_range`` and ``high_z`` (arrays of structs),
    ``anomaly_score``, ``anomaly_detected`` and ``confidence_component``.

    NULL sensor values are skipped. With no profile the result is neutral
    (score 0, not detected, component 0.5).
    """
    feats = [c for c in S.SENSORS if profile and c in profile]
    if not feats:
        kind = lambda *names: "array<struct<feature:string," + ",".join(f"{n}:double" for n in names) + ">>"
        return df.select("*", *[F.lit(None).cast("double").alias(f"z_{c}") for c in S.SENSORS],
                         F.lit(0.0).alias("max_abs_z"),
                         F.array().cast(kind("value", "min", "max")).alias("out_of_range"),
                         F.array().cast(kind("value", "z_score")).alias("high_z"),
                         F.lit(0.0).alias("anomaly_score"), F.lit(False).alias("anomaly_detected"),
                         F.lit(S.NEUTRAL_COMPONENT).alias("confidence_component"))
    zs = {c: _z(c, profile[c]) for c in feats}
    z_cols = [zs[c].alias(f"z_{c}") for c in feats]
    with_z = df.select("*", *z_cols)
    max_abs = F.coalesce(F.array_max(F.array(*[F.abs(F.col(f"z_{c}")) for c in feats])), F.lit(0.0))
    oor = X.compact_array(*[_oor(c, profile[c]) for c in feats])
    high = X.compact_array(*[
        F.when(F.abs(F.col(f"z_{c}")) >= F.lit(S.HIGH_Z),
               F.struct(F.lit(S.SENSOR_LONG_NAMES[c]).alias("feature"), F.col(c).alias("value"),
                        F.col(f"z_{c}").alias("z_score")))
        for c in feats])
    q = with_z.select("*", max_abs.alias("max_abs_z"), oor.alias("out_of_range"), high.alias("high_z"))
    score = (F.lit(S.Z_WEIGHT) * F.least(F.col("max_abs_z") / F.lit(S.Z_SCALE), F.lit(1.0))
             + F.lit(S.RANGE_WEIGHT) * F.when(F.size("out_of_range") > 0, 1.0).otherwise(0.0))
    q = q.select("*", score.alias("anomaly_score"),
                 ((F.size("out_of_range") > 0) | (F.size("high_z") > 0)).alias("anomaly_detected"))
    return q.select("*", F.least(F.greatest(F.lit(1.0) - F.col("anomaly_score"), F.lit(0.0)), F.lit(1.0))
                    .alias("confidence_component"))


def reliability_warnings(df: DataFrame) -> DataFrame:
    """Text warnings from ``out_of_range`` and ``high_z`` (after :func:`assess_quality`)."""
    return df.select(
        "*",
        F.transform("out_of_range", lambda o: F.format_string(S.RANGE_WARNING,
                                                               o["feature"], o["value"], o["min"], o["max"]))
        .alias("range_warnings"),
        F.transform("high_z", lambda h: F.format_string(S.Z_WARNING, h["feature"], h["z_score"])).alias("z_warnings"),
    )


def check_limits(requests: DataFrame, limits: DataFrame, payload: str = "payload", id_col: str = "request_id") -> DataFrame:
    """Per request and known sensor key: value against the inclusive operating limits.

    Keys are short names (RPM, Torque, ToolWear, Wear, AirTemp, ProcessTemp)
    or the long sensor names; other keys are skipped. Payloads are read as for
    scoring (``requests.parse_requests``): the last value of a repeated key counts.
    Non-numeric values get status ``INVALID``. A request whose payload is null, malformed,
    empty or no object gets one row per sensor instead, with a null key and the dataset's
    ``violations`` (null for keyed rows): pass the rows of :func:`fleet.limit_violations` as
    ``limits``. The limits table has one row per sensor, so it is broadcast.
    """
    known = {**S.LIMIT_KEYS, **{name: c for c, name in S.SENSOR_LONG_NAMES.items()}}
    none = F.lit(None).cast("string")
    read = J.read_objects(requests.select(id_col, payload), F.replace(F.col(payload), F.lit("'"), F.lit('"')))
    keyed = X.compact_array(*[
        F.when(J.has_key(k), F.struct(F.lit(k).alias("key"), F.lit(c).alias("sensor"), J.raw_value(k).alias("raw"),
                                      F.lit(False).alias("whole"))) for k, c in known.items()])
    whole = F.array(*[F.struct(none.alias("key"), F.lit(c).alias("sensor"), none.alias("raw"), F.lit(True).alias("whole"))
                      for c in S.SENSORS])
    kv = read.select(id_col, F.inline(F.when(J.object_size() > 0, keyed).otherwise(whole)))
    kv = kv.select(id_col, "key", "sensor", "whole", X.to_double(F.col("raw")).alias("value"))
    lim = F.broadcast(limits.select("sensor", "sensor_name", "lo", "hi", F.col("violations").alias("found")))
    j = kv.join(lim, "sensor")
    within = (F.col("lo") <= F.col("value")) & (F.col("value") <= F.col("hi"))
    by_key = F.when(F.col("value").isNull(), "INVALID").when(within, "OK").otherwise("OUT OF RANGE")
    by_sensor = F.when(F.col("found") == 0, "OK").otherwise(F.concat(F.col("found").cast("string"), F.lit(" violations")))
    return j.select(id_col, "key", "sensor", "sensor_name", "value", "lo", "hi",
                    F.when(F.col("whole"), F.col("found")).alias("violations"),
                    F.when(F.col("whole"), by_sensor).otherwise(by_key).alias("status"))
