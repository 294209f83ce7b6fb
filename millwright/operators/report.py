"""The full report of a reading: prediction, risk tier, confidence, failure modes, anomaly, warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright import schema as S
from millwright.functions import expressions as X
from millwright.operators import ml, quality, risk
from millwright.operators.state import FittedState


def mode_line(mode: Column, pct: Column) -> Column:
    return F.concat(mode, F.lit("("), X.fixed(pct, 0), F.lit("%)"))


def score_report(readings: DataFrame, state: FittedState, key: str = "request_id") -> DataFrame:
    """One row per reading (``key``, type and sensors): everything follows from ``state``, nothing is fitted.

    The readings are read twice: for the row-wise part, and for the violated parts of the risk
    lookup, which are stored and met again by ``key``.
    """
    req = readings.select(key, S.TYPE, *S.SENSORS)
    q = quality.reliability_warnings(quality.assess_quality(ml.score(state.suite, req), state.profile))
    pct = F.col("p1") * 100.0
    conf = ml.confidence(F.col("p1"), F.col("prediction"), F.col("confidence_component"))
    base = q.select(key, S.TYPE, *S.SENSORS, "prediction", pct.alias("failure_risk"),
                    ml.risk_tier(pct).alias("status"), conf.alias("confidence"),
                    "anomaly_detected", "anomaly_score",
                    F.concat_ws("; ", "range_warnings").alias("range_warnings"),
                    F.concat_ws("; ", "z_warnings").alias("z_warnings"))
    base = base.select("*", ml.confidence_label(F.col("confidence")).alias("confidence_label"))
    modes = risk.failure_modes(req, state.risk, exact=False, keys=[key])
    per = (modes.groupBy(key)
           .agg(F.sort_array(F.collect_list(F.struct("mode_pos", "mode", "risk"))).alias("_m"))
           .select(key, F.concat_ws(", ", F.transform("_m", lambda m: mode_line(m["mode"], m["risk"]))).alias("failure_modes")))
    return base.join(per, key, "left").select(*base.columns, F.coalesce("failure_modes", F.lit("")).alias("failure_modes"))
