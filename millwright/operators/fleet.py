"""Fleet aggregates: KPIs, mode counts, statistics, limits, thresholds and tiers.

Every aggregate here is one scan with partial (map-side) aggregation; the
results are a handful of rows. Small result tables are joined back with an
explicit broadcast only where their size is fixed (one row, or one row per
sensor / tier).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwright import schema as S
from millwright.functions.expressions import literal_table
from millwright.operators import ordered

MODES = ["TWF", "HDF", "PWF", "OSF", "RNF"]


def _isum(c: str, df: DataFrame) -> Column:
    """Sum of an integer flag column as BIGINT; a missing column counts 0."""
    if c in df.columns:
        return F.coalesce(F.sum(F.col(c).cast("bigint")), F.lit(0).cast("bigint"))
    return F.lit(0).cast("bigint")


def _with_sensors(df: DataFrame) -> DataFrame:
    """``df`` with every sensor column; absent ones are all NULL."""
    absent = [c for c in S.SENSORS if c not in df.columns]
    return df.select("*", *[F.lit(None).cast("double").alias(c) for c in absent]) if absent else df


def kpis(df: DataFrame) -> DataFrame:
    """Total operations, failures, failure rate %, MTBF (operations) and availability %."""
    agg = df.agg(F.count(F.lit(1)).alias("total_operations"), _isum(S.LABEL, df).alias("failures"))
    n, f = F.col("total_operations"), F.col("failures")
    rate = F.try_divide(f.cast("double") * F.lit(100.0), n.cast("double"))
    return agg.select(
        n, f,
        rate.alias("failure_rate"),
        F.try_divide(n.cast("double"), F.greatest(f, F.lit(1)).cast("double")).alias("mtbf_ops"),
        (F.lit(100.0) - rate).alias("availability"),
    )


def kpi_long(df: DataFrame) -> DataFrame:
    """KPIs as (metric, value) rows, in display order."""
    k = kpis(df)
    return k.select(
        F.explode(F.array(
            *[F.struct(F.lit(i).alias("pos"), F.lit(name).alias("metric"), F.col(c).cast("double").alias("value"))
              for i, (name, c) in enumerate([
                  ("Total Operations", "total_operations"), ("Failures", "failures"),
                  ("Failure Rate", "failure_rate"), ("MTBF", "mtbf_ops"), ("Availability", "availability")])]
        )).alias("m")
    ).select("m.*")


def _mode_sums(df: DataFrame) -> DataFrame:
    return df.agg(*[_isum(m.lower(), df).alias(m) for m in MODES])


def _unpivot_modes(sums: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    rows = [
        F.struct(F.lit(i).alias("pos"), F.lit(m).alias("mode"),
                 F.lit((labels or {}).get(m, m)).alias("label"), F.col(m).alias("count"))
        for i, m in enumerate(MODES)
    ]
    return sums.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def patterns(df: DataFrame) -> DataFrame:
    """Count per failure-mode column, sorted by count descending (ties keep TWF..RNF order); absent columns are left out."""
    present = [m for m in MODES if m.lower() in df.columns]
    counts = _unpivot_modes(_mode_sums(df)).select("mode", "count", "pos")
    if len(present) < len(MODES):
        counts = counts.where(F.col("mode").isin(present))
    return counts.orderBy(F.desc("count"), "pos")


def pattern_share(df: DataFrame) -> DataFrame:
    """Each mode's share of all mode counts (not of failures), as a percentage.

    The window runs over the five-row result, not over readings.
    """
    p = _unpivot_modes(_mode_sums(df))
    total = F.sum("count").over(Window.partitionBy())
    return p.select(
        "mode", "count", "pos",
        (F.try_divide(F.col("count").cast("double"), total.cast("double")) * 100.0).alias("share_pct"),
    ).orderBy(F.desc("count"), "pos")


def diagnosis(df: DataFrame) -> DataFrame:
    """The five mode counts with their display labels, in TWF..RNF order."""
    return _unpivot_modes(_mode_sums(df), S.DIAGNOSIS_LABELS).select("label", "mode", "count", "pos").orderBy("pos")


def statistical_summary(df: DataFrame, decimals: int | None = None) -> DataFrame:
    """Mean, sample standard deviation, min and max of the sensors that ``df`` has (one scan).

    With ``decimals`` the figures are rounded to as many.
    """
    present = [c for c in S.SENSORS if c in df.columns]
    df = _with_sensors(df)
    figure = F.col if decimals is None else lambda name: F.round(F.col(name), decimals)
    aggs = []
    for c in S.SENSORS:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.stddev_samp(c).alias(f"{c}__std"),
                 F.min(c).alias(f"{c}__min"), F.max(c).alias(f"{c}__max")]
    wide = df.agg(*aggs)
    rows = [
        F.struct(F.lit(i).alias("pos"), F.lit(c).alias("sensor"), F.lit(S.SENSOR_LONG_NAMES[c]).alias("sensor_name"),
                 figure(f"{c}__mean").alias("mean"), figure(f"{c}__std").alias("std"),
                 figure(f"{c}__min").alias("min"), figure(f"{c}__max").alias("max"))
        for i, c in enumerate(S.SENSORS)
    ]
    out = wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return out.where(F.col("sensor").isin(present)) if len(present) < len(S.SENSORS) else out


def operating_limits(df: DataFrame) -> DataFrame:
    """Per sensor with values: dataset min and max rounded to 2 decimals (the operating limits)."""
    df = _with_sensors(df)
    wide = df.agg(*[x for c in S.SENSORS for x in (F.min(c).alias(f"{c}__lo"), F.max(c).alias(f"{c}__hi"))])
    rows = [
        F.struct(F.lit(i).alias("pos"), F.lit(c).alias("sensor"), F.lit(S.SENSOR_LONG_NAMES[c]).alias("sensor_name"),
                 F.round(F.col(f"{c}__lo"), 2).alias("lo"), F.round(F.col(f"{c}__hi"), 2).alias("hi"))
        for i, c in enumerate(S.SENSORS)
    ]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*").where(F.col("lo").isNotNull())


def thresholds_row(df: DataFrame, rows_per_bucket: int = ordered.ROWS_PER_BUCKET) -> dict:
    """``high`` (Q80) and ``urgent`` (Q95) of tool wear and the ``method``, as plain values
    (the reference fixes them once at start).

    Exact, by rank selection (:func:`ordered.exact_quantiles`). ``urgent <= high`` becomes
    ``high + 1``; both are rounded to 2 decimals. Without any wear value the fallback 150 / 200
    is used and ``method`` says so.
    """
    q = ordered.exact_quantiles(_with_sensors(df), S.WEAR, [S.HIGH_QUANTILE, S.URGENT_QUANTILE], rows_per_bucket)
    if q is None:
        return {"high": S.FALLBACK_HIGH, "urgent": S.FALLBACK_URGENT, "method": "fallback"}
    high, urgent = q
    return {"high": round(high, 2), "urgent": round(urgent if urgent > high else high + 1.0, 2), "method": "quantile"}


def maintenance_thresholds(df: DataFrame, rows_per_bucket: int = ordered.ROWS_PER_BUCKET) -> DataFrame:
    """:func:`thresholds_row` as a table of one row."""
    th = thresholds_row(df, rows_per_bucket)
    return literal_table(df.sparkSession, [tuple(th.values())], list(th))


def tier_expr(wear: Column, high: Column, urgent: Column) -> Column:
    """URGENT ``>= urgent``, HIGH ``>= high and < urgent``, ROUTINE ``< high``; NULL wear: no tier."""
    return (F.when(wear >= urgent, "URGENT")
            .when((wear >= high) & (wear < urgent), "HIGH")
            .when(wear < high, "ROUTINE"))


def _as_row(df: DataFrame, thresholds) -> dict:
    if thresholds is None:
        return thresholds_row(df)
    if isinstance(thresholds, DataFrame):
        return thresholds.first().asDict()
    return dict(thresholds)


def maintenance_tier(df: DataFrame, thresholds=None) -> DataFrame:
    """Tier per reading (row-wise) for fitted thresholds (dict, one-row table, or fitted from ``df``)."""
    th = _as_row(df, thresholds)
    wear = F.col(S.WEAR) if S.WEAR in df.columns else F.lit(None).cast("double")
    return df.select("*", tier_expr(wear, F.lit(th["high"]), F.lit(th["urgent"])).alias("tier"))


def maintenance_schedule(df: DataFrame, thresholds=None) -> DataFrame:
    """Units per tier, with condition and action text; empty tiers show 0.

    The tier counts are one scan with a three-group partial aggregate.
    """
    th = _as_row(df, thresholds)
    high, urgent, method = th["high"], th["urgent"], th["method"]
    quantile = method == "quantile"
    spark = df.sparkSession
    tiers = literal_table(spark, [
        (i, tier, words.format(high=high, urgent=urgent, of=S.TIER_RANGES[tier][0 if quantile else 1]), S.TIER_ACTIONS[tier])
        for i, (tier, words) in enumerate(S.TIER_CONDITIONS.items())], ["pos", "tier", "condition", "action"])
    counts = (
        _with_sensors(df).select(tier_expr(F.col(S.WEAR), F.lit(high), F.lit(urgent)).alias("tier"))
        .groupBy("tier").agg(F.count(F.lit(1)).alias("units"))
    )
    return (
        tiers.join(F.broadcast(counts), "tier", "left")
        .select("pos", "tier", F.coalesce("units", F.lit(0).cast("bigint")).alias("units"),
                F.lit(float(high)).alias("high"), F.lit(float(urgent)).alias("urgent"), F.lit(method).alias("method"),
                "condition", "action")
        .orderBy("pos")
    )


def limit_violations(df: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """Per sensor: rows below ``lo`` or above ``hi`` of the (rounded) operating limits.

    Limits default to the dataset's own; pass another snapshot's to compare.
    The bounds, at most a pair for each sensor, are taken as values; every sensor's violations are
    then a conditional sum in one aggregate.
    """
    df = _with_sensors(df)
    lim = limits if limits is not None else operating_limits(df)
    rows = [r.asDict() for r in lim.select("pos", "sensor", "sensor_name", "lo", "hi").collect()]
    if not rows:
        return lim.select("pos", "sensor", "sensor_name", "lo", "hi", F.lit(0).cast("bigint").alias("violations"))
    out = [F.struct(*[F.lit(r[k]).alias(k) for k in ("pos", "sensor", "sensor_name", "lo", "hi")],
                    F.coalesce(F.sum(F.when((F.col(r["sensor"]) < r["lo"]) | (F.col(r["sensor"]) > r["hi"]), 1).otherwise(0)), F.lit(0))
                    .cast("bigint").alias("violations")) for r in rows]
    return df.agg(F.array(*out).alias("rows")).select(F.inline("rows")).orderBy("pos")


def dataset_profile(df: DataFrame) -> DataFrame:
    """Dataset 'domain knowledge' in one scan: n, failures, rate (2 dp), mode counts, sensor ranges."""
    aggs = [F.count(F.lit(1)).alias("total_operations"), _isum(S.LABEL, df).alias("total_failures")]
    aggs += [_isum(m.lower(), df).alias(f"{m.lower()}_count") for m in MODES]
    for c in S.SENSORS:  # the range of an absent sensor is (0, 0)
        low, high = (F.min(c), F.max(c)) if c in df.columns else (F.lit(0.0), F.lit(0.0))
        aggs += [F.round(low, 2).alias(f"{c}_min"), F.round(high, 2).alias(f"{c}_max")]
    a = df.agg(*aggs)
    rate = F.when(F.col("total_operations") > 0,
                  F.round(F.col("total_failures").cast("double") / F.col("total_operations").cast("double") * 100.0, 2)
                  ).otherwise(F.lit(0.0))
    return a.select("*", rate.alias("failure_rate"))


def feature_profile(df: DataFrame) -> DataFrame:
    """Per sensor: min, max, mean, sample std (std <= 0 or undefined -> 1e-9); sensors without values are left out."""
    df = _with_sensors(df)
    aggs = []
    for c in S.SENSORS:
        aggs += [F.min(c).alias(f"{c}__min"), F.max(c).alias(f"{c}__max"), F.avg(c).alias(f"{c}__mean"),
                 F.stddev_samp(c).alias(f"{c}__std"), F.count(c).alias(f"{c}__n")]
    wide = df.agg(*aggs)
    rows = []
    for i, c in enumerate(S.SENSORS):
        sd = F.col(f"{c}__std")
        rows.append(F.struct(
            F.lit(i).alias("pos"), F.lit(c).alias("feature"),
            F.col(f"{c}__min").alias("min"), F.col(f"{c}__max").alias("max"), F.col(f"{c}__mean").alias("mean"),
            F.when(sd > 0, sd).otherwise(F.lit(S.MIN_STD)).alias("std"), F.col(f"{c}__n").alias("n")))
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*").where(F.col("n") > 0).drop("n")


def healthy_failed(df: DataFrame) -> DataFrame:
    k = kpis(df)
    return k.select(
        F.greatest(F.col("total_operations") - F.col("failures"), F.lit(0).cast("bigint")).alias("healthy"),
        F.col("failures").alias("failed"),
    )


def patterns_by_type(df: DataFrame) -> DataFrame:
    """Failures and mode counts per machine type, with a total row (``type`` NULL, ``level`` 1)."""
    aggs = [F.count(F.lit(1)).alias("operations"), _isum(S.LABEL, df).alias("failures")]
    aggs += [_isum(m.lower(), df).alias(f"{m.lower()}_count") for m in MODES]
    r = df.rollup(S.TYPE).agg(*aggs, F.grouping(S.TYPE).cast("int").alias("level"))
    return r.select(
        "*", (F.col("failures").cast("double") * 100.0 / F.col("operations").cast("double")).alias("failure_rate")
    )
