from pyspark.sql import functions as F

from conftest import readings_df
from millwright.operators import fleet


def test_thresholds_fallback_and_degenerate(spark):
    df = readings_df(spark, [(1500, 40, 7, 300, 310, "L")] * 5)
    th = fleet.maintenance_thresholds(df).first()
    assert (th.high, th.urgent, th.method) == (7.0, 8.0, "quantile")
    empty = df.withColumn("tool_wear_min", F.lit(None).cast("double"))
    th = fleet.maintenance_thresholds(empty).first()
    assert (th.high, th.urgent, th.method) == (150.0, 200.0, "fallback")
    sched = {r.tier: r.units for r in fleet.maintenance_schedule(empty).collect()}
    assert sched == {"URGENT": 0, "HIGH": 0, "ROUTINE": 0}


def test_schedule_counts_sum_to_non_null_rows(spark):
    from millwright.sources.readings import readings_from_lineitem

    r = readings_from_lineitem(spark, "/root/testdata/sf0.001")
    s = fleet.maintenance_schedule(r).collect()
    assert sum(x.units for x in s) == r.where(F.col("tool_wear_min").isNotNull()).count()
    th = fleet.maintenance_thresholds(r).first()
    assert (th.high, th.urgent) == (110.0, 180.0)


def test_kpis_and_patterns_counts(spark):
    from millwright.sources.readings import readings_from_lineitem

    r = readings_from_lineitem(spark, "/root/testdata/sf0.01")
    k = fleet.kpis(r).first()
    assert (k.total_operations, k.failures) == (60000, 10692)
    p = [(x.mode, x["count"]) for x in fleet.patterns(r).collect()]
    assert p == [("PWF", 7421), ("HDF", 3000), ("TWF", 436), ("OSF", 344), ("RNF", 61)]
    st = {x.sensor: x for x in fleet.statistical_summary(r).collect()}
    assert round(st["torque_nm"].mean, 4) == 40.9591 and round(st["torque_nm"].std, 4) == 10.4277


def test_feature_profile_single_row_std(spark):
    df = readings_df(spark, [(1500, 40, 7, 300, 310, "L")])
    prof = {x.feature: x for x in fleet.feature_profile(df).collect()}
    assert prof["rpm"].std == 1e-9
