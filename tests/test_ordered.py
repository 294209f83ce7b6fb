import random

import numpy as np
from pyspark.sql import functions as F

from millwright.operators import ordered
from millwright.operators import risk as RK


def _brute_risk(values, x):
    v = np.sort(np.asarray(values, dtype=float))
    if v.size == 0:
        return 0.0
    return float(np.clip(np.searchsorted(v, x, side="right") / v.size * 100.0, 0, 100))


def test_ecdf_example(spark):
    # FIXTURES.md: calibration {1, 2, 2, 5}
    cal = spark.createDataFrame([("twf", "", float(v)) for v in (1, 2, 2, 5)], "part string, type string, value double")
    counts = cal.groupBy("part", "type", "value").count().withColumnRenamed("count", "cnt")
    for rpb in (100, 1):
        bounds = ordered.range_bounds(counts, ["part", "type"], "value", rows_per_bucket=rpb)
        knots = ordered.running_sum(counts, ["part", "type"], "value", "cnt", bounds, "cum")
        knots = knots.selectExpr("part", "type", "value", "cum / 4 * 100 AS risk", "_b")
        probes = spark.createDataFrame([("twf", "", v) for v in (0.5, 1.0, 2.0, 4.0, 5.0, 9.0)],
                                       "part string, type string, value double")
        got = {r.value: r.risk for r in ordered.asof_backward(probes, knots, ["part", "type"], "value", "risk",
                                                               bounds, "risk").collect()}
        assert {k: (v or 0.0) for k, v in got.items()} == {0.5: 0.0, 1.0: 25.0, 2.0: 75.0, 4.0: 75.0, 5.0: 100.0, 9.0: 100.0}


def test_running_sum_multi_bucket_matches_cumsum(spark):
    rnd = random.Random(7)
    rows = [(g, float(v), rnd.randint(1, 5)) for g in ("a", "b", "c") for v in rnd.sample(range(10000), 300)]
    df = spark.createDataFrame(rows, "g string, v double, w int")
    bounds = ordered.range_bounds(df, ["g"], "v", rows_per_bucket=40)
    assert all(len(b) >= 5 for b in bounds.values())
    got = {(r.g, r.v): r.cum for r in ordered.running_sum(df, ["g"], "v", "w", bounds, "cum").collect()}
    for g in ("a", "b", "c"):
        acc = 0
        for _, v, w in sorted(x for x in rows if x[0] == g):
            acc += w
            assert got[(g, v)] == acc


def test_asof_multi_bucket_with_hot_value_matches_brute_force(spark):
    rnd = random.Random(11)
    calib = {p: [rnd.uniform(0, 100) for _ in range(400)] for p in ("x", "y")}
    cal = spark.createDataFrame([(p, "", v) for p, vs in calib.items() for v in vs], "part string, type string, value double")
    readings_like = None  # noqa: F841
    counts = cal.groupBy("part", "type", "value").count().withColumnRenamed("count", "cnt")
    bounds = ordered.range_bounds(counts, ["part", "type"], "value", rows_per_bucket=50)
    knots = ordered.running_sum(counts, ["part", "type"], "value", "cnt", bounds, "cum")
    knots = knots.selectExpr("part", "type", "value", "cum / 400 * 100 AS risk", "_b")
    probes = [(i, p, "", rnd.uniform(-5, 105)) for i, p in enumerate(["x", "y"] * 300)]
    probes += [(1000 + i, "x", "", 42.0) for i in range(500)]  # a hot value
    probes += [(5000, "x", "", None), (5001, None, "", 3.0)]  # NULL keys pass through
    pdf = spark.createDataFrame(probes, "id long, part string, type string, value double")
    out = ordered.asof_backward(pdf, knots, ["part", "type"], "value", "risk", bounds, "risk", probes_per_task=50)
    got = {r.id: r.risk for r in out.collect()}
    assert len(got) == len(probes)
    for i, p, _, v in probes:
        if p is None or v is None:
            assert got[i] is None
        else:
            assert abs((got[i] or 0.0) - _brute_risk(calib[p], v)) < 1e-9, (i, p, v)


def test_fit_risk_model_forced_buckets_equals_single_bucket(spark):
    from millwright.sources.readings import readings_from_lineitem

    r = readings_from_lineitem(spark, "/root/testdata/sf0.001")
    a = RK.fit_risk_model(r)
    b = RK.fit_risk_model(r, rows_per_bucket=30)
    assert b.bounds and not a.bounds
    ka = {(x.part, x.type, x.value): x.cum for x in a.knots.collect()}
    kb = {(x.part, x.type, x.value): x.cum for x in b.knots.collect()}
    assert ka == kb
    ra = sorted((x.udi, x.part, x.risk) for x in RK.calibration_risk(r, a, exact=True).collect())
    rb = sorted((x.udi, x.part, x.risk) for x in RK.calibration_risk(r, b, exact=False).collect())
    assert ra == rb


def test_ten_thousand_buckets(spark):
    """Boundaries by two levels: the generated code and the driver hold no more than a number for each bucket."""
    rnd = random.Random(5)
    values = sorted({rnd.uniform(-1e6, 1e6) for _ in range(30_000)})
    df = spark.createDataFrame([("g", v, 1) for v in values] + [("small", 1.0, 1)], "g string, v double, w int")
    bounds = ordered.range_bounds(df, ["g"], "v", rows_per_bucket=3)
    assert list(bounds) == [("g",)] and 9_000 < len(bounds[("g",)]) < 10_000 and set(bounds[("g",)]) <= set(values)
    bucket = ordered.bucket_column(["g"], "v", bounds)
    sizes = [r["count"] for r in df.select(bucket.alias("b")).groupBy("b").count().collect()]
    assert max(sizes) <= 8 and len(sizes) > 9_000
    plan = df.select(bucket.alias("b"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CASE WHEN") < 400
    got = {r.v: r.cum for r in ordered.running_sum(df, ["g"], "v", "w", bounds, "cum").where("g = 'g'").collect()}
    assert got == {v: i + 1 for i, v in enumerate(values)}
    knots = df.where("g = 'g'").select("g", "v", F.col("v").alias("hit"), bucket.alias("_b"))
    probes = [(i, "g", rnd.uniform(-1.1e6, 1.1e6)) for i in range(2000)]
    out = ordered.asof_backward(spark.createDataFrame(probes, "id long, g string, v double"), knots, ["g"], "v", "hit", bounds, "found")
    array = np.array(values)
    for r in out.collect():
        at = np.searchsorted(array, probes[r.id][2], side="right")
        assert r.found == (values[at - 1] if at else None)
