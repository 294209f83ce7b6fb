"""One lookup pass over narrow rows, exact rounding of trigger texts, absent columns."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import readings_df
from millwright import schema as S
from millwright.functions import expressions as X
from millwright.operators import ordered, risk, rules
from test_ordered import _brute_risk

N = 20_000


def _equal_wear(spark):
    """Every reading violates the wear rule by the same excess."""
    return spark.range(N).selectExpr("id AS udi", "'M' AS type", "300d AS air_temp_k", "310d AS process_temp_k", "1500d AS rpm",
                                     "40d AS torque_nm", "210d AS tool_wear_min")


def test_equal_excesses_are_dealt_evenly(spark):
    model = risk.fit_risk_model(readings_df(spark, [(1500, 40, w, 300, 310, "M") for w in range(201, 260)]))
    old = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        parts = risk.mode_parts(_equal_wear(spark), ["udi"])
        got = risk.lookup_parts(parts, model, exact=False).withColumn("p", F.spark_partition_id())
        sizes = {r.p: r["count"] for r in got.groupBy("p").count().collect()}
        assert got.agg(F.min("risk"), F.max("risk")).first()[:] == (_brute_risk(range(1, 60), 10.0),) * 2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert sum(sizes.values()) == N and len(sizes) == 8
    assert max(sizes.values()) < 2 * N / 8


def test_readings_are_read_once(spark, tmp_path):
    """The as-of lookup scans the readings' files in one job; the passes after it scan narrow stored rows."""
    _equal_wear(spark).write.parquet(str(tmp_path / "r"))
    r = spark.read.parquet(str(tmp_path / "r"))
    model = risk.fit_risk_model(r)
    seen = []
    listener = _Scans(spark, str(tmp_path / "r"), seen)
    with listener:
        assert risk.failure_modes(r, model).count() == N
    assert len(seen) == 1


class _Scans:
    """Notes each executed plan that scans a folder."""

    def __init__(self, spark, folder, seen):
        self.spark, self.folder, self.seen = spark, folder, seen

    def __enter__(self):
        store = self.spark._jsparkSession.sharedState().statusStore()
        runs = store.executionsList()  # only the last ones are retained, so their count is no next number
        self.before = max([runs.apply(i).executionId() + 1 for i in range(runs.size())], default=0)
        return self

    def __exit__(self, *_):
        store = self.spark._jsparkSession.sharedState().statusStore()
        runs = store.executionsList()
        for i in range(runs.size()):
            run = runs.apply(i)
            plan = run.physicalPlanDescription()
            if run.executionId() >= self.before and f"file:{self.folder}" in plan:
                self.seen.append(run.executionId())


def test_modes_equal_brute_force_over_buckets(spark):
    r = random.Random(3)
    rows = [(r.choice([1200, 1379, 1380, 1500, 2900]), r.uniform(3, 76), r.uniform(150, 260), r.uniform(295, 305), r.uniform(303, 313),
             r.choice(["L", "M", "H", "X", None])) for _ in range(300)]
    df = readings_df(spark, rows)
    fit, new = df.where("udi % 2 = 0"), df.where("udi % 2 = 1")
    cal = {}
    for x in rules.risk_calibration(fit).collect():
        cal.setdefault((x.part, x.type), []).append(x.value)
    for rows_per_bucket in (5, 10**6):
        model = risk.fit_risk_model(fit, rows_per_bucket)
        # a repeated reading keeps both rows of each of its modes
        got = risk.failure_modes(new.unionByName(new.where("udi % 4 = 1")), model).collect()
        want = []
        for u, (rpm, tq, wear, air, proc, typ) in enumerate(rows):
            if u % 2 == 0:
                continue
            td, p, o, lim = proc - air, tq * rpm * 3.141592653589793 / 30.0, wear * tq, S.OSF_LIMITS.get(typ)
            here = []
            if wear > 200:
                here.append(("TWF", _brute_risk(cal.get(("twf", ""), []), wear - 200.0)))
            if td < 8.6 and rpm < 1380:
                here.append(("HDF", (_brute_risk(cal.get(("hdf_temp", ""), []), 8.6 - td)
                                     + _brute_risk(cal.get(("hdf_rpm", ""), []), 1380.0 - rpm)) / 2))
            if p < 3500 or p > 9000:
                low = p < 3500
                here.append(("PWF", _brute_risk(cal.get(("pwf_low" if low else "pwf_high", ""), []), 3500.0 - p if low else p - 9000.0)))
            if lim and o > lim:
                here.append(("OSF", _brute_risk(cal.get(("osf", typ), []), o - lim)))
            want += [(u, m, round(x, 9)) for m, x in here] * (2 if u % 4 == 1 else 1)
        assert sorted((x.udi, x.mode, round(x.risk, 9)) for x in got) == sorted(want)


@pytest.mark.parametrize("absent", [*S.SENSORS, S.TYPE])
def test_without_a_column_there_is_no_mode_and_no_calibration(spark, absent):
    df = readings_df(spark, [(1200, 60, 230, 295, 302, "H")] * 3)
    model = risk.fit_risk_model(df)
    less = df.drop(absent)
    assert risk.failure_modes(df, model).count() == 9
    assert risk.failure_modes(less, model).collect() == [] and rules.risk_calibration(less).collect() == []
    assert risk.calibration_risk(less, model, exact=False).collect() == []
    # an empty calibration gives every mode risk 0
    none = risk.fit_risk_model(less)
    assert {x.risk for x in risk.failure_modes(df, none).collect()} == {0.0}


def test_salts_follow_counts(spark):
    ref = spark.createDataFrame([("g", float(v), float(v), 0) for v in range(10)], "g string, v double, rv double, _b int")
    probe = spark.createDataFrame([(i, "g", 5.5) for i in range(3000)] + [(5000, "h", 1.0)], "id long, g string, v double")
    out = ordered.asof_backward(probe, ref, ["g"], "v", "rv", {}, "hit", null_keys=False)
    got = {r.id: r.hit for r in out.collect()}
    assert got == {**{i: 5.0 for i in range(3000)}, 5000: None}


TIES = [0.25, 0.35, 0.125, 0.15, 0.5, 1.5, 2.5, 1e-9, 0.05, 0.95, 0.995, 9.95, 99.95, 1234567.25, 8.05, 8.449999999999989, 0.0, 2.675, 210.0]


def test_fixed_rounds_as_the_exact_value(spark):
    r = random.Random(2)
    values = [s * v for s in (1, -1) for v in [*TIES, *(r.uniform(0, 20000) for _ in range(2000)),
                                               *(r.randrange(10**6) / 20 for _ in range(2000)), *(r.randrange(10**6) / 8 for _ in range(500))]]
    df = spark.createDataFrame([(v,) for v in values if v or str(v) == "0.0"], "v double")
    for x in df.select("v", *[X.fixed(df.v, d).alias(f"d{d}") for d in (0, 1, 2)]).collect():
        assert (x.d0, x.d1, x.d2) == (f"{x.v:.0f}", f"{x.v:.1f}", f"{x.v:.2f}"), x.v


@settings(max_examples=10, deadline=None)
@given(st.lists(st.floats(-(2.0**35), 2.0**35, allow_nan=False), min_size=1, max_size=200))
def test_fixed_any_double(spark, values):
    df = spark.createDataFrame([(v + 0.0,) for v in values], "v double")
    for x in df.select("v", X.fixed(df.v, 1).alias("d1"), X.fixed(df.v, 2).alias("d2")).collect():
        assert (x.d1, x.d2) == (f"{x.v:.1f}", f"{x.v:.2f}"), x.v


def test_null_has_no_text(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert df.select(X.fixed(df.v, 1).alias("t")).first().t is None
