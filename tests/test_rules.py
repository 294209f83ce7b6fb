from pyspark.sql import functions as F

from conftest import readings_df
from millwright.operators import risk as RK
from millwright.operators import rules

# FIXTURES.md golden rows: rpm, torque, wear, air, process, type -> modes
GOLDEN = [
    ((1500, 45, 210, 298, 308, "M"), ["TWF"]),
    ((1200, 60, 230, 295, 302, "H"), ["TWF", "HDF", "OSF"]),
    ((2000, 50, 180, 300, 310, "L"), ["PWF"]),
    ((1500, 45, 220, 298, 308, "M"), ["TWF"]),
    ((1379, 30, 200, 300, 308.5, "L"), ["HDF"]),
    ((1380, 30, 200, 300, 308.5, "L"), []),
]


def test_golden_modes_and_triggers(spark):
    df = readings_df(spark, [g[0] for g in GOLDEN])
    model = RK.fit_risk_model(df)
    fm = RK.failure_modes(df, model, exact=False).select("udi", "mode", "mode_pos", "risk", "trigger").collect()
    got = {}
    for r in sorted(fm, key=lambda r: (r.udi, r.mode_pos)):
        got.setdefault(r.udi, []).append(r.mode)
        assert 0.0 <= r.risk <= 100.0
    for i, (_, modes) in enumerate(GOLDEN):
        assert got.get(i, []) == modes, i
    trig = {(r.udi, r.mode): r.trigger for r in fm}
    assert trig[(0, "TWF")] == "Tool wear 210.0 min exceeds 200 min threshold"
    assert trig[(2, "PWF")] == "Power 10472W outside 3500-9000W range"
    assert trig[(1, "OSF")] == "Wear×Torque 13800 minNm exceeds type H limit 13000"
    assert trig[(4, "HDF")] == "Temp diff 8.5K < 8.6K AND RPM 1379 < 1380"


def test_exact_and_asof_lookup_agree_on_fitting_rows(spark):
    df = readings_df(spark, [g[0] for g in GOLDEN] * 3)
    model = RK.fit_risk_model(df)
    a = {(r.udi, r.mode): r.risk for r in RK.failure_modes(df, model, exact=True).collect()}
    b = {(r.udi, r.mode): r.risk for r in RK.failure_modes(df, model, exact=False).collect()}
    assert a == b


def test_unknown_type_skips_only_osf(spark):
    df = readings_df(spark, [(1200, 60, 230, 295, 302, "X")])
    modes = [r.mode for r in RK.failure_modes(df, RK.fit_risk_model(df)).collect()]
    assert sorted(modes) == ["HDF", "TWF"]


def test_null_sensor_gives_no_mode(spark):
    df = readings_df(spark, [(1200, 60, 230, 295, 302, "H")]).withColumn("tool_wear_min", F.lit(None).cast("double"))
    cal = rules.risk_calibration(df).collect()
    assert {r.part for r in cal} == {"hdf_temp", "hdf_rpm"}


def test_float_boundary_kept(spark):
    # 306.9 - 298.3 = 8.599999999999966 < 8.6 in double arithmetic
    df = readings_df(spark, [(1300, 40, 10, 298.3, 306.9, "L")])
    assert [r.part for r in rules.risk_calibration(df).collect()][:1] == ["hdf_temp"]
