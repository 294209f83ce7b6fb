"""Real files with reordered, extra and absent columns, and the fleet operators on what is absent."""

from millwright import schema as S
from millwright.operators import fleet
from millwright.sources.readings import load_readings

HEADERS = list(S.CSV_COLUMNS)
ROW = dict(zip(HEADERS, ["7", "M14", "M", "298.1", "308.6", "1551", "42.8", "0", "0", "0", "0", "0", "0", "0"]))


def _csv(path, headers, *rows):
    path.write_text("\n".join([",".join(headers), *(",".join(r.get(h, "x") for h in headers) for r in rows)]) + "\n")
    return str(path)


def test_csv_in_file_order(spark, tmp_path):
    r = load_readings(spark, _csv(tmp_path / "a.csv", HEADERS, ROW, ROW | {"Torque [Nm]": "42.8d"})).collect()
    assert r[0].asDict() == {
        S.UDI: 7, S.PRODUCT_ID: "M14", S.TYPE: "M", S.AIR: 298.1, S.PROCESS: 308.6, S.RPM: 1551.0, S.TORQUE: 42.8,
        S.WEAR: 0.0, S.LABEL: 0, **dict.fromkeys(S.MODE_COLS, 0),
    }
    assert r[1][S.TORQUE] is None


def test_csv_reordered_extra_and_absent(spark, tmp_path):
    headers = ["line.no", *reversed([h for h in HEADERS if h not in ("Tool wear [min]", "RNF", "Torque [Nm]")])]
    df = load_readings(spark, _csv(tmp_path / "b.csv", headers, ROW, ROW | {"Rotational speed [rpm]": "1400"}))
    assert S.WEAR not in df.columns and df.select("`line.no`").first()[0] == "x"
    assert [r[S.RPM] for r in df.orderBy(S.RPM).collect()] == [1400.0, 1551.0]
    present = {S.AIR, S.PROCESS, S.RPM}
    assert {r.sensor for r in fleet.statistical_summary(df, 2).collect()} == present
    assert {r.sensor for r in fleet.operating_limits(df).collect()} == present
    assert {(r.sensor, r.violations) for r in fleet.limit_violations(df).collect()} == {(c, 0) for c in present}
    assert {r.feature for r in fleet.feature_profile(df).collect()} == present
    assert [r["mode"] for r in fleet.patterns(df).collect()] == ["TWF", "HDF", "PWF", "OSF"]
    assert fleet.maintenance_thresholds(df).first().asDict() == {"high": 150.0, "urgent": 200.0, "method": "fallback"}
    assert {r.units for r in fleet.maintenance_schedule(df).collect()} == {0}
    assert {r.tier for r in fleet.maintenance_tier(df).collect()} == {None}
    assert fleet.dataset_profile(df).first()[f"{S.WEAR}_max"] == 0.0


def test_parquet_with_header_names(spark, tmp_path):
    text = spark.createDataFrame([tuple(ROW.values())], HEADERS)
    text.write.parquet(str(tmp_path / "c"))
    r = load_readings(spark, str(tmp_path / "c"), "parquet").first()
    assert r[S.UDI] == 7 and r[S.AIR] == 298.1 and r[S.LABEL] == 0
