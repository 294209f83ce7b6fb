"""The strict JSON reader against Python's, and the one reading of payloads that scoring and limits share."""

import json

import pytest

from millwright import schema as S
from millwright.functions import json as J
from millwright.operators import quality
from millwright.operators import requests as RQ

OK = '{"RPM": 1500, "Torque": 45, "Wear": 220, "AirTemp": 298, "ProcessTemp": 308, "Type": "M"}'
TEXTS = [
    OK, OK + " xx", OK + OK, OK + ",", OK + "], [", OK + "\n\t ", "  " + OK, '{"RPM": 1, "RPM": 2}', '{"RPM": 1, "RPM": null}',
    '{"RPM": null}', "{}", "[]", "[1, 2]", "null", "true", "5", '"RPM"', "", "   ", None, "not json", '{"RPM": 01}', '{"RPM": 1,}',
    "{RPM: 1}", '{"RPM": "a\\u0041\\n"}', '{"RPM": "x\ny"}', '{"a": {"RPM": 3}, "RPM": [1, {"b": 2}]}', '{"end": "x"}, {"end": "x"}',
    '{"RPM": 1} // no', '{"RPM": 1e3, "RPM": 2.50}', '{"é": 1, "RPM": "ß"}', "{", '{"RPM"}', '{"": 4}', '[{"end": 1}]', "{}{}", "1 2",
]


def _python(text):
    """(is JSON, object or None) by Python's own parser."""
    try:
        v = json.loads(text)
    except (ValueError, TypeError):
        return False, None
    return True, v if isinstance(v, dict) else None


def test_reader_agrees_with_python(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    keys = ["RPM", "a", "é", "", "end"]
    read = J.read_objects(df, df.t).select(
        "i", J.is_json().alias("ok"), J.is_object().alias("obj"), J.object_size().alias("n"),
        *[x for j, k in enumerate(keys) for x in (J.has_key(k).alias(f"has{j}"), J.raw_value(k).alias(f"raw{j}"))])
    for r in read.collect():
        ok, obj = _python(TEXTS[r.i])
        assert (r.ok, r.obj) == (ok, obj is not None), TEXTS[r.i]
        for j, k in enumerate(keys):
            assert r[f"has{j}"] == (k in (obj or {})), (TEXTS[r.i], k)
            value, raw = (obj or {}).get(k), r[f"raw{j}"]
            if isinstance(value, str):
                assert raw == value
            else:
                assert (None if raw is None else json.loads(raw)) == value, (TEXTS[r.i], k)


def test_rest_after_the_object_and_repeated_keys_in_both_readers(spark):
    texts = ['{"RPM": 1500} xx', '{"RPM": 1, "RPM": 1500}', '{"RPM": 1500, "RPM": "no"}', "{'RPM': 1500}", "{}", '{"Other": 1}']
    df = spark.createDataFrame(list(enumerate(texts)), "request_id long, payload string")
    limits = spark.createDataFrame([(c, S.SENSOR_LONG_NAMES[c], 1000.0, 2000.0, 3) for c in S.SENSORS],
                                   "sensor string, sensor_name string, lo double, hi double, violations long")
    status = {r.request_id: r.status for r in RQ.validate_requests(df).collect()}
    assert status == {0: "malformed", 1: "missing", 2: "missing", 3: "missing", 4: "missing", 5: "missing"}
    rows = {}
    for r in quality.check_limits(df, limits).collect():
        rows.setdefault(r.request_id, []).append((r.key, r.status))
    whole = [(None, "3 violations")] * 5
    assert rows == {0: whole, 1: [("RPM", "OK")], 2: [("RPM", "INVALID")], 3: [("RPM", "OK")], 4: whole}


def test_a_repeated_key_gives_its_last_value(spark):
    df = spark.createDataFrame([(1, OK.replace('"Torque": 45', '"Torque": "x", "Torque": 46'))], "request_id long, payload string")
    [r] = RQ.validate_requests(df).collect()
    assert (r.status, r.torque_nm) == ("scored", 46.0)


def test_one_parse_a_row_with_a_filter_above(spark):
    """A filter on the status stays above the parse: the plan reads JSON in one projection only."""
    df = spark.createDataFrame([(1, OK)], "request_id long, payload string")
    plan = RQ.validate_requests(df).where("status = 'scored'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(MapType") + plan.count("from_json(ArrayType(MapType") == 1, plan


@pytest.mark.parametrize("text", [OK, OK.replace("45", "45.5"), OK.replace('"M"', '" large "')])
def test_scored(spark, text):
    [r] = RQ.validate_requests(spark.createDataFrame([(1, text)], "request_id long, payload string")).collect()
    assert r.status == "scored"
