"""Registered queries: request parsing and validation, routing, quality and limit checks, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from millwright import schema as S
from millwright.operators import fleet, metrics, quality
from millwright.operators import requests as RQ
from millwright.plans.registry import register, round_doubles
from millwright.plans.sql import READINGS_LINEITEM, requests_sql, validated_sql, with_readings
from millwright.sources.readings import readings_from_lineitem
from millwright.sources.requests import TURN_ROUTES, requests_from_events, user_turns, validated_requests

_SENSORS = ", ".join(S.SENSORS)
_R4 = ", ".join(f"round({c}, 4) AS {c}" for c in S.SENSORS)


@register("parse_requests", f"""
SELECT request_id, malformed, has_rpm, has_torque, has_wear, has_airtemp, has_processtemp, has_type, raw_type
FROM ({validated_sql()}) v""")
def q_parse_requests(spark, sf_dir):
    p = RQ.parse_requests(requests_from_events(spark, sf_dir))
    return p.select("request_id", "malformed", "has_rpm", "has_torque", "has_wear", "has_airtemp",
                    "has_processtemp", "has_type", "raw_type")


@register("validate_requests", f"""
SELECT request_id, status, missing, invalid, type, {_R4} FROM ({validated_sql()}) v""")
def q_validate_requests(spark, sf_dir):
    v = validated_requests(spark, sf_dir)
    return round_doubles(v.select("request_id", "status", "missing", "invalid", S.TYPE, *S.SENSORS))


@register("normalize_type", f"SELECT request_id, raw_type, type FROM ({validated_sql()}) v")
def q_normalize_type(spark, sf_dir):
    p = RQ.parse_requests(requests_from_events(spark, sf_dir))
    return p.select("request_id", "raw_type", RQ.X.normalize_type(F.col("raw_type")).alias(S.TYPE))


_ROUTE_SQL = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + f" THEN '{tool}'"
    for words, tool in TURN_ROUTES) + " END"


@register("route_requests", f"""
SELECT coalesce({_ROUTE_SQL}, 'none') AS tool, count(*) AS requests FROM conversations WHERE role = 'user' GROUP BY 1""")
def q_route_requests(spark, sf_dir):
    """The user's turns by the tool that their words call for."""
    return RQ.route_requests(user_turns(spark, sf_dir), "text", TURN_ROUTES)


@register("dedup_tool_calls", f"""
SELECT conv_id, tool, min(turn) AS turn, arg_min(text, turn) AS text
FROM (SELECT conv_id, turn, text, {_ROUTE_SQL} AS tool FROM conversations WHERE role = 'user') c
WHERE tool IS NOT NULL GROUP BY conv_id, tool""")
def q_dedup_tool_calls(spark, sf_dir):
    """Tool calls of each conversation in the order of its turns; first call per tool kept."""
    calls = user_turns(spark, sf_dir).select("conv_id", "turn", "text", RQ.route_column(F.col("text"), TURN_ROUTES).alias("tool"))
    calls = calls.where(F.col("tool").isNotNull())
    return RQ.dedup_tool_calls(calls, "conv_id", "turn", "tool").select("conv_id", "tool", "turn", "text")


# --- limits and input quality against the fleet (line-item readings) ------

_LIM_SQL = "\nUNION ALL\n".join(
    f"SELECT {i} AS pos, '{c}' AS sensor, '{S.SENSOR_LONG_NAMES[c]}' AS sensor_name, round(min({c}), 2) AS lo, "
    f"round(max({c}), 2) AS hi FROM hist" for i, c in enumerate(S.SENSORS))
_KEYMAP = "CASE " + " ".join(f"WHEN key = '{k}' THEN '{c}'" for k, c in S.LIMIT_KEYS.items()) + " " + " ".join(
    f"WHEN key = '{n}' THEN '{c}'" for c, n in S.SENSOR_LONG_NAMES.items()) + " END"


_VIOLATIONS_SQL = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS sensor, count(*) AS violations FROM hist, lim "
    f"WHERE lim.sensor = '{c}' AND (hist.{c} < lim.lo OR hist.{c} > lim.hi)" for c in S.SENSORS)


@register("check_limits", f"""
WITH hist AS ({READINGS_LINEITEM}), lim AS ({_LIM_SQL}), viol AS ({_VIOLATIONS_SQL}),
 kv AS (SELECT request_id, key, json_extract_string(j, '$."' || key || '"') AS raw FROM (
   SELECT request_id, j, unnest(json_keys(j)) AS key FROM (
     SELECT request_id, CASE WHEN json_valid(t) AND json_type(t) = 'OBJECT' THEN t END AS j
     FROM (SELECT request_id, replace(payload, '''', '"') AS t FROM ({requests_sql()}) q) a) b WHERE j IS NOT NULL) c),
 m AS (SELECT request_id, key, {_KEYMAP} AS sensor,
   CASE WHEN isnan(TRY_CAST(raw AS DOUBLE)) THEN NULL ELSE TRY_CAST(raw AS DOUBLE) END AS value FROM kv)
SELECT m.request_id, m.key, m.sensor, lim.sensor_name, m.value, lim.lo, lim.hi,
  CASE WHEN m.value IS NULL THEN 'INVALID' WHEN lim.lo <= m.value AND m.value <= lim.hi THEN 'OK'
       ELSE 'OUT OF RANGE' END AS status
FROM m JOIN lim ON lim.sensor = m.sensor
UNION ALL
SELECT q.request_id, NULL, lim.sensor, lim.sensor_name, NULL, lim.lo, lim.hi,
  CASE WHEN viol.violations = 0 THEN 'OK' ELSE viol.violations || ' violations' END
FROM ({requests_sql()}) q, lim JOIN viol ON viol.sensor = lim.sensor
WHERE q.request_id NOT IN (SELECT request_id FROM kv)""")
def q_check_limits(spark, sf_dir):
    limits = fleet.limit_violations(readings_from_lineitem(spark, sf_dir))
    return quality.check_limits(requests_from_events(spark, sf_dir), limits).drop("violations")  # told by the status


def _profile_sql(src: str = "hist") -> str:
    return ", ".join(
        f"(SELECT min({c}) FROM {src}) AS {c}_min, (SELECT max({c}) FROM {src}) AS {c}_max, "
        f"(SELECT avg({c}) FROM {src}) AS {c}_mean, "
        f"(SELECT CASE WHEN stddev_samp({c}) > 0 THEN stddev_samp({c}) ELSE 1e-9 END FROM {src}) AS {c}_std"
        for c in S.SENSORS)


_QUALITY_BASE = f"""
WITH hist AS ({READINGS_LINEITEM}), prof AS (SELECT {_profile_sql()}),
 v AS (SELECT * FROM ({validated_sql()}) x WHERE status = 'scored'),
 z AS (SELECT v.request_id, {", ".join(f"v.{c}" for c in S.SENSORS)},
   {", ".join(f"(v.{c} - prof.{c}_mean) / prof.{c}_std AS z_{c}" for c in S.SENSORS)},
   {" + ".join(f"CASE WHEN v.{c} < prof.{c}_min OR v.{c} > prof.{c}_max THEN 1 ELSE 0 END" for c in S.SENSORS)} AS n_oor,
   {", ".join(f"prof.{c}_min, prof.{c}_max" for c in S.SENSORS)}
   FROM v, prof),
 q AS (SELECT *, greatest({", ".join(f"abs(z_{c})" for c in S.SENSORS)}) AS max_abs_z,
   {" + ".join(f"CASE WHEN abs(z_{c}) >= 3 THEN 1 ELSE 0 END" for c in S.SENSORS)} AS n_high FROM z),
 a AS (SELECT *, 0.6e0 * least(max_abs_z / 4e0, 1e0) + 0.4e0 * CASE WHEN n_oor > 0 THEN 1e0 ELSE 0e0 END AS anomaly_score
   FROM q)"""


def _quality(spark, sf_dir):
    prof = quality.fit_profile(readings_from_lineitem(spark, sf_dir))
    scored = validated_requests(spark, sf_dir).where(F.col("status") == "scored")
    return quality.assess_quality(scored, prof)


@register("out_of_range", _QUALITY_BASE + "\n" + "\nUNION ALL\n".join(
    f"SELECT request_id, '{S.SENSOR_LONG_NAMES[c]}' AS feature, {c} AS value, {c}_min AS min, {c}_max AS max "
    f"FROM z WHERE {c} < {c}_min OR {c} > {c}_max" for c in S.SENSORS))
def q_out_of_range(spark, sf_dir):
    a = _quality(spark, sf_dir)
    return a.select("request_id", F.explode("out_of_range").alias("o")).select("request_id", "o.*")


@register("z_scores", _QUALITY_BASE + f"""
SELECT request_id, {", ".join(f"round(z_{c}, 4) AS z_{c}" for c in S.SENSORS)}, round(max_abs_z, 4) AS max_abs_z,
  CAST(n_high AS INTEGER) AS n_high_z FROM q""")
def q_z_scores(spark, sf_dir):
    a = _quality(spark, sf_dir)
    return round_doubles(a.select("request_id", *[f"z_{c}" for c in S.SENSORS], "max_abs_z",
                                  F.size("high_z").alias("n_high_z")))


@register("anomaly_score", _QUALITY_BASE + """
SELECT request_id, round(max_abs_z, 4) AS max_abs_z, round(anomaly_score, 4) AS anomaly_score,
  (n_oor > 0 OR n_high > 0) AS anomaly_detected,
  round(least(greatest(1e0 - anomaly_score, 0e0), 1e0), 4) AS confidence_component FROM a""")
def q_anomaly_score(spark, sf_dir):
    a = _quality(spark, sf_dir)
    return round_doubles(a.select("request_id", "max_abs_z", "anomaly_score", "anomaly_detected",
                                  "confidence_component"))


@register("neutral_quality", f"""
SELECT request_id, 0e0 AS max_abs_z, 0e0 AS anomaly_score, false AS anomaly_detected, 0.5e0 AS confidence_component,
  '' AS range_warnings, '' AS z_warnings
FROM ({validated_sql()}) v WHERE status = 'scored'""")
def q_neutral_quality(spark, sf_dir):
    """Scoring without a feature profile: the neutral result for every scored request, through the warnings."""
    scored = validated_requests(spark, sf_dir).where(F.col("status") == "scored")
    a = quality.reliability_warnings(quality.assess_quality(scored, None))
    return a.select("request_id", "max_abs_z", "anomaly_score", "anomaly_detected", "confidence_component",
                    F.concat_ws("; ", "range_warnings").alias("range_warnings"),
                    F.concat_ws("; ", "z_warnings").alias("z_warnings"))


@register("reliability_warnings", _QUALITY_BASE + """,
 w AS (""" + "\nUNION ALL\n".join(
    f"SELECT request_id, {i} AS pos, 'r' AS kind, printf('%s=%.2f outside [%.2f, %.2f]', '{S.SENSOR_LONG_NAMES[c]}', "
    f"{c}, {c}_min, {c}_max) AS txt FROM a WHERE {c} < {c}_min OR {c} > {c}_max\n UNION ALL "
    f"SELECT request_id, {i}, 'z', printf('%s z=%.2f', '{S.SENSOR_LONG_NAMES[c]}', z_{c}) FROM a WHERE abs(z_{c}) >= 3"
    for i, c in enumerate(S.SENSORS)) + """)
SELECT a.request_id,
  coalesce((SELECT string_agg(txt, '; ' ORDER BY pos) FROM w WHERE w.request_id = a.request_id AND kind = 'r'), '')
    AS range_warnings,
  coalesce((SELECT string_agg(txt, '; ' ORDER BY pos) FROM w WHERE w.request_id = a.request_id AND kind = 'z'), '')
    AS z_warnings
FROM a""")
def q_reliability_warnings(spark, sf_dir):
    """Every scored request; both texts are empty where nothing is to be warned of."""
    a = quality.reliability_warnings(_quality(spark, sf_dir))
    return a.select("request_id", F.concat_ws("; ", "range_warnings").alias("range_warnings"),
                    F.concat_ws("; ", "z_warnings").alias("z_warnings"))


# --- metrics: the rule set as a predictor of the recorded failure label ----

_RULE_PRED = ("CASE WHEN tool_wear_min > 200 OR (process_temp_k - air_temp_k < 86e-1 AND rpm < 1380) "
              "OR torque_nm * rpm * pi() / 30e0 < 3500e0 OR torque_nm * rpm * pi() / 30e0 > 9000e0 "
              "OR tool_wear_min * torque_nm > CASE type WHEN 'L' THEN 11000e0 WHEN 'M' THEN 12000e0 "
              "WHEN 'H' THEN 13000e0 END THEN 1 ELSE 0 END")


def _rule_predictions(spark, sf_dir):
    from millwright.functions import expressions as X

    r = readings_from_lineitem(spark, sf_dir)
    pred = X.flag(X.any_of([X.twf_rule(), X.hdf_rule(), X.pwf_rule(), X.osf_rule()]))
    return r.select(F.col(S.LABEL).alias("label"), pred.alias("prediction"), F.col(S.WEAR).alias("score"))


_CM_SQL = f"""SELECT CAST(sum(CASE WHEN y = 0 AND p = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
  CAST(sum(CASE WHEN y = 0 AND p = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN y = 1 AND p = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
  CAST(sum(CASE WHEN y = 1 AND p = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp, 0 AS skipped
FROM (SELECT machine_failure AS y, {_RULE_PRED} AS p FROM readings) x"""


@register("confusion_matrix", with_readings(_CM_SQL))
def q_confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(_rule_predictions(spark, sf_dir))


@register("classification_metrics", with_readings(f"""
SELECT tn, fp, fn, tp, round((tp + tn) * 1e0 / (tn + fp + fn + tp), 4) AS accuracy,
  round(CASE WHEN tp + fp > 0 THEN tp * 1e0 / (tp + fp) ELSE 0e0 END, 4) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp * 1e0 / (tp + fn) ELSE 0e0 END, 4) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2e0 * tp / (2e0 * tp + fp + fn) ELSE 0e0 END, 4) AS f1, skipped
FROM ({_CM_SQL}) c"""))
def q_classification_metrics(spark, sf_dir):
    return round_doubles(metrics.classification_metrics(_rule_predictions(spark, sf_dir)))


@register("roc_auc", with_readings("""
WITH h AS (SELECT tool_wear_min AS s, sum(machine_failure) * 1e0 AS pos, sum(1 - machine_failure) * 1e0 AS neg
           FROM readings WHERE tool_wear_min IS NOT NULL GROUP BY 1),
 c AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM h)
SELECT round(sum(pos * (below + neg / 2e0)) / (sum(pos) * sum(neg)), 6) AS roc_auc FROM c"""))
def q_roc_auc(spark, sf_dir):
    """ROC-AUC of tool wear as a failure score."""
    return round_doubles(metrics.roc_auc(_rule_predictions(spark, sf_dir)), 6)
