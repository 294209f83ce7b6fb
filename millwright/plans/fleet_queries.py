"""Registered queries: sources, derived columns, rules and fleet aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from millwright import schema as S
from millwright.operators import fleet, rules
from millwright.operators.features import feature_matrix, one_hot_type
from millwright.plans.registry import register, round_doubles
from millwright.plans.sql import with_readings
from millwright.sources.readings import clean_readings, readings_from_lineitem, type_readings

R = readings_from_lineitem

_SENSOR_ROWS = [(i, c, S.SENSOR_LONG_NAMES[c]) for i, c in enumerate(S.SENSORS)]


def _union_sensors(template: str) -> str:
    """One SELECT per sensor joined by UNION ALL; template gets {i} {c} {name}."""
    return "\nUNION ALL\n".join(template.format(i=i, c=c, name=n) for i, c, n in _SENSOR_ROWS)


_MODES = [(0, "TWF"), (1, "HDF"), (2, "PWF"), (3, "OSF"), (4, "RNF")]
_MODE_SUMS = ", ".join(f"CAST(sum({m.lower()}) AS BIGINT) AS {m}" for _, m in _MODES)


def _union_modes(template: str) -> str:
    return "\nUNION ALL\n".join(
        template.format(i=i, m=m, label=S.DIAGNOSIS_LABELS[m]) for i, m in _MODES
    )


# --- sources ---------------------------------------------------------------

@register("load_readings", with_readings("SELECT * FROM readings"))
def q_load_readings(spark, sf_dir):
    """The loader's renaming and typing, on the readings as the text columns of a CSV; ids are numbers here."""
    text = R(spark, sf_dir).select([F.col(c).cast("string").alias(header) for header, c in S.CSV_COLUMNS.items()])
    return type_readings(text).withColumn(S.PRODUCT_ID, F.col(S.PRODUCT_ID).cast("bigint"))


@register("clean_readings", with_readings("""
SELECT udi, CAST(product_id AS VARCHAR) AS product_id, type,
  TRY_CAST(CAST(air_temp_k AS VARCHAR) AS DOUBLE) AS air_temp_k,
  TRY_CAST(CAST(process_temp_k AS VARCHAR) AS DOUBLE) AS process_temp_k,
  CASE WHEN rpm > 1700 THEN NULL ELSE rpm END AS rpm,
  CASE WHEN torque_nm > 65 THEN NULL ELSE torque_nm END AS torque_nm,
  tool_wear_min, twf, hdf, pwf, osf, rnf, machine_failure
FROM readings"""))
def q_clean_readings(spark, sf_dir):
    # Readings as text, with unparsable and NaN values injected, typed again.
    r = R(spark, sf_dir)
    dirty = r.select(
        S.UDI, S.PRODUCT_ID, S.TYPE,
        F.col(S.AIR).cast("string").alias(S.AIR),
        F.col(S.PROCESS).cast("string").alias(S.PROCESS),
        F.when(F.col(S.RPM) > 1700, F.lit("n/a")).otherwise(F.col(S.RPM).cast("string")).alias(S.RPM),
        F.when(F.col(S.TORQUE) > 65, F.lit(float("nan"))).otherwise(F.col(S.TORQUE)).alias(S.TORQUE),
        S.WEAR, *S.MODE_COLS, S.LABEL,
    )
    return clean_readings(dirty)


# --- derived columns and rules --------------------------------------------

@register("derived_features", with_readings("""
SELECT udi, round(process_temp_k - air_temp_k, 4) AS temp_diff,
  round(torque_nm * rpm * pi() / 30e0, 4) AS power_w,
  round(tool_wear_min * torque_nm, 4) AS overstrain,
  CASE type WHEN 'L' THEN 11000e0 WHEN 'M' THEN 12000e0 WHEN 'H' THEN 13000e0 END AS osf_limit
FROM readings"""))
def q_derived_features(spark, sf_dir):
    d = rules.derived_features(R(spark, sf_dir))
    return round_doubles(d.select(S.UDI, "temp_diff", "power_w", "overstrain", "osf_limit"))


@register("rule_twf", with_readings("""
SELECT udi, tool_wear_min, tool_wear_min - 200e0 AS wear_excess FROM readings WHERE tool_wear_min > 200"""))
def q_rule_twf(spark, sf_dir):
    return rules.rule_twf(R(spark, sf_dir)).select(S.UDI, S.WEAR, "wear_excess")


@register("rule_hdf", with_readings("""
SELECT udi, round(process_temp_k - air_temp_k, 4) AS temp_diff,
  round(86e-1 - (process_temp_k - air_temp_k), 4) AS temp_margin, 1380e0 - rpm AS rpm_margin
FROM readings WHERE process_temp_k - air_temp_k < 86e-1 AND rpm < 1380"""))
def q_rule_hdf(spark, sf_dir):
    return round_doubles(rules.rule_hdf(R(spark, sf_dir)).select(S.UDI, "temp_diff", "temp_margin", "rpm_margin"))


@register("rule_pwf", with_readings("""
SELECT udi, round(p, 4) AS power_w, CASE WHEN p < 3500e0 THEN 'low' ELSE 'high' END AS branch,
  round(CASE WHEN p < 3500e0 THEN 3500e0 - p ELSE p - 9000e0 END, 4) AS power_excess
FROM (SELECT udi, torque_nm * rpm * pi() / 30e0 AS p FROM readings) x WHERE p < 3500e0 OR p > 9000e0"""))
def q_rule_pwf(spark, sf_dir):
    return round_doubles(rules.rule_pwf(R(spark, sf_dir)).select(S.UDI, "power_w", "branch", "power_excess"))


@register("rule_osf", with_readings("""
SELECT udi, type, round(o, 4) AS overstrain, lim AS osf_limit, round(o - lim, 4) AS overstrain_excess
FROM (SELECT udi, type, tool_wear_min * torque_nm AS o,
        CASE type WHEN 'L' THEN 11000e0 WHEN 'M' THEN 12000e0 WHEN 'H' THEN 13000e0 END AS lim FROM readings) x
WHERE o > lim"""))
def q_rule_osf(spark, sf_dir):
    return round_doubles(
        rules.rule_osf(R(spark, sf_dir)).select(S.UDI, S.TYPE, "overstrain", "osf_limit", "overstrain_excess"))


@register("one_hot_type", with_readings("""
SELECT udi, type, CASE WHEN type = 'H' THEN 1e0 ELSE 0e0 END AS type_h,
  CASE WHEN type = 'L' THEN 1e0 ELSE 0e0 END AS type_l, CASE WHEN type = 'M' THEN 1e0 ELSE 0e0 END AS type_m
FROM readings"""))
def q_one_hot_type(spark, sf_dir):
    return one_hot_type(R(spark, sf_dir)).select(S.UDI, S.TYPE, *S.ONE_HOT)


@register("feature_matrix", with_readings("""
SELECT udi, coalesce(air_temp_k, 0) AS air_temp_k, coalesce(process_temp_k, 0) AS process_temp_k,
  coalesce(rpm, 0) AS rpm, coalesce(torque_nm, 0) AS torque_nm, coalesce(tool_wear_min, 0) AS tool_wear_min,
  CASE WHEN type = 'H' THEN 1e0 ELSE 0e0 END AS type_h, CASE WHEN type = 'L' THEN 1e0 ELSE 0e0 END AS type_l,
  CASE WHEN type = 'M' THEN 1e0 ELSE 0e0 END AS type_m, coalesce(machine_failure, 0) AS label
FROM readings"""))
def q_feature_matrix(spark, sf_dir):
    return feature_matrix(R(spark, sf_dir)).select(S.UDI, *S.FEATURES, "label")


# --- fleet aggregates ------------------------------------------------------

@register("kpis", with_readings("""
SELECT total_operations, failures, round(failures * 100e0 / total_operations, 4) AS failure_rate,
  round(total_operations * 1e0 / greatest(failures, 1), 4) AS mtbf_ops,
  round(100e0 - failures * 100e0 / total_operations, 4) AS availability
FROM (SELECT count(*) AS total_operations, CAST(sum(machine_failure) AS BIGINT) AS failures FROM readings) k"""))
def q_kpis(spark, sf_dir):
    return round_doubles(fleet.kpis(R(spark, sf_dir)))


@register("kpi_long", with_readings("""
WITH k AS (SELECT count(*) * 1e0 AS n, sum(machine_failure) * 1e0 AS f FROM readings)
SELECT 0 AS pos, 'Total Operations' AS metric, round(n, 4) AS value FROM k UNION ALL
SELECT 1, 'Failures', round(f, 4) FROM k UNION ALL
SELECT 2, 'Failure Rate', round(f * 100e0 / n, 4) FROM k UNION ALL
SELECT 3, 'MTBF', round(n / greatest(f, 1e0), 4) FROM k UNION ALL
SELECT 4, 'Availability', round(100e0 - f * 100e0 / n, 4) FROM k"""))
def q_kpi_long(spark, sf_dir):
    return round_doubles(fleet.kpi_long(R(spark, sf_dir)))


@register("healthy_failed", with_readings("""
SELECT greatest(count(*) - CAST(sum(machine_failure) AS BIGINT), 0) AS healthy,
  CAST(sum(machine_failure) AS BIGINT) AS failed FROM readings"""))
def q_healthy_failed(spark, sf_dir):
    return fleet.healthy_failed(R(spark, sf_dir))


@register("patterns", with_readings(f"""
WITH s AS (SELECT {_MODE_SUMS} FROM readings)
""" + _union_modes("SELECT '{m}' AS mode, {m} AS \"count\", {i} AS pos FROM s")))
def q_patterns(spark, sf_dir):
    return fleet.patterns(R(spark, sf_dir))


@register("pattern_share", with_readings(f"""
WITH s AS (SELECT {_MODE_SUMS} FROM readings), u AS (
""" + _union_modes("SELECT '{m}' AS mode, {m} AS \"count\", {i} AS pos FROM s") + """)
SELECT mode, "count", pos, round("count" * 100e0 / sum("count") OVER (), 4) AS share_pct FROM u"""))
def q_pattern_share(spark, sf_dir):
    return round_doubles(fleet.pattern_share(R(spark, sf_dir)))


@register("diagnosis", with_readings(f"""
WITH s AS (SELECT {_MODE_SUMS} FROM readings)
""" + _union_modes("SELECT '{label}' AS label, '{m}' AS mode, {m} AS \"count\", {i} AS pos FROM s")))
def q_diagnosis(spark, sf_dir):
    return fleet.diagnosis(R(spark, sf_dir))


@register("statistical_summary", with_readings(_union_sensors(
    "SELECT {i} AS pos, '{c}' AS sensor, '{name}' AS sensor_name, round(avg({c}), 4) AS mean, "
    "round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(max({c}), 4) AS max FROM readings")))
def q_statistical_summary(spark, sf_dir):
    return round_doubles(fleet.statistical_summary(R(spark, sf_dir)))


@register("operating_limits", with_readings(_union_sensors(
    "SELECT {i} AS pos, '{c}' AS sensor, '{name}' AS sensor_name, round(min({c}), 2) AS lo, "
    "round(max({c}), 2) AS hi FROM readings")))
def q_operating_limits(spark, sf_dir):
    return fleet.operating_limits(R(spark, sf_dir))


_THRESHOLDS_SQL = """
SELECT CASE WHEN h IS NULL THEN 150e0 ELSE round(h, 2) END AS high,
  CASE WHEN h IS NULL THEN 200e0 WHEN u <= h THEN round(h + 1e0, 2) ELSE round(u, 2) END AS urgent,
  CASE WHEN h IS NULL THEN 'fallback' ELSE 'quantile' END AS method
FROM (SELECT quantile_cont(tool_wear_min, 0.8) AS h, quantile_cont(tool_wear_min, 0.95) AS u FROM readings) q"""


@register("maintenance_thresholds", with_readings(_THRESHOLDS_SQL))
def q_maintenance_thresholds(spark, sf_dir):
    return fleet.maintenance_thresholds(R(spark, sf_dir))


_TIER_SQL = """CASE WHEN tool_wear_min >= th.urgent THEN 'URGENT'
  WHEN tool_wear_min >= th.high AND tool_wear_min < th.urgent THEN 'HIGH'
  WHEN tool_wear_min < th.high THEN 'ROUTINE' END"""


@register("maintenance_tier", with_readings(f"""
WITH th AS ({_THRESHOLDS_SQL})
SELECT r.*, {_TIER_SQL} AS tier FROM readings r, th"""))
def q_maintenance_tier(spark, sf_dir):
    return fleet.maintenance_tier(R(spark, sf_dir))


@register("maintenance_schedule", with_readings(f"""
WITH th AS ({_THRESHOLDS_SQL}),
 c AS (SELECT {_TIER_SQL} AS tier, count(*) AS units FROM readings, th GROUP BY 1),
 t AS (SELECT * FROM (VALUES (0, 'URGENT', '{S.TIER_ACTIONS["URGENT"]}'), (1, 'HIGH', '{S.TIER_ACTIONS["HIGH"]}'),
        (2, 'ROUTINE', '{S.TIER_ACTIONS["ROUTINE"]}')) v(pos, tier, action))
SELECT t.pos, t.tier, coalesce(c.units, 0) AS units, th.high, th.urgent, th.method,
  CASE t.tier WHEN 'URGENT' THEN printf('Tool wear >= %.2f min (%s)', th.urgent,
                    CASE WHEN th.method = 'quantile' THEN 'Q95' ELSE 'fallback' END)
    WHEN 'HIGH' THEN printf('Tool wear >= %.2f and < %.2f min (%s)', th.high, th.urgent,
                    CASE WHEN th.method = 'quantile' THEN 'Q80-Q95' ELSE 'fallback range' END)
    ELSE printf('Tool wear < %.2f min', th.high) END AS condition, t.action
FROM t CROSS JOIN th LEFT JOIN c ON c.tier = t.tier"""))
def q_maintenance_schedule(spark, sf_dir):
    return fleet.maintenance_schedule(R(spark, sf_dir))


_LIMITS_CTE = "lim AS (" + _union_sensors(
    "SELECT {i} AS pos, '{c}' AS sensor, '{name}' AS sensor_name, round(min({c}), 2) AS lo, "
    "round(max({c}), 2) AS hi FROM readings") + ")"


@register("limit_violations", with_readings(f"""
WITH {_LIMITS_CTE}, v AS (""" + _union_sensors(
    "SELECT '{c}' AS sensor, CAST(sum(CASE WHEN {c} < (SELECT lo FROM lim WHERE sensor = '{c}') "
    "OR {c} > (SELECT hi FROM lim WHERE sensor = '{c}') THEN 1 ELSE 0 END) AS BIGINT) AS violations FROM readings")
    + """)
SELECT lim.pos, lim.sensor, lim.sensor_name, lim.lo, lim.hi, coalesce(v.violations, 0) AS violations
FROM lim JOIN v ON v.sensor = lim.sensor"""))
def q_limit_violations(spark, sf_dir):
    return fleet.limit_violations(R(spark, sf_dir))


@register("dataset_profile", with_readings(
    "SELECT count(*) AS total_operations, CAST(sum(machine_failure) AS BIGINT) AS total_failures, "
    + ", ".join(f"CAST(sum({m}) AS BIGINT) AS {m}_count" for m in S.MODE_COLS) + ", "
    + ", ".join(f"round(min({c}), 2) AS {c}_min, round(max({c}), 2) AS {c}_max" for c in S.SENSORS)
    + ", CASE WHEN count(*) > 0 THEN round(sum(machine_failure) * 100e0 / count(*), 2) ELSE 0e0 END AS failure_rate "
    "FROM readings"))
def q_dataset_profile(spark, sf_dir):
    return fleet.dataset_profile(R(spark, sf_dir))


@register("feature_profile", with_readings(_union_sensors(
    "SELECT {i} AS pos, '{c}' AS feature, min({c}) AS min, max({c}) AS max, round(avg({c}), 4) AS mean, "
    "round(CASE WHEN stddev_samp({c}) > 0 THEN stddev_samp({c}) ELSE 1e-9 END, 4) AS std FROM readings "
    "HAVING count({c}) > 0")))
def q_feature_profile(spark, sf_dir):
    return round_doubles(fleet.feature_profile(R(spark, sf_dir)))


@register("patterns_by_type", with_readings(
    "SELECT type, count(*) AS operations, CAST(sum(machine_failure) AS BIGINT) AS failures, "
    + ", ".join(f"CAST(sum({m}) AS BIGINT) AS {m}_count" for m in S.MODE_COLS)
    + ", CAST(grouping(type) AS INTEGER) AS level, "
    "round(sum(machine_failure) * 100e0 / count(*), 4) AS failure_rate FROM readings GROUP BY ROLLUP (type)"))
def q_patterns_by_type(spark, sf_dir):
    return round_doubles(fleet.patterns_by_type(R(spark, sf_dir)))
