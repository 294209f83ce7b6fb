"""Registered queries: calibration, ECDF risk, failure modes."""

from __future__ import annotations

from pyspark.sql import functions as F

from millwright import schema as S
from millwright.operators import risk as RK
from millwright.operators import rules
from millwright.operators.state import FittedState
from millwright.plans.registry import fitted, register, round_doubles
from millwright.plans.sql import READINGS_EVENTS, READINGS_LINEITEM, with_readings
from millwright.sources.readings import readings_from_events, readings_from_lineitem

def fitted_model(spark, sf_dir: str) -> RK.RiskModel:
    """Risk model of the lineitem readings, from the session's store."""
    return fitted(spark, sf_dir, "risk", lambda: FittedState(risk=RK.fit_risk_model(readings_from_lineitem(spark, sf_dir)))).risk


# Calibration in SQL: one SELECT per part over the violating readings.
def _cal_sql(src: str = "readings") -> str:
    return f"""
 SELECT udi, 'twf' AS part, '' AS type, tool_wear_min - 200e0 AS value FROM {src} WHERE tool_wear_min > 200
 UNION ALL SELECT udi, 'hdf_temp', '', 86e-1 - (process_temp_k - air_temp_k) FROM {src}
   WHERE process_temp_k - air_temp_k < 86e-1 AND rpm < 1380
 UNION ALL SELECT udi, 'hdf_rpm', '', 1380e0 - rpm FROM {src} WHERE process_temp_k - air_temp_k < 86e-1 AND rpm < 1380
 UNION ALL SELECT udi, 'pwf_low', '', 3500e0 - torque_nm * rpm * pi() / 30e0 FROM {src}
   WHERE torque_nm * rpm * pi() / 30e0 < 3500e0
 UNION ALL SELECT udi, 'pwf_high', '', torque_nm * rpm * pi() / 30e0 - 9000e0 FROM {src}
   WHERE torque_nm * rpm * pi() / 30e0 > 9000e0
 UNION ALL SELECT udi, 'osf', type, tool_wear_min * torque_nm - lim FROM (
   SELECT *, CASE type WHEN 'L' THEN 11000e0 WHEN 'M' THEN 12000e0 WHEN 'H' THEN 13000e0 END AS lim FROM {src}) o
   WHERE tool_wear_min * torque_nm > lim"""


_MODES_SQL = """
 SELECT udi, 'TWF' AS mode, cume_dist() OVER (ORDER BY tool_wear_min - 200e0) * 100e0 AS risk,
   printf('Tool wear %.1f min exceeds 200 min threshold', tool_wear_min) AS trigger
   FROM readings WHERE tool_wear_min > 200
 UNION ALL
 SELECT udi, 'HDF', (cume_dist() OVER (ORDER BY 86e-1 - (process_temp_k - air_temp_k)) * 100e0
                    + cume_dist() OVER (ORDER BY 1380e0 - rpm) * 100e0) / 2e0,
   printf('Temp diff %.1fK < 8.6K AND RPM %.0f < 1380', process_temp_k - air_temp_k, rpm)
   FROM readings WHERE process_temp_k - air_temp_k < 86e-1 AND rpm < 1380
 UNION ALL
 SELECT udi, 'PWF', cume_dist() OVER (PARTITION BY p < 3500e0
                    ORDER BY CASE WHEN p < 3500e0 THEN 3500e0 - p ELSE p - 9000e0 END) * 100e0,
   printf('Power %.0fW outside 3500-9000W range', p)
   FROM (SELECT udi, torque_nm * rpm * pi() / 30e0 AS p FROM readings) x WHERE p < 3500e0 OR p > 9000e0
 UNION ALL
 SELECT udi, 'OSF', cume_dist() OVER (PARTITION BY type ORDER BY o - lim) * 100e0,
   printf('Wear×Torque %.0f minNm exceeds type %s limit %d', o, type, CAST(lim AS INTEGER))
   FROM (SELECT udi, type, tool_wear_min * torque_nm AS o,
           CASE type WHEN 'L' THEN 11000e0 WHEN 'M' THEN 12000e0 WHEN 'H' THEN 13000e0 END AS lim FROM readings) y
   WHERE o > lim"""


@register("risk_calibration", with_readings(
    f"SELECT part, type, round(value, 4) AS value FROM ({_cal_sql()}) c"))
def q_risk_calibration(spark, sf_dir):
    return round_doubles(rules.risk_calibration(readings_from_lineitem(spark, sf_dir)))


@register("ecdf_risk", with_readings(f"""
SELECT udi, part, type, round(value, 4) AS value,
  round(cume_dist() OVER (PARTITION BY part, type ORDER BY value) * 100e0, 4) AS risk FROM ({_cal_sql()}) c"""))
def q_ecdf_risk(spark, sf_dir):
    r = readings_from_lineitem(spark, sf_dir)
    return round_doubles(RK.calibration_risk(r, fitted_model(spark, sf_dir), exact=True))


@register("ecdf_lookup", f"""
WITH hist AS ({READINGS_LINEITEM}), new AS ({READINGS_EVENTS}),
 k AS (SELECT DISTINCT part, type, value, cume_dist() OVER (PARTITION BY part, type ORDER BY value) AS cd
       FROM ({_cal_sql('hist')}) c),
 q AS ({_cal_sql('new')})
SELECT q.udi, q.part, q.type, round(q.value, 4) AS value, round(coalesce(k.cd, 0) * 100e0, 4) AS risk
FROM q ASOF LEFT JOIN k ON q.part = k.part AND q.type = k.type AND q.value >= k.value""")
def q_ecdf_lookup(spark, sf_dir):
    """Readings of new machines (events) scored against the fleet's calibration (line items)."""
    new = readings_from_events(spark, sf_dir)
    return round_doubles(RK.calibration_risk(new, fitted_model(spark, sf_dir), exact=False))


@register("hdf_risk", with_readings("""
SELECT udi, round(86e-1 - (process_temp_k - air_temp_k), 4) AS temp_margin, 1380e0 - rpm AS rpm_margin,
  round(cume_dist() OVER (ORDER BY 86e-1 - (process_temp_k - air_temp_k)) * 100e0, 4) AS risk_temp,
  round(cume_dist() OVER (ORDER BY 1380e0 - rpm) * 100e0, 4) AS risk_rpm,
  round((cume_dist() OVER (ORDER BY 86e-1 - (process_temp_k - air_temp_k)) * 100e0
        + cume_dist() OVER (ORDER BY 1380e0 - rpm) * 100e0) / 2e0, 4) AS risk
FROM readings WHERE process_temp_k - air_temp_k < 86e-1 AND rpm < 1380"""))
def q_hdf_risk(spark, sf_dir):
    """Both parts of each HDF reading, folded back to a row (one lookup)."""
    parts = RK.mode_parts(readings_from_lineitem(spark, sf_dir), [S.UDI]).where("mode = 'HDF'")
    h = RK.fold_parts(RK.lookup_parts(parts, fitted_model(spark, sf_dir), exact=True), [S.UDI])
    return round_doubles(h.select(S.UDI, F.col("value").alias("temp_margin"), F.col("other").alias("rpm_margin"),
                                  F.col("risk").alias("risk_temp"), F.col("other_risk").alias("risk_rpm"), RK.mean_risk().alias("risk")))


@register("pwf_risk", with_readings("""
SELECT udi, CASE WHEN p < 3500e0 THEN 'pwf_low' ELSE 'pwf_high' END AS part,
  round(CASE WHEN p < 3500e0 THEN 3500e0 - p ELSE p - 9000e0 END, 4) AS power_excess,
  round(cume_dist() OVER (PARTITION BY p < 3500e0 ORDER BY CASE WHEN p < 3500e0 THEN 3500e0 - p ELSE p - 9000e0 END)
        * 100e0, 4) AS risk
FROM (SELECT udi, torque_nm * rpm * pi() / 30e0 AS p FROM readings) x WHERE p < 3500e0 OR p > 9000e0"""))
def q_pwf_risk(spark, sf_dir):
    m = fitted_model(spark, sf_dir)
    p = rules.rule_pwf(readings_from_lineitem(spark, sf_dir)).select(
        S.UDI, F.concat(F.lit("pwf_"), F.col("branch")).alias("part"), "power_excess", F.lit(rules.ANY_TYPE).alias("_t"))
    p = RK.lookup_exact(p, m, "part", "_t", "power_excess", "risk")
    return round_doubles(p.select(S.UDI, "part", "power_excess", "risk"))


@register("osf_risk", with_readings("""
SELECT udi, type, round(o - lim, 4) AS overstrain_excess,
  round(cume_dist() OVER (PARTITION BY type ORDER BY o - lim) * 100e0, 4) AS risk
FROM (SELECT udi, type, tool_wear_min * torque_nm AS o,
        CASE type WHEN 'L' THEN 11000e0 WHEN 'M' THEN 12000e0 WHEN 'H' THEN 13000e0 END AS lim FROM readings) y
WHERE o > lim"""))
def q_osf_risk(spark, sf_dir):
    m = fitted_model(spark, sf_dir)
    o = rules.rule_osf(readings_from_lineitem(spark, sf_dir)).select(
        S.UDI, S.TYPE, "overstrain_excess", F.lit("osf").alias("_p"))
    o = RK.lookup_exact(o, m, "_p", S.TYPE, "overstrain_excess", "risk")
    return round_doubles(o.select(S.UDI, S.TYPE, "overstrain_excess", "risk"))


@register("failure_modes", with_readings(
    f"SELECT udi, mode, round(risk, 4) AS risk, trigger FROM ({_MODES_SQL}) m"))
def q_failure_modes(spark, sf_dir):
    r = readings_from_lineitem(spark, sf_dir)
    fm = RK.failure_modes(r, fitted_model(spark, sf_dir), exact=True)
    return round_doubles(fm.select(S.UDI, "mode", "risk", "trigger"))


@register("failure_mode_summary", with_readings(f"""
SELECT mode, count(*) AS readings, round(avg(risk), 4) AS mean_risk, round(max(risk), 4) AS max_risk,
  CAST(sum(CASE WHEN risk > 70 THEN 1 ELSE 0 END) AS BIGINT) AS red,
  CAST(sum(CASE WHEN risk > 40 AND risk <= 70 THEN 1 ELSE 0 END) AS BIGINT) AS yellow,
  CAST(sum(CASE WHEN risk <= 40 THEN 1 ELSE 0 END) AS BIGINT) AS orange
FROM ({_MODES_SQL}) m GROUP BY mode"""))
def q_failure_mode_summary(spark, sf_dir):
    """Flagship: per mode, violating readings, mean and max empirical risk, and severity counts."""
    r = readings_from_lineitem(spark, sf_dir)
    fm = RK.failure_modes(r, fitted_model(spark, sf_dir), exact=True)
    sev = RK.mode_severity(F.col("risk"))
    out = fm.groupBy("mode").agg(
        F.count(F.lit(1)).alias("readings"), F.avg("risk").alias("mean_risk"), F.max("risk").alias("max_risk"),
        *[F.sum(F.when(sev == s, 1).otherwise(0)).cast("bigint").alias(s) for s in ("red", "yellow", "orange")])
    return round_doubles(out)


@register("mode_severity", with_readings(f"""
SELECT udi, mode, round(risk, 4) AS risk,
  CASE WHEN risk > 70 THEN 'red' WHEN risk > 40 THEN 'yellow' ELSE 'orange' END AS severity
FROM ({_MODES_SQL}) m"""))
def q_mode_severity(spark, sf_dir):
    r = readings_from_lineitem(spark, sf_dir)
    fm = RK.failure_modes(r, fitted_model(spark, sf_dir), exact=True)
    return round_doubles(fm.select(S.UDI, "mode", "risk", RK.mode_severity(F.col("risk")).alias("severity")))
