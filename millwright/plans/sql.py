"""DuckDB oracle SQL building blocks (the fixture readings and request tables).

These strings are the independent SQL statement of each query: the parity
check runs them in DuckDB over the same Parquet tables and compares with the
Spark result.
"""

from __future__ import annotations

# FIXTURES.md recipe, with the source table as a placeholder.
_READINGS = """
SELECT udi, product_id, type, air_temp_k, process_temp_k, rpm, torque_nm, tool_wear_min, twf, hdf, pwf, osf, rnf,
 CASE WHEN twf + hdf + pwf + osf + rnf > 0 THEN 1 ELSE 0 END AS machine_failure{extra} FROM (
 SELECT *, CASE WHEN tool_wear_min > 200 AND k % 3 = 0 THEN 1 ELSE 0 END AS twf,
  CASE WHEN process_temp_k - air_temp_k < 86e-1 AND rpm < 1380 THEN 1 ELSE 0 END AS hdf,
  CASE WHEN torque_nm * rpm * pi() / 30e0 < 3500e0 OR torque_nm * rpm * pi() / 30e0 > 9000e0 THEN 1 ELSE 0 END AS pwf,
  CASE WHEN tool_wear_min * torque_nm > CASE type WHEN 'L' THEN 11000e0 WHEN 'M' THEN 12000e0 ELSE 13000e0 END THEN 1 ELSE 0 END AS osf,
  CASE WHEN k % 1000 = 7 THEN 1 ELSE 0 END AS rnf
 FROM (SELECT udi, product_id, k{extra},
  CASE WHEN k % 10 < 6 THEN 'L' WHEN k % 10 < 9 THEN 'M' ELSE 'H' END AS type,
  2953e-1 + CAST(a % 93 AS DOUBLE) / 10e0 AS air_temp_k,
  2953e-1 + CAST(a % 93 AS DOUBLE) / 10e0 + 79e-1 + CAST((k * 7 + a) % 41 AS DOUBLE) / 10e0 AS process_temp_k,
  CAST(1250 + (k * 31 + a * 17) % 500 AS DOUBLE) AS rpm,
  16e0 + CAST((k * 13 + a) % 51 AS DOUBLE) * 5e-1 + CAST((k + a * 29) % 51 AS DOUBLE) * 5e-1 AS torque_nm,
  CAST((k % 16) * ((k * 5 + a * 3) % 17) AS DOUBLE) AS tool_wear_min
 FROM ({source}) s) t ) u
"""

LINEITEM_SOURCE = """SELECT l_orderkey * 10 + l_linenumber AS udi, l_partkey AS product_id,
       l_orderkey * 7 + l_partkey * 3 + l_linenumber AS k,
       l_suppkey + CAST(l_quantity AS BIGINT) * 11 AS a FROM lineitem"""

EVENTS_SOURCE = """SELECT event_id AS udi, user_id AS product_id, event_id * 7919 + user_id * 3 AS k,
       user_id + CAST(floor(value * 100e0) AS BIGINT) AS a{extra} FROM events"""

READINGS_LINEITEM = _READINGS.format(source=LINEITEM_SOURCE, extra="")
READINGS_EVENTS = _READINGS.format(source=EVENTS_SOURCE.format(extra=""), extra="")
READINGS_EVENTS_TS = _READINGS.format(source=EVENTS_SOURCE.format(extra=", ts"), extra=", ts")


def with_readings(body: str, source: str = "lineitem") -> str:
    """``WITH readings AS (...)`` prefixed to a query body (which may add CTEs after a comma)."""
    r = READINGS_LINEITEM if source == "lineitem" else READINGS_EVENTS
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH readings AS ({r}), {body[5:]}"
    return f"WITH readings AS ({r}) {body}"


# Split order of a reading within its class: first 32 bits of md5(udi), then udi.
SPLIT_HASH = "CAST('0x' || substr(md5(CAST(udi AS VARCHAR)), 1, 8) AS BIGINT)"


def requests_sql() -> str:
    """The request fixture (``request_id, user_id, ts, payload``) from the event readings."""
    from millwright.sources.requests import payload_sql

    return (f"SELECT udi AS request_id, product_id AS user_id, ts, "
            f"{payload_sql()} AS payload FROM ({READINGS_EVENTS_TS}) r")


def _has(keys: str, alias: str) -> str:
    return f"coalesce(list_contains({keys}, '{alias}'), false)"


def _path(alias: str) -> str:
    return "'$.\"" + alias + "\"'"


def validated_sql() -> str:
    """Parsed and validated requests, one row per request (same columns as ``validate_requests``)."""
    from millwright import schema as S

    fields = []
    for field, aliases in S.FIELD_ALIASES.items():
        whens = " ".join(f"WHEN {_has('keys', a)} THEN json_extract_string(j, {_path(a)})" for a in aliases)
        fields.append(f"CASE {whens} END AS raw_{field.lower()}")
        fields.append("(" + " OR ".join(_has("keys", a) for a in aliases) + f") AS has_{field.lower()}")
    target = {"AirTemp": S.AIR, "ProcessTemp": S.PROCESS, "RPM": S.RPM, "Torque": S.TORQUE, "Wear": S.WEAR}
    nums = ", ".join(
        f"CASE WHEN isnan(TRY_CAST(raw_{f.lower()} AS DOUBLE)) THEN NULL ELSE TRY_CAST(raw_{f.lower()} AS DOUBLE) END "
        f"AS {target[f]}" for f in S.NUMERIC_FIELD_ORDER)
    missing = "concat_ws(', ', " + ", ".join(
        f"CASE WHEN NOT has_{f.lower()} THEN '{f}' END" for f in ["RPM", "Torque", "Wear", "AirTemp", "ProcessTemp", "Type"]) + ")"
    invalid = "concat_ws(', ', " + ", ".join(
        f"CASE WHEN {target[f]} IS NULL THEN '{S.SENSOR_LONG_NAMES[target[f]]}' END" for f in S.NUMERIC_FIELD_ORDER) + ")"
    tokens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.TYPE_TOKENS.items())
    norm = (f"coalesce(CASE upper(replace(replace(regexp_replace(raw_type, '^\\s+|\\s+$', '', 'g'), '-', ''), '_', '')) "
            f"{tokens} ELSE '' END, '')")
    return f"""
SELECT request_id, user_id, ts, payload, status, missing, invalid, type,
  {S.AIR}, {S.PROCESS}, {S.RPM}, {S.TORQUE}, {S.WEAR}, raw_type, malformed,
  has_rpm, has_torque, has_wear, has_airtemp, has_processtemp, has_type FROM (
 SELECT *, CASE WHEN malformed THEN 'malformed' WHEN missing_l <> '' THEN 'missing'
     WHEN invalid_l <> '' THEN 'invalid_numeric' WHEN type = '' THEN 'invalid_type' ELSE 'scored' END AS status,
   CASE WHEN NOT malformed THEN missing_l END AS missing,
   CASE WHEN NOT malformed AND missing_l = '' THEN invalid_l END AS invalid
 FROM (
  SELECT *, {missing} AS missing_l, {invalid} AS invalid_l, {norm} AS type FROM (
   SELECT *, {nums} FROM (
    SELECT request_id, user_id, ts, payload, NOT ok AS malformed, {", ".join(fields)} FROM (
     SELECT *, CASE WHEN keys IS NOT NULL THEN t END AS j FROM (
      SELECT *, CASE WHEN ok AND json_type(t) = 'OBJECT' THEN json_keys(t) END AS keys FROM (
       SELECT *, json_valid(t) AS ok FROM (
        SELECT *, replace(payload, '''', '"') AS t FROM ({requests_sql()}) q0) q1) q2) q3) q4) q5) q6) q7) q8"""
