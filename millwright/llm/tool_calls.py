"""Operator 2: tool-call linking for chat formatting, with DataFrame functions only.

Calls and results are two tables.  Results are hash-joined to calls by (conv_id, call_id).
A call may name several earlier calls that it waits for.  Calls are ordered topologically by depth,
the length of the longest path to them, in two parts, and no conversation is ever gathered into
one task:

* calls that wait for just one other form chains.  Pointer doubling finds the start of each chain
  (a call that waits for none, or for several): each round every call jumps twice as far, so a chain
  of n calls takes log2(n) rounds;
* calls that wait for several are settled level by level, as soon as the chain starts before all of
  theirs are: a round for each level of such calls, over those only.

Arguments are held against the tool's schema (required, unknown and wrongly typed parameters).
Their values keep their JSON types (``variant``).  Messages come out as canonical JSON: keys in
UTF-8 order at every depth, no blanks, numbers without trailing zeros, control characters escaped.

Statuses: ``ok``; ``invalid`` (the arguments break the schema); ``unknown_tool``;
``no_result``; ``orphan`` (a result without a call); ``cycle`` (the calls wait for each other, or for
calls that do).  A call waits for nothing by naming one that is not there.

Defined cases: of repeated calls or results of one id the first counts, by their
position, then their values; null ids take no part; null, empty or malformed arguments (text after
the object, a key repeated inside a nested object) are an object without parameters (``invalid``
if one is required); of a repeated parameter the last value counts; a parameter that is ``null``
is one that is missing, but keeps its place in the message; an integer is a number without
fraction; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.functions import json as J
from millwright.functions.expressions import let
from millwright.llm.common import discard, store


def first_of(rows: DataFrame, *values: str) -> DataFrame:
    """One row for each (conv_id, call_id): the least by position, then by the other values."""
    told = rows.where("conv_id is not null and call_id is not null")
    least = F.min(F.struct("position", *values)).alias("r")
    return told.groupBy("conv_id", "call_id").agg(least).select("conv_id", "call_id", "r.*")


KEY = ["conv_id", "call_id"]


def _met(left: str, right: str) -> Column:
    return (F.col("conv_id") == F.col("to_conv")) & (F.col(left) == F.col(right))


def chains(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """conv_id, call_id, start, distance, open: the start of each call's chain and how far it is.

    ``edges``: conv_id, call_id, after.  A start is its own.  Calls still ``open`` at the end go round.
    """
    single = edges.groupBy(*KEY).agg(F.min("after").alias("after"), F.count(F.lit(1)).alias("n")).where("n = 1")
    single = single.select(F.col("conv_id").alias("to_conv"), F.col("call_id").alias("to_id"), "after")
    at = nodes.join(single, _met("call_id", "to_id"), "left").select(
        *KEY, F.coalesce("after", "call_id").alias("start"), F.when(F.col("after").isNull(), 0).otherwise(1).cast("long").alias("distance"),
        F.col("after").isNotNull().alias("open"))
    at = store(at, "call-chains")
    for _ in range(1 + math.ceil(math.log2(max(2, at.count())))):
        if not at.where("open").limit(1).count():
            break
        to = at.select(F.col("conv_id").alias("to_conv"), F.col("call_id").alias("to_id"), F.col("start").alias("on"),
                       F.col("distance").alias("further"), F.col("open").alias("still"))
        ahead = at.where("open").join(to, _met("start", "to_id")).select(
            *KEY, F.col("on").alias("start"), (F.col("distance") + F.col("further")).alias("distance"), F.col("still").alias("open"))
        then = store(at.where("not open").unionByName(ahead), "call-chains")
        discard(at)
        at = then
    return at


def depths(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, depth: the longest path of calls before it; null for a call that waits for a cycle.

    ``calls``: conv_id, call_id, after (array of call_ids).
    """
    nodes = calls.select(*KEY)
    known = nodes.select(F.col("conv_id").alias("to_conv"), F.col("call_id").alias("to_id"))
    edges = calls.select(*KEY, F.explode(F.array_distinct("after")).alias("after")).join(known, _met("after", "to_id"), "left_semi")
    edges = store(edges, "call-edges")
    at = chains(nodes, edges)
    many = edges.groupBy(*KEY).agg(F.count(F.lit(1)).alias("waits")).where("waits > 1")
    of = at.select(F.col("conv_id").alias("to_conv"), F.col("call_id").alias("to_id"), "start", "distance", "open")
    # what each call that waits for several waits for: the starts of those chains; what goes round is never settled
    waiting = edges.join(many, KEY).join(of, _met("after", "to_id")).where("not open").select(
        *KEY, "waits", "start", (F.col("distance") + 1).alias("steps"))
    waiting = store(waiting, "call-waits")
    starts = at.where("start = call_id and not open").join(many.select(*KEY), KEY, "left_anti")
    settled = store(starts.select(*KEY, F.lit(0).cast("long").alias("depth")), "call-depths")
    new = settled
    while waiting.limit(1).count():
        fresh = new.select(F.col("conv_id").alias("to_conv"), F.col("call_id").alias("to_id"), F.col("depth").alias("from_depth"))
        # edges whose start is settled count towards their call; the others keep waiting
        told = waiting.join(fresh, _met("start", "to_id"), "left").select(
            *KEY, "waits", F.when(F.col("from_depth").isNull(), F.col("start")).alias("start"),
            F.when(F.col("from_depth").isNull(), F.col("steps")).otherwise(F.col("steps") + F.col("from_depth")).alias("steps"))
        done = told.groupBy(*KEY, "waits").agg(
            F.sum(F.when(F.col("start").isNull(), 1).otherwise(0)).alias("ready"), F.max("steps").alias("depth"))
        new = store(done.where("ready = waits").select(*KEY, "depth"), "call-depths")
        if not new.limit(1).count():
            break
        left = store(told.join(new.select(*KEY), KEY, "left_anti"), "call-waits")
        discard(waiting)
        waiting, settled = left, settled.unionByName(new)
    base = settled.select(F.col("conv_id").alias("to_conv"), F.col("call_id").alias("to_id"), F.col("depth").alias("base"))
    on = (F.col("conv_id") == F.col("to_conv")) & (F.col("start") == F.col("to_id")) & ~F.col("open")
    return at.join(base, on, "left").select(*KEY, (F.col("base") + F.col("distance")).alias("depth"))


def _kind(value: Column) -> Column:
    """The JSON type of a variant; null for ``null``."""
    name = F.schema_of_variant(value)
    return (
        F.when(name == "STRING", "string").when(name == "BOOLEAN", "boolean")
        .when(name.rlike(r"^(BIGINT|DECIMAL\(\d+,0\))$"), "integer")
        .when(name.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "number")
        .when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array")
    )


def parameters() -> Column:
    """Map from each parameter to its ``kind`` and its canonical ``json``, after ``read_objects``."""
    names = F.coalesce(J.entry_names(), F.array().cast("array<string>"))
    value = lambda name: let(
        J.last_value(name), lambda v: F.named_struct(F.lit("kind"), _kind(v), F.lit("json"), F.to_json(v)))
    return F.map_from_arrays(names, F.transform(names, value))


def quoted(text: Column) -> Column:
    """A JSON string; null for null."""
    return F.to_json(text.cast("variant"))


def canonical(params: Column) -> Column:
    """The parameters sorted by name."""
    names = F.sort_array(F.map_keys(params))
    each = F.transform(names, lambda n: F.concat(quoted(n), F.lit(":"), params[n]["json"]))
    return F.concat(F.lit("{"), F.array_join(each, ","), F.lit("}"))


def problems(params: Column, schema: Column) -> Column:
    """Names of parameters that break the schema (array of struct<name, kind, required>), with the reason."""
    names = F.transform(schema, lambda s: s["name"])
    missing = F.transform(
        F.filter(schema, lambda s: s["required"] & params[s["name"]]["kind"].isNull()),
        lambda s: F.concat(F.lit("missing:"), s["name"]),
    )
    unknown = F.transform(
        F.array_except(F.map_keys(params), names), lambda k: F.concat(F.lit("unknown:"), k)
    )

    def wrong(s):
        kind, want = params[s["name"]]["kind"], s["kind"]
        return kind.isNotNull() & (kind != want) & ~((want == "number") & (kind == "integer"))

    typed = F.transform(F.filter(schema, wrong), lambda s: F.concat(F.lit("type:"), s["name"]))
    return F.array_sort(F.concat(missing, unknown, typed))


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """conv_id, call_id, depth, status, problems, message: one row for each call, and each orphan result.

    ``calls``: conv_id, call_id, position, tool, arguments (JSON text), after (array of call_ids);
    ``results``: conv_id, call_id, position, content; ``schemas``: tool, name, kind (string, integer,
    number, boolean, object or array), required, one row a parameter.
    Order a conversation's messages by depth, then position (nulls last).
    """
    calls = store(first_of(calls, "tool", "arguments", "after"), "calls")
    results = first_of(results, "content").select(
        F.col("conv_id").alias("r_conv"), F.col("call_id").alias("r_id"), F.col("position").alias("r_position"), "content"
    )
    tools = schemas.groupBy("tool").agg(
        F.sort_array(F.collect_list(F.struct("name", "kind", "required"))).alias("schema")
    ).withColumnRenamed("tool", "schema_tool")
    ordered = depths(calls).withColumnsRenamed({"conv_id": "d_conv", "call_id": "d_id"})
    whole = (
        calls.join(ordered, (F.col("conv_id") == F.col("d_conv")) & (F.col("call_id") == F.col("d_id")))
        .join(results.hint("shuffle_hash"), (F.col("conv_id") == F.col("r_conv")) & (F.col("call_id") == F.col("r_id")), "full")
        .join(tools, F.col("tool") == F.col("schema_tool"), "left")
    )
    read = J.read_objects(whole, F.col("arguments"), "variant")
    whole = read.select(*whole.columns, parameters().alias("params"))
    called = F.col("d_id").isNotNull()
    broken = F.when(called & F.col("schema").isNotNull(), problems(F.col("params"), F.col("schema")))
    broken = F.coalesce(broken, F.array().cast("array<string>"))
    status = (
        F.when(~called, "orphan")
        .when(F.col("depth").isNull(), "cycle")
        .when(F.col("schema").isNull(), "unknown_tool")
        .when(F.size("problems") > 0, "invalid")
        .when(F.col("r_id").isNull(), "no_result")
        .otherwise("ok")
    )
    text = lambda c: F.coalesce(quoted(F.col(c)), F.lit("null"))
    message = F.concat(
        F.lit('{"arguments":'), F.when(called, canonical(F.col("params"))).otherwise("null"),
        F.lit(',"id":'), quoted(F.col("id")),
        F.lit(',"result":'), text("content"),
        F.lit(',"tool":'), text("tool"), F.lit("}"),
    )
    return (
        whole.withColumn("problems", broken)
        .withColumn("id", F.coalesce("call_id", "r_id"))
        .select(
            F.coalesce("conv_id", "r_conv").alias("conv_id"),
            F.col("id").alias("call_id"),
            F.coalesce("position", "r_position").alias("position"),
            F.col("depth").cast("long").alias("depth"),
            status.alias("status"),
            F.array_join("problems", ",").alias("problems"),
            message.alias("message"),
        )
    )


def op2_tool_calls(conversations: DataFrame) -> DataFrame:
    """Tool calls as the turns imply them.

    Each user turn is a call of the tool ``answer``, or of ``lookup`` if its text has under 200
    characters, waiting for the user turn before it; the turn right after it, if the assistant's,
    is its result.  Assistant turns after anything else are results without a call.  The schemas
    ask a lookup for a topic, so that calls of it without one are found.
    """
    spark = conversations.sparkSession
    turns = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", F.coalesce("text", F.lit("")).alias("text")
    )
    told = turns.where("conv_id is not null and turn is not null")
    size = F.char_length("text")
    tool = F.when(size < 200, "lookup").otherwise("answer")
    said = F.struct(
        size.alias("n_chars"), F.substring_index("text", " ", 1).alias("query"),
        F.when(size % 3 > 0, F.lit("chat")).alias("topic"),
    )
    calls = told.where("role = 'user'").select(
        "conv_id", F.concat(F.lit("call-"), "turn").alias("call_id"), F.col("turn").alias("position"), tool.alias("tool"),
        F.to_json(said).alias("arguments"), F.array(F.concat(F.lit("call-"), F.col("turn") - 2)).alias("after"),
    )
    results = told.where("role = 'assistant'").select(
        "conv_id", F.concat(F.lit("call-"), F.col("turn") - 1).alias("call_id"), F.col("turn").alias("position"), F.col("text").alias("content")
    )
    schemas = spark.createDataFrame(
        [
            ("answer", "n_chars", "integer", True), ("answer", "query", "string", True), ("answer", "topic", "string", False),
            ("lookup", "n_chars", "integer", True), ("lookup", "query", "string", True), ("lookup", "topic", "string", True),
        ],
        "tool string, name string, kind string, required boolean",
    )
    return link(calls, results, schemas)


ORACLE = r"""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM conversations
  WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
u AS (
  SELECT conv_id, turn, arg_min(text, [CASE WHEN n < 200 THEN 'lookup' ELSE 'answer' END, text]) AS text
  FROM t WHERE role = 'user' GROUP BY ALL),
a AS (SELECT conv_id, turn, min(text) AS text FROM t WHERE role = 'assistant' GROUP BY ALL),
d AS (
  SELECT conv_id, turn, 0 AS depth FROM u x
  WHERE NOT EXISTS (SELECT 1 FROM u y WHERE y.conv_id = x.conv_id AND y.turn = x.turn - 2)
  UNION ALL
  SELECT u.conv_id, u.turn, d.depth + 1 FROM d JOIN u ON u.conv_id = d.conv_id AND u.turn = d.turn + 2),
c AS (
  SELECT u.*, d.depth, length(u.text) AS n, CASE WHEN length(u.text) < 200 THEN 'lookup' ELSE 'answer' END AS tool,
         split_part(u.text, ' ', 1) AS q
  FROM u JOIN d USING (conv_id, turn)),
j AS (
  SELECT coalesce(c.conv_id, a.conv_id) AS conv_id, 'call-' || coalesce(c.turn, a.turn - 1) AS call_id,
         coalesce(c.turn, a.turn) AS position, c.depth, c.tool, c.q, c.n, a.text AS content, c.turn AS called, a.turn AS answered
  FROM c FULL JOIN a ON c.conv_id = a.conv_id AND c.turn = a.turn - 1),
s AS (
  SELECT *, called IS NOT NULL AND tool = 'lookup' AND n % 3 = 0 AS broken FROM j)
SELECT conv_id, call_id, position, CAST(depth AS BIGINT) AS depth,
       CASE WHEN called IS NULL THEN 'orphan' WHEN broken THEN 'invalid' WHEN answered IS NULL THEN 'no_result' ELSE 'ok' END AS status,
       CASE WHEN broken THEN 'missing:topic' ELSE '' END AS problems,
       '{"arguments":' || CASE WHEN called IS NULL THEN 'null' ELSE '{"n_chars":' || n || ',"query":' ||
           CAST(to_json(q) AS VARCHAR) ||
           CASE WHEN n % 3 > 0 THEN ',"topic":"chat"' ELSE '' END || '}' END ||
       ',"id":"' || call_id || '","result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') ||
       ',"tool":' || coalesce('"' || tool || '"', 'null') || '}' AS message
FROM s
"""
