"""Merkle manifest of a table: a tree of fanout 3 over each source's rows, and one over the sources.

1. *Leaves.* A row's leaf is the sha256 of its columns, computed by Spark's own ``sha2``.  Narrow rows
   (id, source, digests) are dealt by range over (source, doc_id, leaf), so that a source with a third
   of all rows is spread over partitions, sorted there and stored with their place.  Counts by
   (partition, source), a table of as many rows as partitions and sources together, turn places into
   ranks within the source: no window ever spans a source.
2. *Blocks.* ``3 ** depth`` neighbouring leaves form an aligned block, the partition of what follows.
   Its rows are gathered into one row; each block hashes the subtree over its own leaves.
3. *Butterfly.* In round ``r`` every block holds the root of its aligned run of ``3 ** r`` blocks.
   Aligned groups of three such runs swap these roots: the blocks at the same place in the three runs
   meet (groups of three rows), each hashes the common ancestor for itself and keeps the other roots as
   the next part of its proof.  After ``log3`` rounds each block has its source's root and its whole
   upper proof, and no pass goes down the tree again.  Where the last run is shorter than the others,
   its blocks also serve the places that it lacks: a block receives two roots a round at most.
   Sources then do the same over their subroots.
4. *Proofs.* A block with its upper proof makes the proof of each of its leaves, and folds the (perhaps
   tampered) leaf with the original siblings up to the root.

Defined cases: in any column null counts as ``-``; the null source is a source and comes first; within
a source null ids come first, and rows of one id ascend by leaf, so that repeated rows have equal
leaves next to each other and a row each.  A row without an id is not tampered with.  A single leaf is
its source's subroot, and a single subroot the root, with an empty proof.  An empty table has no row.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwright.llm.common import discard, id_crc, store

FANOUT = 3
#: A block holds FANOUT ** DEPTH leaves (some 150 KB of ids and digests).
DEPTH = 7
#: Rows of one source that meet its upper proof in one task.
BLOCKS_PER_TASK = 1000


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(text: Column) -> Column:
    parts = [field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    return F.sha2(F.concat(*parts, field(text)).cast("binary"), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """``doc_id, source, leaf, changed, part, place``: leaves in order (stored); ``changed`` is null where not tampered."""
    cut = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    hit = (id_crc() % 2 == 0) & F.col("text").contains("\n")
    rows = docs.select(
        "doc_id", "source", F.unhex(leaf_hash(F.col("text"))).alias("leaf"), F.when(hit, F.unhex(leaf_hash(cut))).alias("changed"))
    order = [F.asc_nulls_first("source"), F.asc_nulls_first("doc_id"), F.asc("leaf")]
    at = F.monotonically_increasing_id()
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", at)
    return store(rows.select(
        "doc_id", "source", "leaf", "changed", F.shiftright("at", 33).alias("part"),
        F.col("at").bitwiseAND((1 << 33) - 1).alias("place")), "leaves")


def ranks(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs, sources): ``part, source, rank, shift`` and ``rank, n``.

    A row's index within its source is ``place + shift``; ``rank`` numbers the sources in order.
    The one window without a key runs over a row for each partition.
    """
    runs = store(rows.groupBy("source", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("place").alias("first")), "runs")
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("*", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"),
                       F.min("part").over(Window.partitionBy("source")).alias("home"),
                       F.sum("rows").over(Window.partitionBy("source")).alias("n"))
    heads = runs.where("part = home")
    by_home = Window.orderBy("home").rowsBetween(Window.unboundedPreceding, -1)
    homes = heads.groupBy("home").agg(F.count(F.lit(1)).alias("heads")).select(
        F.col("home").alias("at_home"), F.coalesce(F.sum("heads").over(by_home), F.lit(0)).alias("earlier"))
    local = F.row_number().over(Window.partitionBy("home").orderBy("first")) - 1
    sources = heads.select("source", "home", "n", local.alias("local")).join(homes, F.col("home") == F.col("at_home"))
    sources = store(sources.select("source", (F.col("earlier") + F.col("local")).alias("rank"), "n"), "sources")
    named = sources.select(F.col("source").alias("of_source"), "rank", F.col("n").alias("of_n"))
    runs = runs.join(named, F.col("source").eqNullSafe(F.col("of_source"))).select(
        "part", "source", "rank", (F.col("base") - F.col("first")).alias("shift"), F.col("of_n").alias("n"))
    return runs, sources.select("rank", "n")


def blocks_of(rows: DataFrame, runs: DataFrame, depth: int) -> DataFrame:
    """``rank, block, n, doc_ids, leaves, changed, root``: leaves of a block in order, and its subtree's root (stored)."""
    of = runs.select(F.col("part").alias("of_part"), F.col("source").alias("of_source"), "rank", "shift", "n")
    met = (F.col("part") == F.col("of_part")) & F.col("source").eqNullSafe(F.col("of_source"))
    found = rows.join(of, met).withColumn("index", F.col("place") + F.col("shift"))
    size = FANOUT**depth
    found = found.select("rank", F.expr(f"index div {size}").alias("block"), "n", "index", "doc_id", "leaf", "changed")

    def gather(t: pa.Table) -> pa.Table:
        t = t.sort_by("index")
        ids = [x.hex() for x in t["leaf"].to_pylist()]
        top = levels(ids, min(depth, height(t["n"][0].as_py())))[-1][0]
        one = lambda c, kind: pa.array([t[c].to_pylist()], pa.list_(kind))
        return pa.table({
            "rank": t["rank"][:1], "block": t["block"][:1], "n": t["n"][:1], "doc_ids": one("doc_id", pa.int64()),
            "leaves": one("leaf", pa.binary()), "changed": one("changed", pa.binary()), "root": pa.array([top])})

    return store(found.groupBy("rank", "block").applyInArrow(
        gather, "rank long, block long, n long, doc_ids array<long>, leaves array<binary>, changed array<binary>, root string"),
        "blocks")


def height(n: int) -> int:
    """Levels of hashing over ``n`` leaves."""
    up = 0
    while n > 1:
        n, up = -(-n // FANOUT), up + 1
    return up


def join_hash(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes: list[str], up: int) -> list[list[str]]:
    """The nodes of each level, from the leaves to ``up`` levels above them."""
    out = [nodes]
    for _ in range(up):
        below = out[-1]
        out.append([join_hash(below[i : i + FANOUT]) for i in range(0, len(below), FANOUT)])
    return out


def swap_round(state: DataFrame, r: int) -> DataFrame:
    """Round ``r`` of the butterfly over ``tree, unit, units, root, proof``.

    ``root`` is that of the unit's aligned run of ``3 ** r`` units, ``proof`` the steps so far: an array
    of (before, after), the siblings to the left and right of the way up, concatenated.
    """
    run = FANOUT**r
    mine = F.expr(f"unit div {run}")
    left = F.col("units") - mine * run  # units from the start of this run on
    place = F.expr(f"unit % {run}")
    active = F.col("units") > run
    # a last run that is short also serves the places it lacks, if another run of its group has them
    more = active & (left < run) & (mine % FANOUT > 0)
    places = F.when(more, F.expr(f"sequence(unit % {run}, {run} - 1, units - (unit div {run}) * {run})")).otherwise(F.array(place))
    sent = state.select(
        "tree", "units", "root", F.expr(f"unit div {run * FANOUT}").alias("group"), (mine % FANOUT).alias("digit"),
        F.posexplode(places).alias("copy", "place"), "unit", "proof")
    own = F.col("copy") == 0
    told = F.struct("digit", "root", F.when(own, F.col("unit")).alias("unit"), F.when(own, F.col("proof")).alias("proof"))
    met = sent.groupBy("tree", "units", "group", "place").agg(F.sort_array(F.collect_list(told)).alias("told"))
    each = met.select("tree", "units", "told", F.explode(F.filter("told", lambda x: x["unit"].isNotNull())).alias("me"))
    roots = lambda keep: F.array_join(F.transform(F.filter("told", keep), lambda x: x["root"]), "")
    digit = F.col("me.digit")
    step = F.struct(roots(lambda x: x["digit"] < digit).alias("before"), roots(lambda x: x["digit"] > digit).alias("after"))
    up = F.sha2(roots(lambda x: F.lit(True)).cast("binary"), 256)
    return each.select(
        "tree", F.col("me.unit").alias("unit"), "units",
        F.when(active, up).otherwise(F.col("me.root")).alias("root"),
        F.when(active, F.array_append("me.proof", step)).otherwise(F.col("me.proof")).alias("proof"))


STEPS = "array<struct<before:string,after:string>>"


def butterfly(units: DataFrame, name: str) -> DataFrame:
    """All rounds over ``tree, unit, units, root``; adds ``proof``. ``root`` becomes that of the tree."""
    state = units.select("tree", "unit", "units", "root", F.array().cast(STEPS).alias("proof"))
    most = units.agg(F.max("units")).first()[0] or 1
    for r in range(height(most)):
        last, state = state, store(swap_round(state, r), name)
        discard(*([last] if r else []))
    return state


def prove(blocks: DataFrame, depth: int) -> DataFrame:
    """Proofs and folded roots of all leaves of the blocks (``tops``: the steps above the block)."""
    kind = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

    def one(b: dict) -> pa.RecordBatch:
        ids = [x.hex() for x in b["leaves"]]
        up = min(depth, height(b["n"]))
        tree = levels(ids, up)
        tops = [(s["before"], s["after"]) for s in b["tops"]]
        tail = "".join(x + y for x, y in tops)
        proofs, folded = [], []
        for i, (own, changed) in enumerate(zip(ids, b["changed"])):
            node, steps, at = changed.hex() if changed else own, [], i
            for level in tree[:up]:
                lo = at - at % FANOUT
                steps.append(("".join(level[lo:at]), "".join(level[at + 1 : lo + FANOUT])))
                at //= FANOUT
            for x, y in (*steps, *tops):
                node = join_hash([x, node, y])
            proofs.append(join_hash([*(x + y for x, y in steps), tail]))
            folded.append(node)
        n = len(ids)
        return pa.record_batch({
            "doc_id": pa.array(b["doc_ids"], pa.int64()), "leaf": ids, "subroot": [b["subroot"]] * n, "root": [b["top"]] * n,
            "proof_sha256": proofs, "folded_root": folded, "verified": [x == b["top"] for x in folded]})

    def each(batches):
        for batch in batches:
            for i in range(len(batch)):
                yield one(batch.slice(i, 1).to_pylist()[0])

    return blocks.mapInArrow(each, kind)


def op12_merkle(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    rows = leaves(docs)
    runs, sources = ranks(rows)
    blocks = blocks_of(rows, runs, depth)
    discard(rows)
    size = FANOUT**depth
    units = F.expr(f"(n + {size - 1}) div {size}")
    in_source = butterfly(blocks.select(F.col("rank").alias("tree"), F.col("block").alias("unit"), units.alias("units"), "root"), "swaps")
    subroots = in_source.where("unit = 0").select("tree", F.col("root").alias("subroot"))
    count = sources.count()
    over = butterfly(subroots.select(F.lit(0).alias("tree"), F.col("tree").alias("unit"), F.lit(count).cast("long").alias("units"),
                                     F.col("subroot").alias("root")), "source-swaps")
    # a source's upper proof goes to each of its tasks' worth of blocks
    tasks = F.expr(f"(units + {BLOCKS_PER_TASK - 1}) div {BLOCKS_PER_TASK}")
    of = over.select(F.col("unit").alias("of_rank"), F.col("root").alias("top"), F.col("proof").alias("over"))
    widths = sources.select("rank", units.alias("units")).select("rank", F.explode(F.sequence(F.lit(0).cast("long"), tasks - 1)).alias("of_task"))
    of = of.join(widths, F.col("of_rank") == F.col("rank")).drop("rank")
    upper = in_source.select("tree", "unit", F.col("root").alias("subroot"), "proof", F.expr(f"unit div {BLOCKS_PER_TASK}").alias("task"))
    upper = upper.join(of, (F.col("tree") == F.col("of_rank")) & (F.col("task") == F.col("of_task")))
    upper = upper.select("tree", "unit", "subroot", "top", F.concat("proof", "over").alias("tops"))
    whole = blocks.join(upper, (F.col("rank") == F.col("tree")) & (F.col("block") == F.col("unit")))
    return prove(whole.select("n", "doc_ids", "leaves", "changed", "subroot", "top", "tops"), depth)


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, text,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    (list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda h, c: list_reduce(list_prepend(xor(h, c), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                            lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))) AS crc
  FROM documents),
l AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) AS cut,
    xor(crc, 4294967295) % 2 = 0 AS hit
  FROM d),
s AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS rank, count(*) AS n FROM l GROUP BY source),
x AS (
  SELECT doc_id, rank, n, leaf, CASE WHEN coalesce(hit, false) THEN cut ELSE leaf END AS used,
    row_number() OVER (PARTITION BY rank ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i
  FROM l JOIN s ON l.source IS NOT DISTINCT FROM s.source),
up AS (
  SELECT rank, 0 AS lvl, i, leaf AS h, n FROM x
  UNION ALL
  SELECT rank, lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 2) // 3)
  FROM up WHERE n > 1 GROUP BY rank, lvl, i // 3),
sub AS (SELECT rank, lvl AS tall, h AS subroot FROM up WHERE n = 1),
top AS (
  SELECT 0 AS lvl, rank AS i, subroot AS h, (SELECT count(*) FROM sub) AS n FROM sub
  UNION ALL
  SELECT lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 2) // 3)
  FROM top WHERE n > 1 GROUP BY lvl, i // 3),
root AS (SELECT h AS root, lvl AS tall FROM top WHERE n = 1),
steps AS (
  SELECT rank, i, lvl, coalesce(string_agg(h, '' ORDER BY j) FILTER (WHERE j < own), '') AS before,
         coalesce(string_agg(h, '' ORDER BY j) FILTER (WHERE j > own), '') AS after
  FROM (
    SELECT x.rank, x.i, up.lvl, up.i AS j, up.h, x.i // (3 ** up.lvl)::BIGINT AS own
    FROM x JOIN up ON x.rank = up.rank AND up.n > 1 AND up.i // 3 = x.i // (3 ** (up.lvl + 1))::BIGINT
    UNION ALL
    SELECT x.rank, x.i, sub.tall + top.lvl, top.i, top.h, x.rank // (3 ** top.lvl)::BIGINT
    FROM x JOIN sub ON x.rank = sub.rank JOIN top ON top.n > 1 AND top.i // 3 = x.rank // (3 ** (top.lvl + 1))::BIGINT)
  GROUP BY rank, i, lvl),
fold AS (
  SELECT rank, i, 0 AS lvl, used AS h FROM x
  UNION ALL
  SELECT fold.rank, fold.i, fold.lvl + 1, sha256(before || h || after)
  FROM fold JOIN steps ON fold.rank = steps.rank AND fold.i = steps.i AND fold.lvl = steps.lvl),
proofs AS (SELECT rank, i, string_agg(before || after, '' ORDER BY lvl) AS proof FROM steps GROUP BY rank, i)
SELECT x.doc_id, x.leaf, sub.subroot, root.root, sha256(coalesce(proof, '')) AS proof_sha256,
  fold.h AS folded_root, fold.h = root.root AS verified
FROM x JOIN sub ON x.rank = sub.rank CROSS JOIN root
JOIN fold ON fold.rank = x.rank AND fold.i = x.i AND fold.lvl = sub.tall + root.tall
LEFT JOIN proofs ON proofs.rank = x.rank AND proofs.i = x.i
"""
