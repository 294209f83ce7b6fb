"""Filter interaction audit: what each filter removes in every order that the filters can be applied in.

1. One pass over the texts gives a document's *mask*, a bit for each filter that it fails; a narrow
   table of masks and text digests is stored.  A copy is found by two equi-joins of narrow rows: the
   smallest ``doc_id`` of each digest (partial aggregation, so a text repeated a billion times is one
   row after the map side), then (digest, doc_id) against it, which no hot text can skew.
2. Documents are counted by (part, mask): at most ``2 ** len(names)`` *cells* for each part, and
   nothing later touches a document.
3. A recursive CTE extends filter prefixes by each letter not used yet, joins the part's cells and
   carries the bits applied so far.  A level of the recursion is a step, and its rows hold the step's
   figures: there are 5 + 20 + 60 + 120 + 120 prefixes to a part, not 120 * 5.
4. Each complete order takes the figures of its five prefixes by an equi-join.  A prefix of ``k``
   letters begins ``(n - k)!`` orders, which weighs the Shapley sums.

Defined cases: a null text is empty, has no word and fails none of the five filters by itself; all
null and empty texts are copies of each other.  A row without a ``doc_id`` has no smaller id beside
it and never fails E; its labels are unknown (neither lost).  Rows that repeat a ``doc_id`` are
documents of their own, and equal ids are not smaller.  A document is good (toxic) if any of its
label rows says so.  An empty table has no part and no row.  Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import discard, store

BLANKS = r"[\x20\x09-\x0D]+"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of one text by themselves: A short, B repetitive, C capitals, D marks."""
    words = F.array_remove(F.split(text, BLANKS), "")
    return {
        "A": F.size(words) < 200,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 50,
        "C": F.length(F.regexp_replace(text, "[^A-Z]+", "")) * 100 > F.length(text) * 2,
        "D": text.rlike("[#$%&*|]"),
    }


def document_masks(docs: DataFrame) -> DataFrame:
    """``doc_id, part, mask, digest``: the bits of the filters A to D that a document fails (stored)."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"))
    bits = [F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(text_filters(F.col("text")).values())]
    mask = sum(bits[1:], bits[0])
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    return store(base.select("doc_id", "part", mask.alias("mask"), digest.alias("digest")), "masks")


def mark_copies(masks: DataFrame, bit: int) -> DataFrame:
    """Sets ``bit`` in the mask of each document whose text a smaller ``doc_id`` has, in any part."""
    first = masks.groupBy(F.col("digest").alias("first_digest")).agg(F.min("doc_id").alias("first_id"))
    met = (F.col("digest") == F.col("first_digest")) & (F.col("doc_id") == F.col("first_id"))
    copy = F.col("doc_id").isNotNull() & F.col("first_id").isNull()
    marked = F.when(copy, F.col("mask").bitwiseOR(F.lit(bit))).otherwise(F.col("mask"))
    return masks.join(first, met, "left").select("doc_id", "part", marked.alias("mask"))


def mask_cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, cells``: for each part the counts of all, good and toxic documents by mask."""
    yes = lambda c: F.max((F.col(c) == 1).cast("int"))
    known = labels.groupBy(F.col("doc_id").alias("label_id")).agg(yes("quality").alias("good"), yes("toxic").alias("toxic"))
    found = masks.join(known, masks["doc_id"] == known["label_id"], "left")
    count = lambda c: F.sum(F.coalesce(c, F.lit(0)).cast("long"))
    cells = found.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), count("good").alias("good"), count("toxic").alias("toxic"))
    return cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))


#: ``applied`` holds the bits of the prefix, ``bit`` that of its last letter.
WALK = """
WITH RECURSIVE walk (part, prefix, letter, step, applied, kept, removed, redundant, unique_fails, good_lost, toxic_lost) AS (
  SELECT part, '', '', 0, 0, 0L, 0L, 0L, 0L, 0L, 0L FROM {cells}
  UNION ALL
  SELECT part, concat(prefix, letter), letter, step + 1, applied | bit,
    aggregate(filter(cells, c -> c.mask & (applied | bit) = 0), 0L, (s, c) -> s + c.n),
    aggregate(lost, 0L, (s, c) -> s + c.n),
    aggregate(filter(cells, c -> c.mask & bit <> 0 AND c.mask & applied <> 0), 0L, (s, c) -> s + c.n),
    aggregate(filter(cells, c -> c.mask = bit), 0L, (s, c) -> s + c.n),
    aggregate(lost, 0L, (s, c) -> s + c.good),
    aggregate(lost, 0L, (s, c) -> s + c.toxic)
  FROM (
    SELECT *, filter(cells, c -> c.mask & bit <> 0 AND c.mask & applied = 0) AS lost
    FROM (
      SELECT walk.part, walk.prefix, walk.step, walk.applied, held.cells,
             inline(filter({letters}, x -> walk.applied & x.bit = 0)) AS (letter, bit)
      FROM walk JOIN {cells} AS held ON walk.part = held.part)))
SELECT * FROM walk WHERE step > 0 LIMIT ALL
"""

FIGURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def audit_orders(cells: DataFrame, names: str) -> DataFrame:
    """Every step of every order of the filters ``names`` (bit ``i`` of a mask is ``names[i]``), by part."""
    spark = cells.sparkSession
    letters = ", ".join(f"named_struct('letter', '{x}', 'bit', {1 << i})" for i, x in enumerate(names))
    walk = spark.sql(WALK.replace("{letters}", f"array({letters})"), cells=cells)
    walk = store(walk, "walk")
    n = len(names)
    orders = F.lit(math.factorial(n))
    for k in range(1, n):
        orders = F.when(F.col("step") == k, F.lit(math.factorial(n - k))).otherwise(orders)
    orders = F.when(F.col("step") == n, F.lit(1)).otherwise(orders)
    shapley = walk.groupBy(F.col("part").alias("of_part"), F.col("letter").alias("of_letter")).agg(
        F.sum(F.col("removed") * orders).alias("shapley"))
    full = walk.where(F.col("step") == n).select(F.col("part").alias("in_part"), F.col("prefix").alias("filter_order"))
    steps = full.select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("to_step"))
    steps = steps.select("*", F.expr("left(filter_order, to_step)").alias("to_prefix"))
    rows = steps.join(walk, (F.col("in_part") == F.col("part")) & (F.col("to_prefix") == F.col("prefix")))
    rows = rows.join(shapley, (F.col("part") == F.col("of_part")) & (F.col("letter") == F.col("of_letter")))
    return rows.select("part", "filter_order", "step", *FIGURES, "shapley")


def op13_filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    masks = document_masks(docs)
    cells = store(mask_cells(mark_copies(masks, 1 << 4), labels), "cells")
    discard(masks)
    return audit_orders(cells, "ABCDE")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
firsts AS (SELECT text AS t, min(doc_id) AS first_id FROM d GROUP BY text),
l AS (SELECT doc_id AS label_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
             max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN doc_id > first_id THEN 16 ELSE 0 END) AS mask
  FROM w JOIN firsts ON text = t LEFT JOIN l ON doc_id = label_id),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(letter, bit)),
orders AS (
  SELECT '' AS o UNION ALL
  SELECT o || letter FROM orders, letters WHERE NOT contains(o, letter)),
steps AS (
  SELECT o AS filter_order, s AS step, bit,
         (SELECT coalesce(sum(b.bit), 0) FROM letters b WHERE contains(left(o, s - 1), b.letter)) AS applied
  FROM orders, range(1, 6) AS r(s), letters WHERE length(o) = 5 AND letter = o[s]),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (applied | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & bit <> 0 AND mask & applied = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & bit <> 0 AND mask & applied <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & bit <> 0 AND mask & applied = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & bit <> 0 AND mask & applied = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM (SELECT part, mask, n, good, toxic, filter_order, step, bit, applied::INTEGER AS applied FROM cells, steps)
  GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
  redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
  toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM f
"""
