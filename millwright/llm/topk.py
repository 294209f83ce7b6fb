"""Operator 10: exact top-k inner products without random access.

The candidates are dealt into blocks.  A block holds one list for each dimension, sorted by
component.  For a query each list is sorted by what it adds to the score: from its large end
where the query's component is positive, from its small end where it is negative; a zero adds
nothing.  A block of queries reads together: an entry is read once, at either end, for all queries
that come to it there.  The lists are read in turn, in stretches that double:

* the entries of a stretch are added to what each query has seen of their candidates, by one
  product with a matrix that holds just these entries;
* a candidate's lower bound takes the least entry of each list that it has not been seen in, its
  upper bound the entry that the list has come to (its frontier);
* a query's candidates whose upper bound is below its k-th lower bound are out.  Once there are no
  more than ``4 * k`` a query left no outsider can qualify: reading stops, and only their scores are
  worked out whole.

``Lists.read`` counts the entries.  The blocks' winners meet in a ranking by query.  A candidate
block travels once, to the task that keeps it; the queries' blocks stream past it, so a task holds
one candidate block and a batch of query blocks, whatever the size of the tables.

Defined cases: vectors that are null, empty, of another dimension than most rows' (the
commonest; ties: the larger), or hold a null or non-finite component take no part, nor does a
null vec_id; a query with no other vector gives no row; ties go to the smaller vec_id.  Every
row is a candidate, repeated ones too; equal rows are one entry with a count, and are ranked one
after another.  Rows that share a query's vec_id are none of its candidates; of several vectors
of one vec_id the largest by its components is the query.  A block whose scores may not fit 64
bits raises: components under 2**26 in absolute value and up to 2**11 dimensions always fit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millwright.llm.common import discard, store

#: Entries of each list in the first stretch.
FIRST = 128


class Lists:
    """The sorted lists of a block of candidates, read for many queries at once."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.order = np.argsort(rows, axis=0, kind="stable")
        self.sorted = np.take_along_axis(rows, self.order, axis=0)
        self.reach = np.abs(rows).max(axis=0, initial=0.0)
        self.read = 0

    def survivors(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
        """Queries x candidates: which candidates may be among a query's k best; all of those are."""
        n = len(self.ids)
        alive = self.ids[None, :] != query_ids[:, None]
        most = (np.abs(queries) @ self.reach).max(initial=0.0)
        kind = np.float32 if most < 2**24 else np.float64  # every partial sum is exact, below 2**53
        slack = 0.0 if most < 2**53 else 1e-12 * most
        # (queries' components at this end, order and values from that end on), of the lists opened there
        ends = []
        for part, turn in ((np.maximum(queries, 0), -1), (np.minimum(queries, 0), 1)):
            used = np.flatnonzero(part.any(axis=0))
            ends.append((part[:, used].astype(kind), self.order[::turn][:, used], self.sorted[::turn][:, used].astype(kind)))
        unread = [np.ones(order.shape, kind) for _, order, _ in ends]
        seen, at, stop = np.zeros(alive.shape, kind), 0, min(n, max(FIRST, k))
        while n > k and alive.sum() > 4 * k * len(queries):
            for (part, order, value), left in zip(ends, unread):
                entries = np.zeros(order.shape, kind)
                np.put_along_axis(entries, order[at:stop], value[at:stop], axis=0)
                np.put_along_axis(left, order[at:stop], 0, axis=0)
                seen += part @ entries.T
                self.read += entries[at:stop].size
            lower = seen + sum(part @ (left * value[-1]).T for (part, _, value), left in zip(ends, unread))
            lower[~alive] = -np.inf
            # what a candidate seen in no list yet can reach at most; while that beats all lower bounds nothing is out
            open_ = sum(part @ value[stop - 1] for part, _, value in ends)
            if stop == n or (open_ < lower.max(axis=1)).any():
                upper = seen + sum(part @ (left * value[stop - 1]).T for (part, _, value), left in zip(ends, unread))
                best = np.partition(lower, n - k, axis=1)[:, n - k, None]
                alive &= upper + slack >= best - slack
            if stop == n:
                break
            at, stop = stop, min(n, 2 * stop)
        return alive

    def top(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the query, place of the candidate, score) of each query's k best, ties to the smaller id."""
        if len(queries) and float((np.abs(queries) @ self.reach).max()) >= 2.0**62:
            raise ValueError("scores may not fit 64 bits")
        at, who = np.nonzero(self.survivors(query_ids, queries, k))
        scores = np.concatenate([
            (self.rows[who[i : i + 65536]].astype(np.int64) * queries[at[i : i + 65536]].astype(np.int64)).sum(axis=1)
            for i in range(0, max(1, len(at)), 65536)
        ])
        order = np.lexsort((self.ids[who], -scores, at))
        at, who, scores = at[order], who[order], scores[order]
        best = np.arange(len(at)) - np.searchsorted(at, at) < k
        return at[best], who[best], scores[best]


def _blocks(rows: DataFrame, size: int, n: int) -> DataFrame:
    """``block``, ids, copies, flat (the vectors one after another): about ``size`` rows of ``n`` to a block."""
    count = max(1, -(-n // size))
    return (
        rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "parts"), F.lit(count)).cast("int"))
        .groupBy("block")
        .agg(F.collect_list(F.struct("vec_id", "copies", "parts")).alias("rows"))
        .select("block", F.col("rows.vec_id").alias("ids"), F.col("rows.copies").alias("copies"), F.flatten("rows.parts").alias("flat"))
    )


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, parts (floor(256 x) of each component as double), copies: the vectors that take part."""
    rows = (
        vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("e"))
        .where("vec_id is not null and size(e) > 0")
        .where(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
        .select("vec_id", F.transform("e", lambda x: F.floor(x * 256).cast("double")).alias("parts"))
    )
    sizes = rows.groupBy(F.size("parts").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).limit(1)
    dims = sizes.first()
    rows = rows.where(F.size("parts") == (dims["dims"] if dims else 0))
    return rows.groupBy("vec_id", "parts").agg(F.count(F.lit(1)).alias("copies"))


def top_k(vectors: DataFrame, every: int, k: int, block: int = 4096, query_block: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by ``every``."""
    rows = store(whole_vectors(vectors), "vectors")
    n = rows.count()
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.max("parts").alias("parts"), F.lit(1).cast("long").alias("copies"))
    queries = _blocks(asked, query_block, max(1, n // every))
    count = max(1, -(-n // block))
    # one row for each pair of blocks, not of vectors
    dealt = queries.select(F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("block"), F.lit(1).alias("kind"), "ids", "copies", "flat")
    held = _blocks(rows, block, n).select("block", F.lit(0).alias("kind"), "ids", "copies", "flat")
    both = held.unionByName(dealt).repartition(count, "block").sortWithinPartitions("block", "kind")

    def run(batches):
        at, lists, copies = None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                ids, many, flat = (part[c].flatten().to_numpy(zero_copy_only=False) for c in ("ids", "copies", "flat"))
                here = batch["block"][i].as_py()
                if batch["kind"][i].as_py() == 0:
                    at, lists, copies = here, Lists(ids, flat.reshape(len(ids), -1)), many
                elif at == here:
                    at_query, place, score = lists.top(ids, flat.reshape(len(ids), -1), k)
                    times = np.minimum(copies[place], k)
                    columns = (ids[at_query], lists.ids[place], score)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(c, times), pa.int64()) for c in columns], names=["query_id", "vec_id", "score"]
                    )

    best = both.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    out = store(ranked.select("query_id", "rank", "vec_id", "score"), "top")
    discard(rows)
    return out


def op10_topk(vectors: DataFrame) -> DataFrame:
    return top_k(vectors, every=50, k=5)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS p
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.p, c.p), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
