"""Order-based operators Spark has no single primitive for: running sums, as-of lookups, exact quantiles.

All split each group's value range into buckets so that no task holds a whole
group. Bucket boundaries are actual values of the table being ranked: approximate
quantiles of each group, from one distributed aggregate. The driver holds a number for each
bucket, and nothing else that grows with the data. Few boundaries are applied as a balanced
``CASE`` tree, compiled by whole-stage codegen; more than ``TREE`` as two levels, a tree (or array)
over the starts of chunks and the chunk's array, so the generated code does not grow with them.
Groups smaller than ``rows_per_bucket`` get no boundary and stay in one bucket, which is the
fast path at small scale.

* :func:`running_sum` — inclusive prefix sum per group: a window inside each
  bucket plus the offset of the earlier buckets (a table of one row per bucket,
  broadcast; its size is bounded by the number of buckets).
* :func:`asof_backward` — for each probe row, the last reference row with
  ``ref.value <= probe.value`` in the same group. Because every boundary is a
  reference value, the answer of a probe in bucket ``b >= 1`` lies in bucket
  ``b``: one window per (group, bucket, salt) finds it, with no cross-bucket
  carry. Probes of a hot bucket are spread over several salts, and the
  reference rows of that bucket are copied to each salt.
* :func:`exact_quantiles` — rank selection: running counts by bucket tell which
  buckets hold the ranks next to each quantile, and only those are sorted.
"""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwright.functions import expressions as X
from millwright.session import stored

Bounds = dict[tuple, list[float]]

ROWS_PER_BUCKET = 2_000_000
PROBES_PER_TASK = 4_000_000
#: Shares of the probes to a shuffle partition; many small ones even out where they land.
SPREAD = 64
#: Accuracy of the quantiles for each bucket: a bucket's size is off by a sixteenth or less.
QUANTILE_ACCURACY = 16
#: Boundaries that are compiled as literals.
TREE = 256


def range_bounds(df: DataFrame, group_cols: list[str], value_col: str,
                 rows_per_bucket: int = ROWS_PER_BUCKET) -> Bounds:
    """Per group with more than ``rows_per_bucket`` rows: sorted boundary values, one less than buckets.

    Small jobs: a count, row counts per group (one row per group reaches the driver), and, only
    for large groups, their approximate quantiles (one number per bucket does).
    """
    if df.count() <= rows_per_bucket:
        return {}
    counts = df.groupBy(*group_cols).count().collect()
    big = {tuple(r[g] for g in group_cols): -(-r["count"] // rows_per_bucket) for r in counts if r["count"] > rows_per_bucket}
    if not big:
        return {}
    most = max(big.values())
    shares = _held([i / most for i in range(1, most)])
    cuts = F.percentile_approx(F.col(value_col).cast("double"), shares, QUANTILE_ACCURACY * most).alias("_cuts")
    bounds: Bounds = {}
    for r in df.groupBy(*group_cols).agg(cuts).collect():
        k = tuple(r[g] for g in group_cols)
        if k in big and r["_cuts"]:
            bounds[k] = sorted({r["_cuts"][i * most // big[k] - 1] for i in range(1, big[k])})
    return bounds


def _held(numbers: list) -> Column:
    """A constant array (of arrays): one literal text, however many numbers."""
    return F.from_json(F.lit(json.dumps(numbers)), "array<double>" if isinstance(numbers[0], float) else "array<array<double>>")


def _tree(v: Column, bs: list[float], lo: int, hi: int) -> Column:
    """Number of boundaries in ``bs[:hi]`` that are ``<= v``, knowing it is at least ``lo``."""
    if lo >= hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(v >= F.lit(bs[mid]), _tree(v, bs, mid + 1, hi)).otherwise(_tree(v, bs, lo, mid))


def _upto(v: Column, bs: list[float]) -> Column:
    """Number of boundaries ``<= v``."""
    if len(bs) <= TREE:
        return _tree(v, bs, 0, len(bs))
    chunk = math.isqrt(len(bs))
    chunks = [bs[i : i + chunk] for i in range(0, len(bs), chunk)]
    starts = [c[0] for c in chunks[1:]]
    below = lambda array: F.size(F.filter(array, lambda x: x <= v))
    at = _tree(v, starts, 0, len(starts)) if len(starts) <= TREE else below(_held(starts))
    return X.let(at, lambda t: t * F.lit(chunk) + below(F.get(_held(chunks), t)))


def bucket_column(group_cols: list[str], value_col: str, bounds: Bounds) -> Column:
    """Bucket id: how many of the group's boundaries are ``<= value`` (0 for small groups)."""
    if not bounds:
        return F.lit(0)
    expr = None
    for k, bs in bounds.items():
        cond = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.lit(x)) for g, x in zip(group_cols, k)])
        branch = _upto(F.col(value_col), bs)
        expr = F.when(cond, branch) if expr is None else expr.when(cond, branch)
    return expr.otherwise(F.lit(0))


def running_sum(df: DataFrame, group_cols: list[str], value_col: str, weight_col: str,
                bounds: Bounds, out: str = "cum") -> DataFrame:
    """Inclusive running sum of ``weight_col`` ordered by ``value_col`` within each group.

    ``value_col`` must be unique within a group (e.g. a distinct-value count table).
    Adds ``_b`` (the bucket) and ``out``.
    """
    d = df.withColumn("_b", bucket_column(group_cols, value_col, bounds))
    w = (Window.partitionBy(*group_cols, "_b").orderBy(value_col)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = d.withColumn("_local", F.sum(weight_col).over(w))
    if not bounds:
        return local.withColumnRenamed("_local", out)
    totals = d.groupBy(*group_cols, "_b").agg(F.sum(weight_col).alias("_t"))
    before = Window.partitionBy(*group_cols).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = totals.select(*group_cols, "_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"))
    keys = [*group_cols, "_b"]
    named = offs.select(*[F.col(c).alias(f"_of_{c}") for c in keys], "_off")
    met = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys])
    return (local.join(F.broadcast(named), met)
            .select(*d.columns, (F.col("_local") + F.col("_off")).alias(out)))


def exact_quantiles(df: DataFrame, value_col: str, probs: list[float],
                    rows_per_bucket: int = ROWS_PER_BUCKET) -> list[float] | None:
    """Exact quantiles with linear interpolation between neighbouring ranks; None without any value.

    ``df`` is read once: its rows per distinct value (map-side combined) are stored. Of these, each
    bucket's count goes to the driver, and the two ranks next to each quantile name at most
    ``2 * len(probs)`` buckets, the only ones whose values are sorted.
    """
    rows = df.where(F.col(value_col).isNotNull()).groupBy(F.col(value_col).cast("double").alias("_v"))
    hist = stored(rows.agg(F.count(F.lit(1)).alias("_n")).select(F.lit(0).alias("_g"), "_v", "_n"), "values")
    bounds = range_bounds(hist, ["_g"], "_v", rows_per_bucket)
    b = hist.withColumn("_b", bucket_column(["_g"], "_v", bounds))
    sizes = sorted(tuple(r) for r in b.groupBy("_b").agg(F.sum("_n")).collect())
    total = sum(n for _, n in sizes)
    if not total:
        return None
    places = [(total - 1) * p for p in probs]
    ranks = sorted({r for x in places for r in (math.floor(x), math.ceil(x))})
    start, first = {}, 0
    for bucket, n in sizes:
        if any(first <= r < first + n for r in ranks):
            start[bucket] = first
        first += n
    before = reduce(lambda e, kv: F.when(F.col("_b") == kv[0], F.lit(kv[1])).otherwise(e), start.items(), F.lit(0))
    w = Window.partitionBy("_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = b.where(F.col("_b").isin(list(start))).select("_v", (F.sum("_n").over(w) + before).alias("_upto"))
    found = upto.agg(*[F.min(F.when(F.col("_upto") > r, F.col("_v"))).alias(f"_{r}") for r in ranks]).first()
    at = {r: found[f"_{r}"] for r in ranks}
    return [at[math.floor(x)] + (at[math.ceil(x)] - at[math.floor(x)]) * (x - math.floor(x)) for x in places]


def _salts(p: DataFrame, ref: DataFrame, keys: list[str], probes_per_task: int | None) -> DataFrame | None:
    """``keys``, ``_s``: how many salts a (group, bucket) takes; only those with more than one, None if there is none.

    A task is to get ``1 / (SPREAD * partitions)`` of the probes, but no fewer probes than the bucket has
    reference rows, so that the copies of reference rows never outnumber the probes. At most
    ``SPREAD * partitions`` buckets can hold more than such a share, which bounds what is broadcast.
    """
    spark = p.sparkSession
    sizes = p.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    share = F.lit(probes_per_task) if probes_per_task else F.ceil(F.sum("_n").over(Window.partitionBy()) / F.lit(SPREAD * parts))
    big = sizes.select(*keys, "_n", share.alias("_share")).where(F.col("_n") > F.col("_share"))
    held = ref.groupBy(*keys).agg(F.count(F.lit(1)).alias("_r"))
    least = F.least(F.col("_r"), F.lit(PROBES_PER_TASK))
    rows = (big.join(held, keys).select(*keys, F.ceil(F.col("_n") / F.greatest("_share", least)).cast("int").alias("_s"))
            .where("_s > 1").collect())
    schema = sizes.select(*keys, F.lit(1).alias("_s")).schema
    return spark.createDataFrame([tuple(r) for r in rows], schema) if rows else None


def asof_backward(probe: DataFrame, ref: DataFrame, group_cols: list[str], value_col: str,
                  ref_value: str, bounds: Bounds, out: str,
                  probes_per_task: int | None = None, null_keys: bool = True) -> DataFrame:
    """Attach to each probe row ``ref[ref_value]`` of the last ref row with ``ref.value <= probe.value``.

    ``ref`` has ``group_cols``, ``value_col`` (unique per group), ``ref_value``
    and ``_b`` computed with the same ``bounds``. Probes with a NULL key, or
    below the group's first reference value, get NULL. All probe rows are
    kept, each exactly once. The probe is read twice (its buckets are counted
    first), and once more for NULL keys unless ``null_keys`` rules them out:
    give a narrow stored table. Its rows are salted by a hash of all their columns,
    so a row id among them spreads even equal values.
    """
    cols = probe.columns
    keys = [*group_cols, "_b"]
    has_key = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*group_cols, value_col]])
    p = probe.where(has_key).withColumn("_b", bucket_column(group_cols, value_col, bounds))
    salts = _salts(p, ref, keys, probes_per_task)
    r = ref.select(*group_cols, F.col(value_col), F.col(ref_value).alias("_rv"), "_b")
    if salts is None:
        p, r = (d.withColumn("_salt", F.lit(0)) for d in (p, r))
    else:
        of = F.coalesce(F.col("_s"), F.lit(1))
        p = (p.join(F.broadcast(salts), keys, "left")
             .withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in cols]), of).cast("int")))
        r = (r.join(F.broadcast(salts), keys, "left")
             .withColumn("_salt", F.explode(F.sequence(F.lit(0), of - 1))))
    row = F.struct(*[F.col(c) for c in cols])
    u = (p.select(*keys, "_salt", F.col(value_col).alias("_v"), F.lit(1).alias("_kind"),
                  row.alias("_row"), F.lit(None).cast("double").alias("_rv"))
         .unionByName(
             r.select(*keys, "_salt", F.col(value_col).alias("_v"), F.lit(0).alias("_kind"),
                      F.lit(None).cast(probe.select(row.alias("x")).schema["x"].dataType).alias("_row"),
                      F.col("_rv").cast("double").alias("_rv"))))
    w = (Window.partitionBy(*keys, "_salt").orderBy("_v", "_kind")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hit = (u.withColumn("_hit", F.last("_rv", ignorenulls=True).over(w))
           .where(F.col("_kind") == 1)
           .select("_row.*", F.col("_hit").alias(out)))
    if not null_keys:
        return hit
    return hit.unionByName(probe.where(~has_key).withColumn(out, F.lit(None).cast("double")))
