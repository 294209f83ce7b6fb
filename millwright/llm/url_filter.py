"""URL filter: rules first, and an exact block list in a cascade of Bloom filters for all other URLs.

A rule is a host and the start of a path; it fits that host and all its subdomains.  Where no rule
fits, the host decides: it is blocked if it is *listed*.  The query lists each host with a page that
a rule blocks (``hosts_of_blocked``); ``cascade`` takes any list.

The list is never joined to the pages.  All keys of the corpus are known, so a cascade over this
universe is exact: level 1 is a Bloom filter of the listed keys; level 2 holds the other keys that
pass level 1 by mistake, level 3 the listed keys that pass level 2 by mistake, and so on until a
level has no false positive.  A key of the universe is listed if the first level that does not hold
it is an even one, or if it passes all of an odd number of levels.  A key outside the universe has
no exact answer and must not be asked.

Size: universe keys are dealt by hash to shards of some ``SHARD_KEYS`` and each shard builds its own
cascade in one task, from distinct 128-bit key hashes made by one aggregation (a host of a billion
pages is one row after the map side).  A cascade takes a few bits a listed key.  Pages read shards
in batches of at most ``BATCH_BYTES`` together, each a pass over narrow stored rows; one batch,
so one pass without any shuffle of the pages, covers a list of some 100 million hosts.

Defined cases: a null url, or one without ``://``, has an empty host and path; an empty host is no
key and allowed.  A URL without ``/`` after its host has an empty path, which no rule fits.  The
longest fitting rule (host and path together) wins, of equally long ones that with the longer host.
Repeated rows are judged each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import MIX, MIX2, store

#: Rules of the query: (verdict, host, start of the path).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
SHARD_KEYS = 1 << 20
BATCH_BYTES = 64 << 20


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z lower-cased, and path of a URL."""
    part = lambda pattern: F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))
    host = F.translate(part(r"^[\s\S]*?://([^/?#]*)"), string.ascii_uppercase, string.ascii_lowercase)
    return host, part(r"^[\s\S]*?://[^/?#]*([^?#]*)")


def apply_rules(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``page_id, host, path, rule, ruled``: the winning rule and its verdict, null where none fits."""
    host, path = split_url(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r))
    rule = verdict = F.lit(None).cast("string")
    for what, name, start in reversed(order):
        fits = (F.concat(F.lit("."), "host").endswith("." + name)) & F.col("path").startswith(start)
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return parts.select("*", rule.alias("rule"), verdict.alias("ruled"))


def key_hashes(key: str) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a key; a shard and all levels use these only."""
    return F.xxhash64(F.lit("cascade"), F.col(key)), F.xxhash64(F.lit("other"), F.col(key))


def positions(h1: np.ndarray, h2: np.ndarray, level: int, i: int, bits: np.ndarray) -> np.ndarray:
    """The ``i``-th bit of each key in a filter of ``bits`` bits at a level; levels are independent."""
    x = (h1 ^ np.uint64((level * 64 + i + 1) * int(MIX) % 2**64)) * MIX2
    x = (x ^ (x >> np.uint64(31)) ^ h2) * MIX
    return (x ^ (x >> np.uint64(29))) % bits


def build_levels(listed: np.ndarray, others: np.ndarray) -> list[tuple[int, int, bytes]]:
    """(bits, hashes, bit array) of each level; ``listed`` and ``others`` are two-column key hashes."""
    levels = []
    inside, outside = listed, others
    while len(inside):
        level = len(levels) + 1
        if level > 63:
            raise ValueError("two keys of one shard share both hashes")
        # the first level leaves as many false positives as there are listed keys over the root of two
        rate = min(0.5, len(inside) * math.sqrt(0.5) / max(1, len(outside))) if level == 1 else 0.5
        hashes = max(1, round(-math.log2(rate)))
        bits = max(64, math.ceil(len(inside) * -math.log2(rate) / math.log(2)))
        held = np.zeros(bits, np.uint8)
        n = np.uint64(bits)
        for i in range(hashes):
            held[positions(inside[:, 0], inside[:, 1], level, i, n)] = 1
        passed = np.ones(len(outside), bool)
        for i in range(hashes):
            passed &= held[positions(outside[:, 0], outside[:, 1], level, i, n)] == 1
        levels.append((bits, hashes, np.packbits(held, bitorder="little").tobytes()))
        inside, outside = outside[passed], inside
    return levels


class Cascades:
    """Cascades of some shards as one byte array, asked for many keys of any of these shards at once."""

    def __init__(self, rows: list[tuple[int, list[tuple[int, int, bytes]]]]):
        depth = max((len(levels) for _, levels in rows), default=0)
        self.shards = np.array(sorted(s for s, _ in rows), np.int64)
        self.depth = np.zeros(len(rows), np.int64)
        self.bits, self.hashes, self.start = (np.zeros((len(rows), depth), np.int64) for _ in range(3))
        blobs, at = [], 0
        for i, (_, levels) in enumerate(sorted(rows)):
            self.depth[i] = len(levels)
            for j, (bits, hashes, blob) in enumerate(levels):
                self.bits[i, j], self.hashes[i, j], self.start[i, j] = bits, hashes, at
                blobs.append(blob)
                at += len(blob)
        self.data = np.frombuffer(b"".join(blobs), np.uint8)

    def holds(self, shard: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(known, listed): which keys are of these shards, and which of those are listed."""
        listed = np.zeros(len(shard), bool)
        if not len(self.shards):
            return listed.copy(), listed
        row = np.minimum(np.searchsorted(self.shards, shard), len(self.shards) - 1)
        known = self.shards[row] == shard
        left = np.flatnonzero(known)
        for j in range(self.bits.shape[1]):
            through = left[self.depth[row[left]] > j]
            ends = left[self.depth[row[left]] <= j]
            listed[ends] = j % 2 == 1  # passed all of j levels
            r = row[through]
            inside = np.ones(len(through), bool)
            for i in range(int(self.hashes[r, j].max()) if len(r) else 0):
                p = positions(h1[through], h2[through], j + 1, i, self.bits[r, j].astype(np.uint64)).astype(np.int64)
                bit = (self.data[self.start[r, j] + (p >> 3)] >> (p & 7).astype(np.uint8)) & 1
                inside &= (bit == 1) | (self.hashes[r, j] <= i)
            listed[through[~inside]] = j % 2 == 1  # level j + 1 is the first without the key
            left = through[inside]
        listed[left] = self.bits.shape[1] % 2 == 1
        return known, listed


def cascade(keys: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """The cascades of the universe ``keys`` (``key``, ``listed``: any of its rows lists a key), stored.

    Returns ``shard, levels`` and the number of shards.
    """
    universe = keys.groupBy("key").agg(F.max("listed").alias("listed"))
    h1, h2 = key_hashes("key")
    universe = store(universe.select(h1.alias("h1"), h2.alias("h2"), "listed"), "universe")
    shards = max(1, math.ceil(universe.count() / shard_keys))

    def build(table: pa.Table) -> pa.Table:
        hashes = np.stack([table[c].to_numpy().astype(np.int64).view(np.uint64) for c in ("h1", "h2")], axis=1)
        listed = table["listed"].to_numpy(zero_copy_only=False).astype(bool)
        levels = build_levels(hashes[listed], hashes[~listed])
        rows = [{"bits": b, "hashes": k, "held": blob} for b, k, blob in levels]
        kind = pa.list_(pa.struct([("bits", pa.int64()), ("hashes", pa.int32()), ("held", pa.binary())]))
        return pa.table({"shard": table["shard"][:1], "levels": pa.array([rows], kind)})

    dealt = universe.select(F.pmod("h1", F.lit(shards)).alias("shard"), "h1", "h2", "listed")
    built = dealt.groupBy("shard").applyInArrow(
        build, "shard long, levels array<struct<bits: long, hashes: int, held: binary>>")
    return store(built, "cascade"), shards


def ask(df: DataFrame, key: str, cascades: DataFrame, shards: int, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Adds ``listed``: whether the key is in the list; null for a null key.

    The sizes of all shards (a pair of numbers for each 2**20 keys) come to the driver; the shards
    themselves in batches of at most ``batch_bytes``, or of one shard if that alone is larger.
    """
    spark = df.sparkSession
    size = F.aggregate("levels", F.lit(0).cast("long"), lambda s, x: s + F.length(x["held"]))
    sizes = sorted(tuple(r) for r in cascades.select("shard", size).collect())
    batches, room = [], 0
    for shard, n in sizes:
        if not batches or n > room:
            batches.append([])
            room = batch_bytes
        batches[-1].append(shard)
        room -= n
    h1, h2 = key_hashes(key)
    cols = [F.col(c) for c in df.columns]
    out = df.select(*cols, h1.alias("__h1"), h2.alias("__h2"), F.lit(None).cast("boolean").alias("listed"))

    def pass_over(rows: DataFrame, held) -> DataFrame:
        def judge(batches):
            c = Cascades(held.value)
            for b in batches:
                a, z = (b[x].to_numpy(zero_copy_only=False).view(np.uint64) for x in ("__h1", "__h2"))
                shard = np.mod(a.view(np.int64), shards)
                known, listed = c.holds(shard, a, z)
                now = pa.array(listed, mask=~known | b[key].is_null().to_numpy(zero_copy_only=False))
                yield b.set_column(b.schema.get_field_index("listed"), "listed", pc.coalesce(now, b["listed"]))

        return rows.mapInArrow(judge, rows.schema)

    for i, batch in enumerate(batches):
        found = cascades.where(F.col("shard").between(batch[0], batch[-1])).collect()
        held = [(r["shard"], [(x["bits"], x["hashes"], bytes(x["held"])) for x in r["levels"]]) for r in found]
        out = pass_over(out, spark.sparkContext.broadcast(held))
        if i + 1 < len(batches):
            out = store(out, "asked")
    return out.drop("__h1", "__h2")


def hosts_of_blocked(ruled: DataFrame) -> DataFrame:
    """The universe of hosts; a host is listed if a rule blocks one of its pages."""
    key = F.when(F.col("host") != "", F.col("host"))
    blocked = F.coalesce(F.col("ruled") == "block", F.lit(False))
    return ruled.select(key.alias("key"), blocked.alias("listed")).where("key is not null")


def op11_url_filter(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    ruled = apply_rules(pages, rules)
    cascades, shards = cascade(hosts_of_blocked(ruled))
    asked = ask(ruled.withColumn("key", F.when(F.col("host") != "", F.col("host"))), "key", cascades, shards)
    own = F.when(F.coalesce("listed", F.lit(False)), "block").otherwise("allow")
    return asked.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"))


ORACLE = r"""
WITH p AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^[\s\S]*?://([^/?#]*)', 1), ''),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^[\s\S]*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules AS (
  SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                        ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) AS v(ruled, name, start)),
fits AS (
  SELECT page_id, host, path, max_by(struct_pack(rule := name || start, ruled := ruled), length(name || start)) AS best
  FROM (SELECT DISTINCT page_id, host, path FROM p) AS u JOIN rules ON ends_with('.' || host, '.' || name) AND starts_with(path, start)
  GROUP BY page_id, host, path),
judged AS (
  SELECT p.page_id, p.host, p.path, best.rule AS rule, best.ruled AS ruled
  FROM p LEFT JOIN fits ON p.page_id IS NOT DISTINCT FROM fits.page_id AND p.host = fits.host AND p.path = fits.path),
listed AS (SELECT DISTINCT host FROM judged WHERE ruled = 'block' AND host <> '')
SELECT page_id, host, path, rule,
  coalesce(ruled, CASE WHEN host IN (SELECT host FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM judged
"""
