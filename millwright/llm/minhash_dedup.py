"""Operator 1: near-dedup by an inverted join over MinHash coordinates.

A document's signature has ``COORDS`` coordinates.  It is posted under pairs of
(coordinate, value); two documents whose sets have Jaccard similarity s collide in
each coordinate with probability s, so those at 0.8 or more collide in at least
``MATCHES`` of them but for about one pair in a million.

Only prefixes are merged: a document's coordinates are ordered by the length of
their lists, and its ``MATCHES - 1`` longest are skipped.  Two documents that share
``MATCHES`` coordinates then still meet in one of the others.  The skipped lists are
probed instead: each posting carries a byte of every coordinate, and the collisions
of a pair are counted from these bytes (a byte can only add collisions).  It also
carries an odd sketch of the set, a bit for the parity of the shingles hashed to it: two
sketches differ in no more bits than their sets in shingles, which rules out most pairs
that are only rather alike.  Pairs above the threshold are confirmed on their full sets.

A group of near copies never becomes all its pairs.  Equal sets are one node.  In a few
rounds each list is linked as a star: the members outside its largest component so far
are held against one member of that, another one each time.  This joins nearly all of a
group.  At the end the members still outside are held against the whole list, and only
across components: pairs inside one cannot change it.  Every pair left out is thus
either under the threshold or already connected.

Defined cases: a null, empty or blank text has an empty set, no link, and itself as
component; sets under four shingles can only link with equal ones; repeated rows of
a doc_id are one document, linked if any of its texts is; a null doc_id links with
nothing, has a null component and is kept; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import MIX, MIX2, RunHash, discard, forget, store

COORDS, MATCHES = 32, 14
SKETCH = 512
_rng = np.random.default_rng(20240607)
SEEDS = _rng.integers(1, 2**63, COORDS).astype(np.uint64)
FACTORS = _rng.integers(1, 2**63, COORDS).astype(np.uint64) | np.uint64(1)
_HASH = RunHash(marks=True)


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words; of all words, if fewer."""
    h = _HASH.of(text)
    n = len(h)
    if not n:
        return h
    width = min(size, n)
    out = h[: n - width + 1].copy()
    for i in range(1, width):
        out = (out ^ (out >> np.uint64(31))) * MIX + h[i : n - width + 1 + i]
    out = (out ^ (out >> np.uint64(29))) * MIX2 + np.uint64(width)
    return np.unique(out ^ (out >> np.uint64(32)))


def signature(hashes: np.ndarray) -> np.ndarray:
    out = np.full(COORDS, np.iinfo(np.uint64).max)
    for lo in range(0, len(hashes), 16384):
        x = (hashes[lo : lo + 16384, None] ^ SEEDS) * FACTORS
        out = np.minimum(out, (x ^ (x >> np.uint64(32))).min(axis=0))
    return out


def odd_sketch(hashes: np.ndarray) -> np.ndarray:
    """Bit i: the parity of the number of hashes whose highest bits are i."""
    at = (hashes >> np.uint64(64 - SKETCH.bit_length() + 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=SKETCH).astype(np.uint8) & 1).view("<i8")


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, set_key (128-bit hash of the set, null if empty), sig, odd (the sketch)."""

    def run(batches):
        forget()
        for batch in batches:
            ids = batch["doc_id"].to_pylist()
            for lo in range(0, len(ids), 512):
                sets = [shingles(t, size) for t in batch["text"].slice(lo, 512).to_pylist()]
                sigs = [signature(s).astype(np.int64) if len(s) > 3 else np.empty(0, np.int64) for s in sets]
                odds = [odd_sketch(s) if len(s) > 3 else np.empty(0, np.int64) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[lo : lo + 512], pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        *(
                            pa.ListArray.from_arrays(
                                pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(np.concatenate(x))
                            )
                            for x in (sigs, odds)
                        ),
                    ],
                    names=["doc_id", "n_shingles", "set_key", "sig", "odd"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sig array<long>, odd array<long>")


#: Seven coordinates' lowest bytes to a long: with the top byte free, sums stay in range.
PACK = 7
PARTS = [f"s{p}" for p in range(-(-COORDS // PACK))]


def _packed(sig: str, part: int) -> Column:
    out = F.lit(0).cast("long")
    for place, i in enumerate(range(part * PACK, min(COORDS, (part + 1) * PACK))):
        out = out.bitwiseOR(F.shiftleft(F.col(sig)[i].bitwiseAND(F.lit(255)), 8 * place))
    return out


def _collisions(a: str, b: str) -> Column:
    """How many coordinates' bytes agree: zero bytes of the xor, counted without a loop."""
    low, high = F.lit(0x7F7F7F7F7F7F7F), F.lit(0x80808080808080)
    total = F.lit(COORDS - PACK * len(PARTS))  # the unused places of the last part always agree
    for p in PARTS:
        x = F.col(f"{a}.{p}").bitwiseXOR(F.col(f"{b}.{p}"))
        nonzero = (x.bitwiseAND(low) + low).bitwiseOR(x).bitwiseAND(high)
        total = total + PACK - F.bit_count(nonzero)
    return total


ODD = [f"o{i}" for i in range(SKETCH // 64)]
BODY = ["node", "n", *PARTS, *ODD]


def _alike(a: str, b: str, share: int) -> Column:
    """Pairs that can qualify: sizes near enough, enough collisions, sketches near enough.

    At a similarity of ``share`` percent the sets differ in at most d shingles, and their
    sketches in at most d bits; where many shingles fall on one bit, in about
    (bits / 2) * (1 - exp(-2 d / bits)), six standard deviations being allowed.
    """
    small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    differ = F.lit(0)
    for o in ODD:
        differ = differ + F.bit_count(F.col(f"{a}.{o}").bitwiseXOR(F.col(f"{b}.{o}")))
    most = (small + large) * ((100 - share) / (100 + share))
    mean = SKETCH / 2 * (1 - F.exp(most * (-2 / SKETCH)))
    return (
        (F.lit(100) * small >= F.lit(share) * large)
        & (_collisions(a, b) >= MATCHES)
        & (differ <= F.least(most, mean + 6 * F.sqrt(mean)) + 1e-6)
    )


def postings(sigs: DataFrame) -> DataFrame:
    """coord, value, and the body: each node under its prefix of lists that have company.

    ``sigs``, a stored table, is deleted once its nodes are written.
    """
    parts = [_packed("sig", i).alias(p) for i, p in enumerate(PARTS)]
    parts += [F.col("odd")[i].alias(o) for i, o in enumerate(ODD)]
    nodes = sigs.where(F.size("sig") > 0).groupBy("set_key").agg(
        F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("odd").alias("odd")
    )
    nodes = store(nodes.drop("set_key"), "minhash-nodes")
    discard(sigs)
    posted = nodes.select("node", F.posexplode("sig").alias("coord", "value"))
    lists = posted.groupBy("coord", "value").agg(F.count("*").alias("length")).where("length > 1")
    # stored, so that the shuffles of all coordinates are gone before those with company are dealt by node
    met = store(posted.join(lists, ["coord", "value"]), "met-postings")
    kept = (
        met.groupBy("node")
        .agg(F.sort_array(F.collect_list(F.struct("length", "coord", "value"))).alias("lists"))
        .where(F.size("lists") >= MATCHES)
        .select("node", F.explode(F.expr(f"slice(lists, 1, size(lists) - {MATCHES - 1})")).alias("l"))
        .select("node", "l.coord", "l.value")
    )
    out = store(kept.join(nodes.select("node", "n", *parts), "node"), "minhash-postings")
    discard(nodes, met)
    return out


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest node reachable), from the links (a, b); stars are swapped until stable."""
    links = store(links.select("a", "b").where("a <> b").distinct(), "links")
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # now each node points down; join each node's lower neighbours to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        after = store(small.unionByName(low.withColumnRenamed("m", "b")).distinct(), "links")
        discard(links)
        links = after
        # done when each node has one root and no root points on
        tops = links.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("b"))
        onward = links.join(links.select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1)
        if not tops.where("n > 1").limit(1).count() and not onward.count():
            return links.select(F.col("a").alias("node"), F.col("b").alias("component"))


#: Bits of the map of wanted ids; as words of 64 it is what is broadcast, at any number of ids.
MAP_BITS = 2**23


def wanted(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose id's bit is set in a map of ``ids``: all that are wanted and a few others.

    It spares the other texts the way through a shuffle.
    """
    place = F.pmod(F.xxhash64("id"), F.lit(MAP_BITS))
    word, bit = F.shiftright(place, 6), F.expr("shiftleft(1L, cast(place % 64 as int))")
    found = ids.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    mapped = texts.select("*", place.alias("place"))
    mine = (word == F.col("word")) & (F.col("bits").bitwiseAND(bit) != 0)
    return mapped.join(F.broadcast(found), mine, "left_semi").drop("place")


def confirm(pairs: DataFrame, docs: DataFrame, size: int, share: int, merge: bool = False, spread: int = 256) -> DataFrame:
    """a, b of the pairs (a, b) whose full sets qualify.

    A text travels once for each of its pairs: as member to its hub b, whose text
    comes first.  With ``merge`` the join with the texts is a merge join at every size.  A hub with more than ``spread`` members is copied to several salts.
    """
    hubs = pairs.groupBy(F.col("b").alias("hub")).agg(F.count("*").alias("members"))
    hubs = hubs.withColumn("salts", F.ceil(F.col("members") / spread).cast("int"))
    members = pairs.join(hubs, pairs["b"] == hubs["hub"]).select(
        F.col("a").alias("id"), "hub", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"), "a"
    )
    salts = F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
    centres = hubs.select(F.col("hub").alias("id"), "hub", salts, F.lit(None).cast("long").alias("a"))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    texts = wanted(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), ids)
    texts = texts.hint("merge") if merge else texts
    sent = members.unionByName(centres).join(texts, "id")

    def run(batches):
        forget()
        here, sets = None, []
        for batch in batches:
            out = []
            for hub, a, text in zip(*(batch[c].to_pylist() for c in ("hub", "a", "text"))):
                own = shingles(text, size)
                if a is None:
                    sets = [*sets, own] if here == hub else [own]
                    here = hub
                    continue
                for other in sets if here == hub else ():
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    if both and 100 * both >= share * (len(own) + len(other) - both):
                        out.append((a, hub))
                        break
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], names=["a", "b"]
            )

    return (
        sent.repartition("hub", "salt")
        .sortWithinPartitions("hub", "salt", F.col("a").asc_nulls_first())
        .select("hub", "a", "text")
        .mapInArrow(run, "a long, b long")
    )


def link_near(sigs: DataFrame, docs: DataFrame, size: int, share: int, rounds: int = 3) -> DataFrame:
    """node, component for the nodes (smallest doc_id of a set) that have a link to another set.

    ``sigs``, a stored table, is deleted once its nodes are written.
    """
    posted = postings(sigs)
    key = ["coord", "value"]
    joined, rest, source = None, posted.withColumn("component", F.col("node")), posted

    def against(left: DataFrame, right: DataFrame, extra: Column | None = None) -> DataFrame:
        met = (F.col("l.coord") == F.col("r.coord")) & (F.col("l.value") == F.col("r.value"))
        met = met & (F.col("l.node") != F.col("r.node")) & _alike("l", "r", share)
        return left.alias("l").join(right.alias("r"), met if extra is None else met & extra)

    def open_lists(step: int) -> DataFrame:
        """Postings of the lists with several components, with the largest one as ``main``."""
        named = rest
        if joined is not None:
            named = rest.drop("component").join(joined, "node", "left")
            named = named.withColumn("component", F.coalesce("component", "node"))
        named = store(named, "named-postings")
        discard(source)
        counted = named.groupBy(*key, "component").agg(F.count("*").alias("members"))
        turn = F.xxhash64("component", "coord", F.lit(step))
        main = counted.groupBy(*key).agg(
            F.max(F.struct("members", turn, "component")).alias("top"), F.count("*").alias("parts")
        )
        main = main.where("parts > 1").select(*key, F.col("top.component").alias("main"))
        out = store(named.join(main, key), "open-postings")
        discard(named)
        return out

    def with_links(pairs: DataFrame) -> DataFrame:
        found = store(confirm(pairs, docs, size, share, merge=joined is None), "near-links")
        links = found
        if joined is not None:
            links = found.unionByName(joined.select(F.col("node").alias("a"), F.col("component").alias("b")))
        out = components(links)
        discard(found, *([joined] if joined is not None else []))
        return out

    for step in range(rounds):
        lists = open_lists(step)
        hub = lists.where("component = main").groupBy(*key).agg(
            F.min(F.struct(F.xxhash64("node", "coord", F.lit(step)), *BODY)).alias("c")
        )
        stars = against(lists.where("component <> main"), hub.select(*key, "c.*")).groupBy(F.col("l.node").alias("a"))
        best = F.max(F.struct(_collisions("l", "r").alias("hits"), F.col("r.node").alias("b"))).alias("best")
        pairs = store(stars.agg(best).select("a", "best.b"), "star-pairs")
        joined = with_links(pairs)
        discard(pairs)
        rest, source = lists.drop("main"), lists

    # what is left: members outside the largest component of a list, against the whole list
    lists = open_lists(rounds)
    across = (F.col("l.component") != F.col("r.component")) & (
        (F.col("r.component") == F.col("r.main")) | (F.col("l.node") < F.col("r.node"))
    )
    pairs = against(lists.where("component <> main"), lists, across)
    pairs = store(pairs.select(F.col("l.node").alias("a"), F.col("r.node").alias("b")).distinct(), "cross-pairs")
    out = with_links(pairs)
    discard(lists, pairs)
    return out


def near_dedup(docs: DataFrame, size: int = 2, share: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of ``docs``.

    Links documents whose sets of ``size``-word shingles have 100 * intersection >= ``share`` * union.
    """
    wide = store(signatures(docs, size), "minhash")
    sigs = store(wide.select("doc_id", "n_shingles", "set_key"), "minhash-sets")
    told = sigs.where("doc_id is not null")
    linked = link_near(wide.where("doc_id is not null"), docs.where("doc_id is not null"), size, share)
    # classes of equal sets, and the rows of one doc_id, are links too
    classes = told.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("node"))
    member = told.where("set_key is not null").select("doc_id", "set_key").distinct()
    equal = member.join(classes, "set_key").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    apart = equal.join(linked, equal["b"] == linked["node"], "left").select(
        "a", F.coalesce("component", "b").alias("b")
    )
    apart = store(apart.distinct(), "class-links")
    twice = apart.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("n")).where("n > 1").limit(1).count()
    if twice:  # a doc_id with several texts joins their components
        whole = components(apart)
    else:
        whole = apart.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = whole.select(F.col("node").alias("found_id"), F.col("component").alias("found"))
    return sigs.join(found, F.col("doc_id") == F.col("found_id"), "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("found", "doc_id").alias("component_id"),
        (F.coalesce("found", "doc_id") == F.col("doc_id")).alias("kept"),
    ).withColumn("kept", F.coalesce("kept", F.lit(True)))


def op1_near_dedup(docs: DataFrame) -> DataFrame:
    return near_dedup(docs, size=2, share=80)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(
           regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                 '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(t) = 1 THEN [t[1]]
           ELSE list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = d.doc_id
"""
