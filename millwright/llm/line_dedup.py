"""Operator 9: line dedup over levelled sorted runs.

Documents come in batches by descending ranges of doc_id.  A run is a stored
table of (key, owner, documents) sorted by key.  Each batch counts its keys,
merge-anti-joins them with the runs of every level, and adds a run of its own:
keys that no run holds get the batch's largest doc_id as owner, the others only
their further documents.  As later batches hold smaller ids, the owner is the
largest doc_id that holds the key.  A level that has gathered ``fan_out`` runs
is compacted into one run of the next.  The merged runs then say which keys are
in at least ``least`` documents; of those, every line goes but the owner's.

A line's key is the line with space and 0x09-0x0D stripped at both ends and A-Z
lower-cased, held as a 128-bit hash; keys shorter than ``shortest`` code points
take no part.

Defined cases: a null or empty text is one empty line; repeated doc_ids count as
one document; rows without a doc_id keep all their lines and count for nothing;
an empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import discard, forget, store, texts_of, unused

BLANK = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, shortest: int) -> bytes | None:
    key = line.strip(BLANK).lower()
    if len(key) < shortest or (len(key) < 4 * shortest and len(key.decode()) < shortest):
        return None
    return xxhash.xxh3_128_digest(key)


def line_keys(docs: DataFrame, shortest: int) -> DataFrame:
    """key, doc_id: the keys of each document, once each."""

    def run(batches):
        forget()
        for batch in batches:
            keys, ids = [], []
            for i, text in zip(batch["doc_id"].to_pylist(), texts_of(batch)):
                own = {line_key(x, shortest) for x in text.encode().split(b"\n")} - {None}
                keys += own
                ids += [i] * len(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], names=["key", "doc_id"]
            )

    told = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null and text is not null")
    return told.mapInArrow(run, "key binary, doc_id long")


#: What decides which lines go, and how the runs are kept.
LIMITS = {"shortest": 20, "least": 3, "batches": 4, "fan_out": 2}


class Runs:
    """Runs by level; ``fan_out`` runs of a level are compacted into one of the next."""

    def __init__(self, fan_out: int):
        self.fan_out, self.levels = fan_out, []

    def all(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    @staticmethod
    def merged(runs: list[DataFrame]) -> DataFrame:
        rows = runs[0]
        for r in runs[1:]:
            rows = rows.unionByName(r)
        return rows.groupBy("key").agg(F.max("owner").alias("owner"), F.sum("documents").alias("documents"))

    def add(self, batch: DataFrame) -> None:
        """batch: key, owner (its largest doc_id), documents."""
        if held := self.all():
            keys = held[0].select("key")
            for r in held[1:]:
                keys = keys.unionByName(r.select("key"))
            batch = store(batch, "line-batch")
            fresh = batch.join(keys, "key", "left_anti")
            again = batch.join(keys, "key", "left_semi").withColumn("owner", F.lit(None).cast("long"))
            run = fresh.unionByName(again)
        else:
            run = batch
        self._put(0, store(run.sortWithinPartitions("key"), "line-run"))
        if held:
            discard(batch)

    def _put(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(full := self.levels[level]) >= self.fan_out:
            self.levels[level] = []
            self._put(level + 1, store(self.merged(full).sortWithinPartitions("key"), "line-run"))
            discard(*full)


def repeated_keys(docs: DataFrame, shortest: int, least: int, batches: int, fan_out: int) -> DataFrame:
    """key, owner, doc_id: for each key in at least ``least`` documents, the documents that lose it."""
    keys = store(line_keys(docs, shortest), "line-keys")
    lo, hi = keys.agg(F.min("doc_id"), F.max("doc_id")).first()
    if lo is None:
        return keys.withColumn("owner", F.lit(None).cast("long"))
    runs, step = Runs(fan_out), -(-(hi - lo + 1) // batches)
    for b in range(batches - 1, -1, -1):
        rows = keys.where(F.col("doc_id").between(lo + b * step, lo + (b + 1) * step - 1))
        own = rows.distinct().groupBy("key").agg(F.max("doc_id").alias("owner"), F.count("*").alias("documents"))
        runs.add(own)
    final = Runs.merged(runs.all()).where(F.col("documents") >= least).select("key", "owner")
    return keys.join(final, "key").where("doc_id <> owner").distinct()


def drop_lines(docs: DataFrame, shortest: int = 20, least: int = 3, batches: int = 4, fan_out: int = 2) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (the text left, null where no line is dropped and text is null)."""
    lose = (
        repeated_keys(docs, shortest, least, batches, fan_out)
        .groupBy("doc_id")
        .agg(F.collect_set("key").alias("lost_keys"))
        .withColumnRenamed("doc_id", "lost_id")
    )

    def run(parts):
        forget()
        for batch in parts:
            n, dropped, kept = [], [], []
            for text, lost in zip(batch["text"].to_pylist(), batch["lost_keys"].to_pylist()):
                raw = (text or "").encode()
                if not lost:
                    n.append(raw.count(b"\n") + 1)
                    dropped.append(0)
                    kept.append(raw)
                    continue
                gone, lines = set(lost), raw.split(b"\n")
                left = [x for x in lines if line_key(x, shortest) not in gone]
                n.append(len(lines))
                dropped.append(len(lines) - len(left))
                kept.append(b"\n".join(left))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array(n, pa.int64()),
                    pa.array(dropped, pa.int64()),
                    pa.array([k.decode() for k in kept], pa.string()),
                ],
                names=["doc_id", "n_lines", "n_dropped", "kept"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return (
        rows.join(lose, rows["doc_id"] == lose["lost_id"], "left")
        .select("doc_id", "text", "lost_keys")
        .mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept string")
    )


def replace_texts(docs: DataFrame, **limits) -> DataFrame:
    """The rows and columns of ``docs``, with the lines gone from ``text`` and ``n_chars`` (if there) made to fit.

    Texts that lose nothing, null ones among them, stay as they are, and only the others go through
    Python. Other columns may have any names.
    """
    lost = repeated_keys(docs, *(limits.get(k, v) for k, v in LIMITS.items()))
    id_name, keys_name = unused("lost_id", docs.columns), unused("lost_keys", docs.columns)
    lost = lost.groupBy(F.col("doc_id").alias(id_name)).agg(F.collect_set("key").alias(keys_name))
    shortest = limits.get("shortest", LIMITS["shortest"])

    def cut(parts):
        forget()
        for batch in parts:
            out = []
            for text, keys in zip(batch["text"].to_pylist(), batch[keys_name].to_pylist()):
                if keys and text is not None:
                    gone = set(keys)
                    text = "\n".join(x for x in text.split("\n") if line_key(x.encode(), shortest) not in gone)
                out.append(text)
            at = batch.schema.get_field_index("text")
            columns = [pa.array(out, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays(columns[:-1], names=names[:-1])

    rows = docs.join(lost, docs["doc_id"].cast("long") == lost[id_name], "left").drop(id_name)
    whole = rows.where(F.col(keys_name).isNull()).drop(keys_name)
    kept = rows.where(F.col(keys_name).isNotNull()).mapInArrow(cut, docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        kept = kept.withColumn("n_chars", F.char_length("text").cast(kind))
    return whole.unionByName(kept)


def op9_line_dedup(docs: DataFrame) -> DataFrame:
    return drop_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, l.i AS i, l.x AS x,
         translate(trim(l.x, e' \t\n\x0B\f\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda y, j: {'x': y, 'i': j})) AS l
        FROM documents)),
found AS (
  SELECT k, max(doc_id) AS owner FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM (SELECT l.*, coalesce(f.owner <> l.doc_id, false) AS gone FROM lines l LEFT JOIN found f ON l.k = f.k)
GROUP BY doc_id
"""
