"""Trees over binned rows. Random forest: levels of large nodes by Spark, everything below them in one task.

* Bins: at most ``bins`` a feature, cut as Spark's own trees cut them, but from the counts of all
  rows (summaries of at most ``POINTS`` values that can be merged) and not from a sample.
* Blocks: a table of a row per block of rows, each feature a byte, stored once.
* Growing: a row's bootstrap weight (Poisson, mean 1) follows from its key and the tree's number,
  a node's features from its path, so nothing depends on partitioning. A node of more than
  ``LOCAL_ROWS`` rows is split by histograms that are summed over all tasks. The rows of a smaller one
  meet in one task, which grows the rest of its tree level by level, each level in a few array
  passes over the rows that are left. Trees are grown in waves whose rows fill at most ``WAVE_BYTES``.
* Leaves that say the same are merged, as Spark does.

A deep forest has as many histograms as nodes, nearly all of them of a few rows; summed over all
tasks, as Spark's own forest does, they are hundreds of times larger than the rows themselves.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.session import stored

# workers need not have this package: its functions travel with the tasks
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Values of a feature's summary; more than these are thinned to equal shares of the rows.
POINTS = 16_384
#: Rows of one block at most, and rows that a task grows a subtree of at most.
BLOCK_ROWS = 200_000
LOCAL_ROWS = 4_000_000
#: Bytes of rows that travel to the tasks of one wave of trees, about.
WAVE_BYTES = 1_000_000_000
#: Nodes whose histograms a task holds at once.
NODES_AT_ONCE = 512
LEAST_GAIN = 1e-12
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


# --- bins ------------------------------------------------------------------------------------------

Summary = tuple[np.ndarray, np.ndarray]


def thinned(values: np.ndarray, counts: np.ndarray, most: int) -> Summary:
    """Sorted distinct values with their counts; where there are more than ``most``, each stands for an equal share."""
    if len(values) <= most:
        return values, counts
    upto = np.cumsum(counts)
    at = np.searchsorted(upto, np.arange(1, most + 1) * (upto[-1] / most) - 0.5)
    at = np.unique(np.append(np.minimum(at, len(values) - 1), [0, len(values) - 1]))
    return values[at], np.diff(upto[at], prepend=0)


def merged(a: Summary, b: Summary, most: int = POINTS) -> Summary:
    values, where = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    return thinned(values, np.bincount(where, np.concatenate([a[1], b[1]]), len(values)), most)


def cuts(summary: Summary, bins: int) -> np.ndarray:
    """The thresholds of one feature: halfway between neighbours, nearest to equal shares (Spark's rule)."""
    values, counts = summary
    between = (values[:-1] + values[1:]) / 2.0
    if len(between) <= bins - 1:
        return between
    stride = counts.sum() / bins
    upto, target, out = np.cumsum(counts), stride, []
    for i in range(1, len(values)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            out.append(between[i - 1])
            target += stride
    return np.array(out)


def columns_of(batch: pa.RecordBatch, n: int) -> list[np.ndarray]:
    return [batch.column(f"x{i}").to_numpy(zero_copy_only=False) for i in range(n)]


def split_features(df: DataFrame, n: int) -> list[Column]:
    v = vector_to_array("features")
    return [v[i].alias(f"x{i}") for i in range(n)]


def fit_cuts(train: DataFrame, n: int, bins: int) -> list[np.ndarray]:
    """Thresholds of each of the ``n`` features from all rows; at most ``POINTS`` values of each reach the driver."""
    most = POINTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[Summary | None] = [None] * n
        for batch in batches:
            for i, x in enumerate(columns_of(batch, n)):
                one = thinned(*np.unique(x, return_counts=True), most)
                got[i] = merged(got[i], one, most) if got[i] else one
        rows = [(i, *(a.astype("float64").tobytes() for a in s)) for i, s in enumerate(got) if s]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))],
                                         names=["f", "v", "n"]) if rows else pa.RecordBatch.from_pylist([], pa.schema(
                                             [("f", pa.int32()), ("v", pa.binary()), ("n", pa.binary())]))

    def join(a: tuple[bytes, bytes], b: tuple[bytes, bytes]) -> tuple[bytes, bytes]:
        both = merged(*((np.frombuffer(v), np.frombuffer(c)) for v, c in (a, b)), most)
        return both[0].tobytes(), both[1].tobytes()

    parts = train.select(*split_features(train, n)).mapInArrow(count, "f int, v binary, n binary")
    found = dict(parts.rdd.map(lambda r: (r[0], (bytes(r[1]), bytes(r[2])))).reduceByKey(join, n).collect())
    empty = (b"", b"")
    return [cuts((np.frombuffer(v), np.frombuffer(c)), bins) for v, c in (found.get(i, empty) for i in range(n))]


def binned(columns: list[np.ndarray], cut: list[np.ndarray]) -> np.ndarray:
    """Rows of a byte per feature: at or below its ``b``-th threshold a value has a number of at most ``b``."""
    return np.stack([np.searchsorted(c, x, "left").astype(np.uint8) for x, c in zip(columns, cut)], axis=1)


def mix(z: np.ndarray) -> np.ndarray:
    """A well mixed 64-bit number for each one (splitmix)."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


BLOCK = "n int, key binary, y binary, x binary"


def blocks(train: DataFrame, cut: list[np.ndarray], id_column: str) -> DataFrame:
    """``train`` (id, ``label``, ``features``) as a stored table of blocks of binned rows.

    A row's key is the hash of all that it holds; rows that are alike are told apart by their number.
    """
    n, most = len(cut), BLOCK_ROWS

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append((batch.column("k").to_numpy().view(np.uint64), batch.column("y").to_numpy().astype(np.uint8),
                         binned(columns_of(batch, n), cut)))
            rows += batch.num_rows
            if rows >= most:
                yield block(held)
                held, rows = [], 0
        if rows:
            yield block(held)

    def block(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key, y, x = (np.concatenate(c) for c in zip(*held))
        if y.max() > 1:
            raise ValueError("labels other than 0 and 1")
        order = np.argsort(key, kind="stable")
        key, y, x = key[order], y[order], x[order]
        first = np.maximum.accumulate(np.where(np.append(True, key[1:] != key[:-1]), np.arange(len(key)), 0))
        key = mix(key + (np.arange(len(key)) - first).astype(np.uint64) * GOLDEN)
        return pa.RecordBatch.from_pylist([{"n": len(y), "key": key.tobytes(), "y": y.tobytes(), "x": x.tobytes()}],
                                          pa.schema([("n", pa.int32()), ("key", pa.binary()), ("y", pa.binary()), ("x", pa.binary())]))

    rows = train.select(F.xxhash64(id_column, "label", vector_to_array("features")).alias("k"), F.col("label").cast("int").alias("y"),
                        *split_features(train, n))
    return stored(rows.mapInArrow(pack, BLOCK), "binned")


# --- one tree --------------------------------------------------------------------------------------

@dataclass
class Tree:
    """Nodes as arrays: the feature (-1: a leaf) and bin of its split, its left child (the right one is next to it),
    the weights of the two classes and the gain of the split."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    whole: np.ndarray
    gain: np.ndarray


def poisson_table() -> np.ndarray:
    """Bootstrap weight by the first 20 bits of a hash."""
    p, upto, w, out = np.exp(-1.0), 0.0, 0, np.empty(1 << 20, np.uint8)
    at = 0
    while at < len(out):
        upto += p
        end = len(out) if w == 12 else round(upto * len(out))
        out[at:end] = w
        at, w, p = end, w + 1, p / (w + 1)
    return out


def weights(key: np.ndarray, tree: int, seed: int, table: np.ndarray) -> np.ndarray:
    salt = mix(np.array([seed * 1_000_003 + tree], np.uint64))
    return table[mix(key + salt) >> np.uint64(44)]


def features_of(path: np.ndarray, tree: int, seed: int, n: int, k: int) -> np.ndarray:
    """``k`` of ``n`` features of each node, in order."""
    salt = mix(np.array([~(seed * 1_000_003 + tree) & (2**64 - 1)], np.uint64))
    draw = mix(mix(path.astype(np.uint64) + salt)[:, None] + np.arange(1, n + 1, dtype=np.uint64) * GOLDEN)
    return np.sort(np.argsort(draw, axis=1)[:, :k], axis=1)


def histograms(x: np.ndarray, yw: np.ndarray, w: np.ndarray, node: np.ndarray, of: np.ndarray, bins: int) -> np.ndarray:
    """Class weights by (class, node, place in the node's features, bin); ``yw`` is the label, ``node`` counts from 0."""
    (m, k), n = of.shape, x.shape[1]
    flat, row = x.reshape(-1), np.arange(len(node)) * n
    out = np.empty((k, 2 * m * bins))
    base = (yw * m + node) * bins
    for j in range(k):
        out[j] = np.bincount(base + flat[row + of[:, j][node]], w, 2 * m * bins)
    return out.reshape(k, 2, m, bins).transpose(1, 2, 0, 3)


def best_splits(hist: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gini gain, place, bin and left class weights of each node's best split; no split has a gain of 0."""
    m, k, bins = hist.shape[1:]
    upto = np.cumsum(hist, axis=3)[..., :-1]
    rest = whole[:, :, None, None] - upto
    nl, nr = upto[0] + upto[1], rest[0] + rest[1]
    with np.errstate(divide="ignore", invalid="ignore"):
        s = (upto[0] ** 2 + upto[1] ** 2) / nl + (rest[0] ** 2 + rest[1] ** 2) / nr
    s[(nl <= 0) | (nr <= 0)] = -np.inf
    s = s.reshape(m, -1)
    at, i = s.argmax(axis=1), np.arange(m)
    n = whole[0] + whole[1]
    gain = (s[i, at] - (whole[0] ** 2 + whole[1] ** 2) / n) / n
    place, b = np.divmod(at, bins - 1)
    return gain, place, b, upto[:, i, place, b]


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, bins: int, k: int, tree: int, seed: int, path: int, depth: int) -> Tree:
    """The subtree of the node ``path`` (1 is the root) from its rows, ``depth`` levels at most."""
    n = x.shape[1]
    w = w.astype(np.float64)
    y = y.astype(np.int64)
    ones = float(w[y == 1].sum())
    start = np.array([[w.sum() - ones], [ones]])
    levels, path, sizes = [], np.array([path], np.int64), np.array([len(y)])
    whole, opened = start, (start > 0).all(axis=0)
    if not opened[0] or depth == 0:
        x, y, w = x[:0], y[:0], w[:0]
        path, sizes, opened = path[:0], sizes[:0], np.array([False])
    while True:
        # all nodes of this level; of its open ones also rows, in the nodes' order
        at = np.flatnonzero(opened)
        level = Tree(np.full(len(opened), -1, np.int8), np.zeros(len(opened), np.uint8), np.zeros(len(opened), np.int32),
                     whole, np.zeros(len(opened)))
        levels.append(level)
        if not len(at):
            break
        of = features_of(path, tree, seed, n, k)
        ends = np.cumsum(sizes)
        node = np.repeat(np.arange(len(at)), sizes)
        found = []
        for a in range(0, len(at), NODES_AT_ONCE):
            b = min(a + NODES_AT_ONCE, len(at))
            rows = slice(ends[a] - sizes[a], ends[b - 1])
            hist = histograms(x[rows], y[rows], w[rows], node[rows] - a, of[a:b], bins)
            found.append(best_splits(hist, whole[:, at[a:b]]))
        gain, place, cut, left = (np.concatenate(c, axis=-1) for c in zip(*found))
        split = gain > LEAST_GAIN
        s, i = at[split], np.flatnonzero(split)
        feature = of[np.arange(len(at)), place]
        level.feature[s], level.cut[s], level.gain[s] = feature[i], cut[i], gain[i]
        # children, left and right in turn
        whole = np.stack([left[:, i], whole[:, s] - left[:, i]], axis=2).reshape(2, -1)
        opened = (whole > 0).all(axis=0) if len(levels) < depth else np.zeros(2 * len(s), bool)
        goes = x.reshape(-1)[np.arange(len(node)) * n + feature[node]] > cut[node]
        rank = np.full(len(at), -1)
        rank[i] = np.arange(len(s))
        child = np.where(split[node], 2 * rank[node] + goes, -1)
        keep = np.flatnonzero((child >= 0) & np.append(opened, False)[child])
        # the rows that stay, ordered by child: within a parent the left ones first
        child, goes = child[keep], goes[keep]
        sizes_all = np.bincount(child, minlength=len(opened))
        begin = np.cumsum(sizes_all) - sizes_all
        rights = np.cumsum(goes)
        lefts = np.arange(1, len(goes) + 1) - rights
        # rows before this parent's first one that went left, or right
        parents = sizes_all.reshape(-1, 2)
        before = np.cumsum(parents, axis=0) - parents
        to = begin[child] + np.where(goes, rights - 1 - before[child >> 1, 1], lefts - 1 - before[child >> 1, 0])
        order = np.empty(len(keep), np.int64)
        order[to] = keep
        x, y, w = x[order], y[order], w[order]
        path = (2 * path[i][:, None] + np.arange(2)).reshape(-1)[opened]
        sizes = sizes_all[opened]
    return joined(levels)


def joined(levels: list[Tree]) -> Tree:
    """The levels' nodes one after the other; left children point into the whole."""
    out = Tree(*(np.concatenate([getattr(t, f) for t in levels], axis=-1) for f in ("feature", "cut", "left", "whole", "gain")))
    first = 0
    for t in levels:
        here = slice(first, first + len(t.feature))
        inner = t.feature >= 0
        out.left[here][inner] = first + len(t.feature) + 2 * np.arange(inner.sum())
        first += len(t.feature)
    return out


def pruned(t: Tree) -> Tree:
    """Merges leaves of one parent that predict the same, from below, and drops what is not reached."""
    says = t.whole[1] > t.whole[0]
    feature = t.feature.copy()
    while True:
        inner = np.flatnonzero(feature >= 0)
        a = t.left[inner]
        same = (feature[a] < 0) & (feature[a + 1] < 0) & (says[a] == says[a + 1])
        if not same.any():
            break
        feature[inner[same]] = -1
        says[inner[same]] = says[a[same]]
    # nodes that are reached, level by level
    kept, new, place = [np.array([0])], np.zeros(len(feature), np.int32), 1
    while len(at := kept[-1][feature[kept[-1]] >= 0]):
        new[at] = place + 2 * np.arange(len(at))
        kept.append((t.left[at][:, None] + np.arange(2)).reshape(-1))
        place += len(kept[-1])
    at = np.concatenate(kept)
    return Tree(feature[at], t.cut[at], new[at], t.whole[:, at], np.where(feature[at] >= 0, t.gain[at], 0.0))


def walk(t: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf of each binned row."""
    at, n = np.zeros(len(x), np.int32), x.shape[1]
    flat, rows = x.reshape(-1), np.arange(len(x)) if t.feature[0] >= 0 else np.arange(0)
    while len(rows):
        here = at[rows]
        here = t.left[here] + (flat[rows * n + t.feature[here]] > t.cut[here])
        at[rows] = here
        rows = rows[t.feature[here] >= 0]
    return at


# --- the forest ------------------------------------------------------------------------------------

def _read(block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.frombuffer(block.x, np.uint8)
    return np.frombuffer(block.key, np.uint64), np.frombuffer(block.y, np.uint8), x.reshape(block.n, -1)


def _tops(table: DataFrame, wave: list[int], rows: int, n: int, bins: int, k: int, depth: int, seed: int) -> dict[int, tuple[Tree, np.ndarray]]:
    """The upper part of each tree of a wave, and its nodes' paths: split until no open leaf has over ``LOCAL_ROWS`` rows.

    A round sums the histograms of all such nodes over all tasks; a few kilobytes for each reach the driver.
    """
    root = lambda: Tree(np.full(1, -1, np.int8), np.zeros(1, np.uint8), np.zeros(1, np.int32), np.zeros((2, 1)), np.zeros(1))
    tops = {t: (root(), np.array([1])) for t in wave}
    wide = {t: np.array([0]) for t in wave} if rows > LOCAL_ROWS else {}
    while wide:
        bag, upper = poisson_table, dict(tops)

        def count(part, wide=wide, upper=upper):
            table, got = bag(), {}
            for key, y, x in map(_read, part):
                for t, nodes in wide.items():
                    w = weights(key, t, seed, table)
                    where = np.full(len(upper[t][0].feature), -1)
                    where[nodes] = np.arange(len(nodes))
                    node = where[walk(upper[t][0], x)]
                    here = np.flatnonzero((w > 0) & (node >= 0))
                    of = features_of(upper[t][1][nodes], t, seed, n, k)
                    hist = histograms(x[here], y[here].astype(np.int64), w[here].astype(np.float64), node[here], of, bins)
                    size = np.bincount(node[here], minlength=len(nodes))
                    for i in range(len(nodes)):
                        a, b = got.get((t, i), (0.0, 0))
                        got[t, i] = a + hist[:, i], b + size[i]
            return iter(got.items())

        sums = table.rdd.mapPartitions(count).reduceByKey(lambda a, b: (a[0] + b[0], a[1] + b[1])).collectAsMap()
        more = {}
        for t, nodes in wide.items():
            top, path = tops[t]
            hist = np.stack([sums[t, i][0] for i in range(len(nodes))], axis=1)
            top.whole[:, nodes] = whole = hist[:, :, 0].sum(axis=2)
            size = np.array([sums[t, i][1] for i in range(len(nodes))])
            gain, place, cut, left = best_splits(hist, whole)
            ok = (gain > LEAST_GAIN) & (whole > 0).all(axis=0) & (path[nodes] < 2**depth)
            of = features_of(path[nodes], t, seed, n, k)
            i, s = np.flatnonzero(ok), nodes[ok]
            top.feature[s], top.cut[s], top.gain[s] = of[i, place[i]], cut[i], gain[i]
            top.left[s] = len(top.feature) + 2 * np.arange(len(s))
            below = np.stack([left[:, i], whole[:, i] - left[:, i]], axis=2).reshape(2, -1)
            m = below.shape[1]
            tops[t] = (Tree(np.append(top.feature, np.full(m, -1, np.int8)), np.append(top.cut, np.zeros(m, np.uint8)),
                            np.append(top.left, np.zeros(m, np.int32)), np.concatenate([top.whole, below], axis=1),
                            np.append(top.gain, np.zeros(m))),
                       np.append(path, (2 * path[s][:, None] + np.arange(2)).reshape(-1)))
            # a child has at most its weight of rows, and no more than its parent
            most = np.minimum(below.sum(axis=0), np.repeat(size[i], 2))
            large = (most > LOCAL_ROWS) & (below > 0).all(axis=0) & (tops[t][1][-m:] < 2**depth if m else np.zeros(0, bool))
            if large.any():
                more[t] = len(top.feature) + np.flatnonzero(large)
        wide = more
    return tops


def grow_forest(table: DataFrame, n: int, bins: int, trees: int, depth: int, k: int, seed: int) -> list[Tree]:
    """``trees`` trees over the blocks of ``table``, each of at most ``depth`` levels of splits."""
    rows = table.agg(F.sum("n")).first()[0] or 0
    if not rows:
        raise ValueError("no training rows")
    cores = table.sparkSession.sparkContext.defaultParallelism
    wave = max(cores, min(trees, int(WAVE_BYTES / (rows * 0.64 * (n + 2))) // cores * cores))
    out: list[Tree] = []
    for a in range(0, trees, wave):
        out += _wave(table, list(range(a, min(a + wave, trees))), rows, n, bins, depth, k, seed)
    return out


def _wave(table: DataFrame, wave: list[int], rows: int, n: int, bins: int, depth: int, k: int, seed: int) -> list[Tree]:
    tops = _tops(table, wave, rows, n, bins, k, depth, seed)
    place, jobs = {}, []  # a job for each open leaf of an upper part
    for t, (top, path) in tops.items():
        whole_tree = len(top.feature) == 1
        for i in np.flatnonzero(top.feature < 0):
            if whole_tree or ((top.whole[:, i] > 0).all() and path[i] < 2**depth):
                place[t, int(i)] = len(jobs)
                jobs.append((t, int(path[i])))

    def send(part):
        table = poisson_table()
        for key, y, x in map(_read, part):
            for t, (top, _) in tops.items():
                w = weights(key, t, seed, table)
                to = np.array([place.get((t, i), -1) for i in range(len(top.feature))])[walk(top, x)]
                to[w == 0] = -1
                for job in np.unique(to[to >= 0]).tolist():
                    here = to == job
                    yield job, (x[here].tobytes(), y[here].tobytes(), w[here].tobytes())

    def finish(part):
        held = {}
        for job, rows in part:
            held.setdefault(job, []).append(rows)
        while held:
            job, rows = held.popitem()
            x, y, w = (np.frombuffer(b"".join(c), np.uint8) for c in zip(*rows))
            t, path = jobs[job]
            tree = pruned(grow(x.reshape(-1, n), y, w, bins, k, t, seed, path, depth + 1 - path.bit_length()))
            yield job, [getattr(tree, f) for f in ("feature", "cut", "left", "whole", "gain")]

    done = {job: Tree(*t) for job, t in table.rdd.mapPartitions(send).partitionBy(len(jobs), int).mapPartitions(finish).collect()} if jobs else {}
    return [pruned(_hung(top, {i: done[place[t, i]] for i in range(len(top.feature)) if place.get((t, i), -1) in done})) if len(top.feature) > 1
            else done[place[t, 0]] if (t, 0) in place and place[t, 0] in done else top
            for t, (top, _) in tops.items()]


def _hung(top: Tree, below: dict[int, Tree]) -> Tree:
    """The upper part with a subtree in place of each of the named leaves."""
    out, size = [top], len(top.feature)
    for i, t in below.items():
        # the subtree's root takes the leaf's place, its other nodes come after all others
        shift = size - 1
        for f in ("feature", "cut", "gain"):
            getattr(top, f)[i] = getattr(t, f)[0]
        top.whole[:, i] = t.whole[:, 0]
        top.left[i] = t.left[0] + shift
        out.append(Tree(t.feature[1:], t.cut[1:], t.left[1:] + np.int32(shift), t.whole[:, 1:], t.gain[1:]))
        size += len(t.feature) - 1
    return Tree(*(np.concatenate([getattr(t, f) for t in out], axis=-1) for f in ("feature", "cut", "left", "whole", "gain")))


class ArrayModel:
    """A fitted model that is some arrays: scores on the workers, is saved as rows and loaded again."""

    def __init__(self, **arrays: np.ndarray):
        self.arrays = arrays
        self._sent = None

    def p1(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 of each row of features."""
        raise NotImplementedError

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``probability`` (a vector) and ``prediction`` to a table with ``features``."""
        if self._sent is None:
            self._sent = df.sparkSession.sparkContext.broadcast(self.arrays)
        sent, kind = self._sent, type(self)

        def score(v: pd.Series) -> pd.Series:
            return pd.Series(kind(**sent.value).p1(np.stack(v.to_numpy())) if len(v) else [], dtype="float64")

        score.__annotations__ = {"v": pd.Series, "return": pd.Series}
        p = F.pandas_udf(score, "double")(vector_to_array("features"))
        return (df.withColumn("_p1", p).withColumn("probability", array_to_vector(F.array(1.0 - F.col("_p1"), F.col("_p1"))))
                .withColumn("prediction", F.when(F.col("_p1") > 0.5, 1.0).otherwise(0.0)).drop("_p1"))

    def write(self) -> ArrayModel:
        return self

    def save(self, path: str) -> None:
        rows = [(name, str(a.dtype), list(a.shape), bytearray(a.tobytes())) for name, a in self.arrays.items()]
        spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        spark.createDataFrame(rows, "name string, dtype string, shape array<long>, data binary").write.parquet(path)

    @classmethod
    def load(cls, path: str):
        spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        return cls(**{r["name"]: np.frombuffer(r["data"], r["dtype"]).reshape(r["shape"]) for r in spark.read.parquet(path).collect()})


def packed_cuts(cut: list[np.ndarray]) -> dict[str, np.ndarray]:
    return {"cuts": np.concatenate(cut), "cut_ends": np.cumsum([len(c) for c in cut])}


class ForestModel(ArrayModel):
    """A fitted forest: all nodes of all trees one after the other. The probability is the mean over the trees of the
    class shares in a row's leaf."""

    @classmethod
    def of(cls, cut: list[np.ndarray], trees: list[Tree], n: int) -> ForestModel:
        gains = np.zeros((len(trees), n))
        for i, t in enumerate(trees):
            inner = t.feature >= 0
            gains[i] = np.bincount(t.feature[inner], (t.gain * t.whole.sum(axis=0))[inner], n)
        one = lambda f: np.concatenate([f(t) for t in trees])
        return cls(**packed_cuts(cut), ends=np.cumsum([len(t.feature) for t in trees]), feature=one(lambda t: t.feature),
                   cut=one(lambda t: t.cut), left=one(lambda t: t.left), share=one(lambda t: t.whole[1] / t.whole.sum(axis=0)), gains=gains)

    @property
    def featureImportances(self):
        """Gain by weight of each feature: shares of a tree, their mean over the trees."""
        of_tree = self.arrays["gains"].sum(axis=1, keepdims=True)
        share = (self.arrays["gains"] / np.where(of_tree > 0, of_tree, 1.0)).sum(axis=0)
        return Vectors.dense(share / (share.sum() or 1.0))

    def p1(self, x: np.ndarray) -> np.ndarray:
        a = self.arrays
        x = binned(list(x.T), np.split(a["cuts"], a["cut_ends"][:-1]))
        out, first = np.zeros(len(x)), 0
        for end in a["ends"].tolist():
            here = slice(first, end)
            out += a["share"][here][walk(Tree(a["feature"][here], a["cut"][here], a["left"][here], None, None), x)]
            first = end
        return out / len(a["ends"])


def fit_forest(train: DataFrame, n: int, id_column: str, trees: int, depth: int, bins: int, k: int, seed: int) -> ForestModel:
    """A forest of ``trees`` trees on ``train`` (id, ``label``, ``features`` of ``n`` numbers), ``k`` features a split."""
    cut = fit_cuts(train, n, bins)
    return ForestModel.of(cut, grow_forest(blocks(train, cut, id_column), n, bins, trees, depth, k, seed), n)


# --- boosted trees ---------------------------------------------------------------------------------

#: Bins that features counted together have at most.
JOINT_BINS = 4096


def joint(widths: list[int], most: int = JOINT_BINS) -> list[list[int]]:
    """Features in runs whose numbers of bins multiply to at most ``most``: one histogram counts a run."""
    out, size = [], 0
    for i, w in enumerate(widths):
        if out and size * w <= most:
            out[-1].append(i)
            size *= w
        else:
            out.append([i])
            size = w
    return out


def routed(t: Tree, x: np.ndarray) -> np.ndarray:
    """The node of each row of a small tree; ``x`` has a row for each feature."""
    at = np.zeros(x.shape[1], np.int16)
    for i in np.flatnonzero(t.feature >= 0):
        at = np.where(at == i, np.int16(t.left[i]) + (x[t.feature[i]] > t.cut[i]), at)
    return at


def residual(y: np.ndarray, margin: np.ndarray) -> np.ndarray:
    """Downhill of the log loss ``2 log(1 + exp(-2 y F))`` for labels -1 and 1."""
    with np.errstate(over="ignore"):
        return 4.0 * y / (1.0 + np.exp(2.0 * y * margin))


def sums(x: np.ndarray, code: list[np.ndarray], runs: list[list[int]], widths: list[int], slot: np.ndarray | None, m: int,
         target: np.ndarray, bins: int) -> np.ndarray:
    """Rows and sums of ``target`` by (node, feature, bin); ``slot`` is the row's node, ``m`` where it is none of them."""
    out = np.zeros((2, m, len(widths), bins))
    for run, c in zip(runs, code):
        shape = [widths[i] for i in run]
        size = int(np.prod(shape))
        at = c if slot is None else slot * size + c
        for k, w in enumerate((None, target)):
            h = np.bincount(at, w, (m + 1) * size)[:m * size].reshape(m, *shape)
            for j, i in enumerate(run):
                out[k, :, i, :widths[i]] = h.sum(axis=tuple(a for a in range(1, len(shape) + 1) if a != j + 1))
    return out


def best_cuts(hist: np.ndarray) -> tuple[np.ndarray, ...]:
    """Variance gain, feature and bin of each node's best split, with rows and sums left of it and in the node."""
    whole = hist[:, :, 0].sum(axis=2)
    upto = np.cumsum(hist, axis=3)[..., :-1]
    n, s = upto
    rest_n, rest_s = whole[0][:, None, None] - n, whole[1][:, None, None] - s
    with np.errstate(divide="ignore", invalid="ignore"):
        score = s * s / n + rest_s * rest_s / rest_n
        score[(n < 1) | (rest_n < 1)] = -np.inf
        at, i = score.reshape(len(whole[0]), -1).argmax(axis=1), np.arange(len(whole[0]))
        feature, cut = np.divmod(at, hist.shape[3] - 1)
        gain = (score[i, feature, cut] - whole[1] ** 2 / whole[0]) / whole[0]
    return gain, feature, cut, upto[:, i, feature, cut], whole


class BoostedModel(ArrayModel):
    """Boosted regression trees; ``value`` is what a leaf adds to the margin."""

    @property
    def featureImportances(self):
        share = self.arrays["gains"].sum(axis=0)
        return Vectors.dense(share / (share.sum() or 1.0))

    def margin(self, x: np.ndarray) -> np.ndarray:
        a = self.arrays
        x = binned(list(x.T), np.split(a["cuts"], a["cut_ends"][:-1])).T.copy()
        out, first = np.zeros(x.shape[1]), 0
        for end in a["ends"].tolist():
            here = slice(first, end)
            out += a["value"][here][routed(Tree(a["feature"][here], a["cut"][here], a["left"][here], None, None), x)]
            first = end
        return out

    def p1(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return 1.0 / (1.0 + np.exp(-2.0 * self.margin(x)))


def fit_boosted(train: DataFrame, n: int, id_column: str, trees: int, depth: int, bins: int, rate: float) -> BoostedModel:
    """Gradient boosting of the log loss as Spark does it: the first tree is fitted to the labels, each next one, at
    ``rate``, to the residuals. A level is one job over kept blocks; the first also adds the last tree to the margins."""
    cut = fit_cuts(train, n, bins)
    widths = [len(c) + 1 for c in cut]
    runs = joint(widths)
    table = blocks(train, cut, id_column)

    def begin(block):
        _, y, x = _read(block)
        x = x.T.copy()
        code = [np.ravel_multi_index([x[i].astype(np.int64) for i in run], [widths[i] for i in run]).astype(np.uint16) for run in runs]
        return x, code, y.astype(np.int8) * np.int8(2) - np.int8(1), np.zeros(len(y))

    rows = table.rdd.map(begin).coalesce(table.sparkSession.sparkContext.defaultParallelism).persist(StorageLevel.MEMORY_AND_DISK)
    done: list[tuple[Tree, np.ndarray]] = []
    gains = np.zeros((trees, n))
    for k in range(trees):
        if k:
            before, (last, value) = rows, done[-1]
            rows = before.map(_adder(last, value)).persist(StorageLevel.MEMORY_AND_DISK)
        t, stats, open_nodes = Tree(np.full(1, -1, np.int8), np.zeros(1, np.uint8), np.zeros(1, np.int32), None, None), np.zeros((2, 1)), [0]
        for _ in range(depth):
            parts = rows.mapPartitions(_counter(t, open_nodes, runs, widths, k, bins)).collect()
            gain, feature, where, left, whole = best_cuts(np.sum(parts, axis=0))
            if len(t.feature) == 1:
                stats[:] = whole
                if not whole[0, 0]:
                    raise ValueError("no training rows")
            ok = np.flatnonzero(gain > LEAST_GAIN)
            s = np.array(open_nodes)[ok]
            t.feature[s], t.cut[s], t.left[s] = feature[ok], where[ok], len(t.feature) + 2 * np.arange(len(s))
            gains[k] += np.bincount(feature[ok], gain[ok] * whole[0, ok], n)
            below = np.stack([left[:, ok], whole[:, ok] - left[:, ok]], axis=2).reshape(2, -1)
            open_nodes = list(range(len(t.feature), len(t.feature) + below.shape[1]))
            t = Tree(np.append(t.feature, np.full(below.shape[1], -1, np.int8)), np.append(t.cut, np.zeros(below.shape[1], np.uint8)),
                     np.append(t.left, np.zeros(below.shape[1], np.int32)), None, None)
            stats = np.append(stats, below, axis=1)
            if not open_nodes:
                break
        if k:
            before.unpersist()
        done.append((t, stats[1] / stats[0] * (rate if k else 1.0)))
    rows.unpersist()
    one = lambda f: np.concatenate([f(t) for t, _ in done])
    return BoostedModel(**packed_cuts(cut), ends=np.cumsum([len(t.feature) for t, _ in done]), feature=one(lambda t: t.feature),
                        cut=one(lambda t: t.cut), left=one(lambda t: t.left), value=np.concatenate([v for _, v in done]), gains=gains)


def _adder(t: Tree, value: np.ndarray):
    return lambda row: (*row[:3], row[3] + value[routed(t, row[0])])


def _counter(t: Tree, nodes: list[int], runs: list[list[int]], widths: list[int], k: int, bins: int):
    """The summed histograms of the open ``nodes`` of a part's rows, for the ``k``-th tree."""
    def count(part):
        m = len(nodes)
        out = np.zeros((2, m, len(widths), bins))
        slots = np.full(len(t.feature), m)
        slots[nodes] = np.arange(m)
        for x, code, y, margin in part:
            target = residual(y, margin) if k else y.astype(np.float64)
            out += sums(x, code, runs, widths, slots[routed(t, x)] if len(t.feature) > 1 else None, m, target, bins)
        return [out]

    return count
