"""The forest: bins, one tree against a plain one, large nodes against small ones, saved models."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from millwright.operators import ml, trees
from millwright.operators.trees import ForestModel, Tree


def rows_of(spark, n, features=3, values=9, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        x = [float(r.randrange(values)) for _ in range(features)]
        rows.append((i, *x, int(x[0] + x[1] > values or r.random() < 0.1)))
    cols = [f"x{i}" for i in range(features)]
    df = spark.createDataFrame(rows, "udi long, " + ", ".join(f"{c} double" for c in cols) + ", label int")
    return ml.assemble(df, cols).select("udi", "label", "features")


def plain(x, y, w, bins, k, tree, seed, path, depth):
    """The same tree by recursion over rows: (weights,) of a leaf, (feature, cut, left, right) of a split."""
    c = [float(w[y == v].sum()) for v in (0, 1)]
    if depth == 0 or 0.0 in c:
        return tuple(c)
    gini = lambda p, q: 1 - (p / (p + q)) ** 2 - (q / (p + q)) ** 2
    best = (trees.LEAST_GAIN, None)
    for f in trees.features_of(np.array([path]), tree, seed, x.shape[1], k)[0]:
        for b in range(bins - 1):
            a = x[:, f] <= b
            p, q = ([float(w[s & (y == v)].sum()) for v in (0, 1)] for s in (a, ~a))
            if sum(p) and sum(q):
                gain = gini(*c) - sum(p) / sum(c) * gini(*p) - sum(q) / sum(c) * gini(*q)
                if gain > best[0] + 1e-12:
                    best = (gain, (int(f), b, a))
    if best[1] is None:
        return tuple(c)
    f, b, a = best[1]
    go = lambda s, p: plain(x[s], y[s], w[s], bins, k, tree, seed, p, depth - 1)
    return f, b, go(a, 2 * path), go(~a, 2 * path + 1)


def nested(t: Tree, i=0):
    if t.feature[i] < 0:
        return tuple(t.whole[:, i].tolist())
    return int(t.feature[i]), int(t.cut[i]), nested(t, t.left[i]), nested(t, t.left[i] + 1)


@pytest.mark.parametrize("depth,k", [(0, 2), (1, 3), (4, 2), (30, 2), (30, 1)])
def test_a_tree_equals_a_plain_one(monkeypatch, depth, k):
    monkeypatch.setattr(trees, "NODES_AT_ONCE", 3)
    r = np.random.default_rng(depth + k)
    x, y, w = r.integers(0, 8, (300, 4)).astype(np.uint8), r.integers(0, 2, 300).astype(np.uint8), r.integers(1, 4, 300).astype(np.uint8)
    t = trees.grow(x, y, w, 8, k, 5, 42, 1, depth)
    assert nested(t) == plain(x, y, w, 8, k, 5, 42, 1, depth)
    leaf = trees.walk(t, x)
    assert (t.feature[leaf] < 0).all()
    assert np.array_equal(np.bincount(leaf, w * (y == 1), len(t.feature))[t.feature < 0], t.whole[1][t.feature < 0])
    small = trees.pruned(t)
    says = lambda t: (t.whole[1] > t.whole[0])[trees.walk(t, x)]
    assert np.array_equal(says(t), says(small))
    for i in np.flatnonzero(small.feature >= 0):
        a = small.left[i]
        assert small.feature[a] >= 0 or small.feature[a + 1] >= 0 or (small.whole[1, a] > small.whole[0, a]) != (small.whole[1, a + 1] > small.whole[0, a + 1])


def test_one_class_and_one_row():
    one = trees.grow(np.zeros((1, 2), np.uint8), np.ones(1, np.uint8), np.ones(1, np.uint8), 4, 2, 0, 1, 1, 30)
    assert nested(one) == (0.0, 1.0)
    same = trees.grow(np.zeros((4, 2), np.uint8), np.array([0, 1, 1, 1], np.uint8), np.ones(4, np.uint8), 4, 2, 0, 1, 1, 30)
    assert nested(same) == (1.0, 3.0)


def test_large_nodes_are_split_as_small_ones(spark, monkeypatch):
    """Whether tasks sum histograms or one task has all rows, the trees are the same, however the rows lie."""
    train = rows_of(spark, 900).cache()
    fit = lambda df: trees.fit_forest(df, 3, "udi", 7, 12, 6, 2, 42).arrays
    one = fit(train.coalesce(1))
    monkeypatch.setattr(trees, "LOCAL_ROWS", 60)
    monkeypatch.setattr(trees, "WAVE_BYTES", 1)
    monkeypatch.setattr(trees, "BLOCK_ROWS", 100)
    many = fit(train.repartition(5, "udi"))
    # nodes may stand in another order: compare each tree by what it says
    assert np.array_equal(one["ends"], many["ends"]) and np.allclose(one["gains"], many["gains"])
    x = np.array([[a, b, c] for a in range(9) for b in range(9) for c in range(9)], float)
    assert np.array_equal(ForestModel(**one).p1(x), ForestModel(**many).p1(x))


def test_rows_that_are_alike_are_drawn_one_by_one(spark):
    df = spark.range(4000).selectExpr("cast(null as long) as udi", "0 as label", "1d as x", "2d as z")
    vec = ml.assemble(df, ["x", "z"]).select("udi", "label", "features").coalesce(1)
    [b] = trees.blocks(vec, [np.array([]), np.array([])], "udi").collect()
    w = trees.weights(np.frombuffer(b.key, np.uint64), 3, 42, trees.poisson_table())
    assert 0.33 < (w == 0).mean() < 0.41 and 0.33 < (w == 1).mean() < 0.41 and 0.9 < w.mean() < 1.1


def test_cuts():
    few = (np.array([1.0, 2.0, 4.0]), np.array([5.0, 1.0, 1.0]))
    assert trees.cuts(few, 4).tolist() == [1.5, 3.0] and trees.cuts((np.array([]), np.array([])), 4).tolist() == []
    even = (np.arange(100.0), np.ones(100))
    assert trees.cuts(even, 4).tolist() == [24.5, 49.5, 74.5]
    r = np.random.default_rng(3)
    parts = [r.normal(size=5000) for _ in range(6)]
    got = trees.thinned(*np.unique(parts[0], return_counts=True), 1000)
    for p in parts[1:]:
        got = trees.merged(got, trees.thinned(*np.unique(p, return_counts=True), 1000), 1000)
    all_rows = np.sort(np.concatenate(parts))
    at = np.searchsorted(all_rows, trees.cuts(got, 16)) / len(all_rows)
    assert len(got[0]) <= 1002 and got[1].sum() == len(all_rows) and np.abs(at - np.arange(1, 16) / 16).max() < 0.01


def test_a_deep_forest_of_noise_ends_soon(spark, tmp_path):
    """100 trees to depth 30 whose nodes are nearly all small: Spark's own forest takes minutes for them."""
    train = rows_of(spark, 20_000, features=8, values=60, seed=2).cache()
    train.count()
    t = time.time()
    model = trees.fit_forest(train, 8, "udi", 100, 30, 64, 3, 42)
    took = time.time() - t
    assert len(model.arrays["ends"]) == 100 and len(model.arrays["feature"]) > 100 * 1000 and took < 60
    model.write().save(f"{tmp_path}/m")
    again = ForestModel.load(f"{tmp_path}/m")
    key = lambda m: sorted(map(tuple, m.transform(train.limit(500)).select("udi", "prediction", F.col("probability").cast("string")).collect()))
    assert key(model) == key(again) and abs(sum(model.featureImportances) - 1) < 1e-9
    right = model.transform(train).where("prediction = label").count()
    assert right > 19_000
