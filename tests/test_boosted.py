"""Boosted trees against Spark's own, and what their jobs carry."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier

from millwright.operators import ml, trees

from tests.test_trees import rows_of


@pytest.mark.parametrize("n,depth", [(400, 3), (400, 1), (2000, 3)])
def test_equals_sparks(spark, n, depth):
    train = rows_of(spark, n, features=4, values=80).cache()
    theirs = GBTClassifier(maxIter=8, maxDepth=depth, stepSize=0.1, maxBins=64, seed=42, featuresCol="features", labelCol="label").fit(train)
    mine = trees.fit_boosted(train, 4, "udi", 8, depth, 64, 0.1)
    p = lambda m: np.array([r.p1 for r in ml.predictions(m, train, ["udi"]).orderBy("udi").collect()])
    assert np.abs(p(mine) - p(theirs)).max() < 1e-9
    assert np.allclose(mine.featureImportances.toArray(), theirs.featureImportances.toArray(), atol=1e-9)


def test_rows_may_lie_in_any_way(spark, monkeypatch):
    train = rows_of(spark, 500).cache()
    one = trees.fit_boosted(train.coalesce(1), 3, "udi", 5, 3, 64, 0.1)
    monkeypatch.setattr(trees, "BLOCK_ROWS", 20)
    many = trees.fit_boosted(train.repartition(6, "udi"), 3, "udi", 5, 3, 64, 0.1)
    x = np.random.default_rng(1).integers(0, 9, (200, 3)).astype(float)
    assert np.allclose(one.p1(x), many.p1(x))


def test_features_are_counted_together():
    assert trees.joint([64, 64, 64, 64, 64, 2, 2, 2]) == [[0, 1], [2, 3], [4, 5, 6, 7]]
    r = np.random.default_rng(2)
    widths, runs = [5, 3, 4], trees.joint([5, 3, 4], 15)
    x = np.stack([r.integers(0, w, 300) for w in widths]).astype(np.uint8)
    code = [np.ravel_multi_index([x[i].astype(int) for i in run], [widths[i] for i in run]) for run in runs]
    slot, target = r.integers(0, 3, 300), r.normal(size=300)
    got = trees.sums(x, code, runs, widths, slot, 2, target, 6)
    for m in range(2):
        for i, w in enumerate(widths):
            here = slot == m
            assert np.array_equal(got[0, m, i, :w], np.bincount(x[i][here], minlength=w))
            assert np.allclose(got[1, m, i, :w], np.bincount(x[i][here], target[here], w)) and not got[:, m, i, w:].any()
