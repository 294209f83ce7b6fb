"""The perceptron: its gradient, its search against Spark's own, what a step costs."""

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.linalg import Vectors

from millwright.operators import ml, perceptron


def table(spark, n, seed=0, parts=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 3))
    y = (x[:, 0] * x[:, 1] + x[:, 2] > 0.3).astype(int)
    rows = [(i, int(b), Vectors.dense(a.tolist())) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, ["udi", "label", "features"]).repartition(parts, "udi"), x, y


def test_gradient():
    r = np.random.default_rng(1)
    layers = [3, 5, 4, 2]
    w, x, y = r.normal(size=20 + 24 + 10), r.normal(size=(700, 3)), r.integers(0, 2, 700)
    got = perceptron.loss_and_gradient(w, layers, x, y)
    for i in range(len(w)):
        a, b = w.copy(), w.copy()
        a[i] += 1e-6
        b[i] -= 1e-6
        slope = (perceptron.loss_and_gradient(a, layers, x, y)[0] - perceptron.loss_and_gradient(b, layers, x, y)[0]) / 2e-6
        assert got[1 + i] == pytest.approx(slope, rel=1e-4, abs=1e-4)
    assert np.isfinite(perceptron.loss_and_gradient(w * 1e4, layers, x, y)).all()


@pytest.mark.parametrize("steps", [1, 3, 10])
def test_search_equals_sparks(spark, steps):
    df, _, _ = table(spark, 640)  # whole stacks of 128 rows: Spark weighs a smaller one as much
    layers = [3, 8, 4, 2]
    theirs = MultilayerPerceptronClassifier(layers=layers, maxIter=steps, seed=42).fit(df).weights.toArray()
    loss = perceptron.objective(perceptron.stored_blocks(df, 3), layers)
    mine = perceptron.lbfgs(loss, perceptron.first_weights(df, layers, 42), steps)
    assert np.abs(mine - theirs).max() < 1e-6


def test_a_step_is_one_short_job_however_the_rows_lie(spark, monkeypatch):
    """Spark's own fit stacks all rows anew every ten iterations and runs a task for each of their parts in each step."""
    monkeypatch.setattr(perceptron, "BLOCK_ROWS", 7)
    df, x, y = table(spark, 600, parts=40)
    blocks = perceptron.stored_blocks(df, 3)
    assert blocks.getNumPartitions() <= spark.sparkContext.defaultParallelism
    loss = perceptron.objective(blocks, [3, 4, 2])
    w = np.random.default_rng(2).normal(size=26)
    want = perceptron.loss_and_gradient(w, [3, 4, 2], x, y) / 600
    got = loss(w)
    assert got[0] == pytest.approx(want[0]) and got[1] == pytest.approx(want[1:])
    assert loss(w) is got  # kept: no job


def test_model_scores_and_is_the_networks_own(spark):
    df, x, y = table(spark, 600, parts=3)
    model, done = ml.fit_early(df, dict(layers=[3, 8, 2]), max_iter=60)
    assert done <= 60 and model.transform(df).where("prediction = label").count() > 540
    p = model.probabilities(x)
    assert np.allclose(p.sum(axis=1), 1) and np.allclose(p[:, 1], model.p1(x)) and len(model.probabilities(x[:0])) == 0
    got = {r.udi: r.probability[1] for r in model.transform(df).collect()}
    assert all(abs(got[i] - q) < 1e-12 for i, q in enumerate(model.p1(x)))
