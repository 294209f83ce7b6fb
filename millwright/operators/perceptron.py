"""Perceptron: sigmoid layers and a softmax, fitted by L-BFGS over blocks of rows.

The objective (mean cross entropy), the layout of the weights, their start, the search and its limits
are those of Spark's own perceptron. A step is one job: each task goes over its stored blocks, a few
matrix products for some thousand rows, and returns one gradient.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.operators.trees import ArrayModel, columns_of, split_features

# workers need not have this package: its functions travel with the tasks
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows that go through the layers together.
ROWS_AT_ONCE = 512
#: Rows of one block, about.
BLOCK_ROWS = 50_000
CORRECTIONS = 10


def layered(weights: np.ndarray, layers: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(inputs x outputs, bias) of each layer."""
    out, at = [], 0
    for a, b in zip(layers, layers[1:]):
        out.append((weights[at:at + a * b].reshape(a, b), weights[at + a * b:at + a * b + b]))
        at += a * b + b
    return out


def _forward(x: np.ndarray, net: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray]:
    """What each layer is given, and the softmax."""
    given = [x]
    for w, b in net[:-1]:
        z = given[-1] @ -w
        z -= b
        with np.errstate(over="ignore"):
            np.exp(z, out=z)
        z += 1.0
        given.append(np.reciprocal(z, out=z))
    w, b = net[-1]
    z = given[-1] @ w
    z += b
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return given, z


def loss_and_gradient(weights: np.ndarray, layers: list[int], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sum of the rows' cross entropies, then of their gradients."""
    net = layered(weights, layers)
    out = np.zeros(1 + len(weights))
    grads = layered(out[1:], layers)
    for a in range(0, len(y), ROWS_AT_ONCE):
        of = y[a:a + ROWS_AT_ONCE]
        given, d = _forward(x[a:a + ROWS_AT_ONCE], net)
        at = np.arange(len(of)), of
        out[0] -= np.log(np.maximum(d[at], 5e-324)).sum()
        d[at] -= 1.0
        for i in range(len(net) - 1, -1, -1):
            t, (gw, gb) = given[i], grads[i]
            gb += np.ones(len(d)) @ d
            gw += t.T @ d
            if i:
                d = d @ net[i][0].T
                d *= t
                d *= np.subtract(1.0, t, out=t)
    return out


class PerceptronModel(ArrayModel):
    """A fitted perceptron (``layer_sizes``, ``weight``)."""

    @property
    def weights(self):
        return Vectors.dense(self.arrays["weight"])

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        net = layered(self.arrays["weight"], self.arrays["layer_sizes"].tolist())
        return np.concatenate([_forward(x[a:a + ROWS_AT_ONCE], net)[1] for a in range(0, max(len(x), 1), ROWS_AT_ONCE)])

    def p1(self, x: np.ndarray) -> np.ndarray:
        return self.probabilities(x)[:, 1]


Block = tuple[np.ndarray, np.ndarray]


def stored_blocks(rows: DataFrame, n: int) -> RDD:
    """``label, features`` as kept blocks of rows (matrix, labels), in a part for each core: a step is a short job."""
    most = BLOCK_ROWS

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            held.append((np.stack(columns_of(batch, n), axis=1), batch.column("y").to_numpy().astype(np.int64)))
            count += batch.num_rows
            if count >= most:
                yield block(held)
                held, count = [], 0
        if count:
            yield block(held)

    def block(held: list[Block]) -> pa.RecordBatch:
        x, y = (np.concatenate(c) for c in zip(*held))
        return pa.RecordBatch.from_pylist([{"x": x.tobytes(), "y": y.tobytes()}], pa.schema([("x", pa.binary()), ("y", pa.binary())]))

    table = rows.select(F.col("label").cast("int").alias("y"), *split_features(rows, n)).mapInArrow(pack, "x binary, y binary")
    parts = rows.sparkSession.sparkContext.defaultParallelism
    out = table.rdd.map(lambda r: (np.frombuffer(r.x).reshape(-1, n), np.frombuffer(r.y, np.int64)))
    return out.coalesce(parts).persist(StorageLevel.MEMORY_AND_DISK)


# --- the search ------------------------------------------------------------------------------------

Objective = Callable[[np.ndarray], tuple[float, np.ndarray]]


class SearchFailed(Exception):
    pass


def lbfgs(f: Objective, x: np.ndarray, steps: int, tol: float = 1e-6) -> np.ndarray:
    """``steps`` steps of L-BFGS with a strong Wolfe line search, as in Breeze (of which Spark's perceptron is a user).

    After a failed search the history is forgotten once; a second failure in a row ends it.
    """
    value, grad = f(x)
    history: list[tuple[np.ndarray, np.ndarray]] = []
    done, failed = 0, False
    while done < steps and np.linalg.norm(grad) > max(tol * value, 1e-8):
        try:
            direction = _direction(history, grad)
            step = _line_search(lambda t: (lambda v, g: (v, float(g @ direction)))(*f(x + direction * t)),
                                1.0 / np.linalg.norm(direction) if done == 0 else 1.0)
            if step * np.linalg.norm(grad) < 1e-10:
                raise SearchFailed
        except SearchFailed:
            if failed:
                break
            failed, history = True, []
            continue
        failed = False
        new = x + direction * step
        value, g = f(new)
        history = [(new - x, g - grad), *history][:CORRECTIONS]
        x, grad, done = new, g, done + 1
    return x


def _direction(history: list[tuple[np.ndarray, np.ndarray]], grad: np.ndarray) -> np.ndarray:
    d, parts = grad.copy(), []
    for s, y in history:
        rho = s @ y
        a = s @ d / rho if rho else np.nan
        if np.isnan(a):
            raise SearchFailed
        parts.append((a, rho))
        d -= a * y
    if history:
        s, y = history[0]
        if not s @ y >= 0:
            raise SearchFailed
        d *= (s @ y) / (y @ y)
    for (s, y), (a, rho) in zip(reversed(history), reversed(parts)):
        d += (a - y @ d / rho) * s
    return -d


def _line_search(phi: Callable[[float], tuple[float, float]], t: float, tries: int = 10, c1: float = 1e-4, c2: float = 0.9) -> float:
    """A step that decreases enough and flattens enough (Nocedal and Wright)."""
    low = (0.0, *phi(0.0))
    _, f0, d0 = low
    if d0 > 0:
        raise SearchFailed
    for i in range(tries):
        c = (t, *phi(t))
        if not np.isfinite(c[1]):
            t /= 2.0
            continue
        if c[1] > f0 + c1 * t * d0 or (i > 0 and c[1] >= low[1]):
            return _zoom(phi, low, c, f0, d0, tries, c1, c2)
        if abs(c[2]) <= c2 * abs(d0):
            return t
        if c[2] >= 0:
            return _zoom(phi, c, low, f0, d0, tries, c1, c2)
        low = c
        t *= 1.5
    raise SearchFailed


def _zoom(phi, low, high, f0: float, d0: float, tries: int, c1: float, c2: float) -> float:
    for _ in range(tries):
        a, b = sorted((low, high))
        d1 = a[2] + b[2] - 3 * (a[1] - b[1]) / (a[0] - b[0])
        with np.errstate(invalid="ignore"):
            d2 = np.sqrt(d1 * d1 - a[2] * b[2])
        wide = b[0] - a[0]
        t = b[0] - wide * (b[2] + d2 - d1) / (b[2] - a[2] + 2 * d2)
        t = a[0] + 0.1 * wide if t < a[0] + 0.1 * wide else a[0] + 0.9 * wide if t > a[0] + 0.9 * wide else t
        c = (t, *phi(t))
        if c[1] > f0 + c1 * t * d0 or c[1] >= low[1]:
            high = c
        else:
            if abs(c[2]) <= c2 * abs(d0):
                return t
            if c[2] * (high[0] - low[0]) >= 0:
                high = low
            low = c
    raise SearchFailed


# --- the fit ---------------------------------------------------------------------------------------

def first_weights(rows: DataFrame, layers: list[int], seed: int) -> np.ndarray:
    """Where Spark's perceptron starts with this seed: its fit of no iterations to one row of zeros."""
    one = rows.sparkSession.createDataFrame([(Vectors.dense([0.0] * layers[0]), 0.0)], ["features", "label"])
    return MultilayerPerceptronClassifier(layers=layers, maxIter=0, seed=seed).fit(one).weights.toArray()


def objective(blocks: RDD, layers: list[int]) -> Objective:
    """The mean cross entropy of all rows and its gradient; the last weights' figures are kept."""
    count = blocks.map(lambda b: len(b[1])).sum()
    if not count:
        raise ValueError("no training rows")

    last: list = [None, None]

    def f(weights: np.ndarray) -> tuple[float, np.ndarray]:
        if last[0] is None or not np.array_equal(last[0], weights):
            last[:] = weights, summed(weights)
        return last[1]

    def summed(weights: np.ndarray) -> tuple[float, np.ndarray]:
        def total(part):
            out = np.zeros(1 + len(weights))
            for x, y in part:
                out += loss_and_gradient(weights, layers, x, y)
            return [out]

        sums = np.sum(blocks.mapPartitions(total).collect(), axis=0) / count
        return float(sums[0]), sums[1:]

    return f


def share_right(blocks: RDD, model: PerceptronModel) -> float | None:
    """The share of the rows whose class is predicted; None without a row."""
    got = blocks.map(lambda b: (int((model.probabilities(b[0]).argmax(axis=1) == b[1]).sum()), len(b[1]))).collect()
    rows = sum(n for _, n in got)
    return sum(r for r, _ in got) / rows if rows else None
