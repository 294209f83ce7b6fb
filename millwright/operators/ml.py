"""Failure classifiers: split, scaling, five models, evaluation, choice, scoring.

* Split: exact and stratified. Each class is ranked by a hash of the reading's id and cut at its
  share, from counts by hash range; the cut is one (hash, id) per class, so the split itself is a
  projection. It does not depend on partitioning, so it survives recomputation after an
  executor loss and is reproducible in SQL.
* Scaling: standardisation with the training split's mean and *population*
  standard deviation (the reference's scaler), as plain column arithmetic
  after one aggregate; a zero deviation scales by 1. It can be switched off.
* Models: distributed estimators with the reference's settings, Spark ML's own or, where these do not
  scale, :mod:`trees` and :mod:`perceptron`. The perceptron stops early: rounds of a few iterations go
  on from the last weights until a held-out tenth of the training rows is predicted no better for some
  rounds; the best round's weights stay.
  The models are fitted side by side, each over tasks of some ``TASK_ROWS`` rows, so that
  neither one file of readings nor one model's small jobs leave the cluster idle.
* Evaluation: the test predictions of all models are one stored table, and
  :func:`metrics.model_metrics` reads it once for all figures of all models.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwright import schema as S
from millwright.operators import metrics, perceptron, trees
from millwright.operators.features import feature_matrix
from millwright.operators.perceptron import PerceptronModel
from millwright.session import stored

TEST_SIZE = 0.2
SEED = 42
HASH_BITS = 32
#: Hash ranges that a class is counted by before its cut is looked for inside one of them.
CUT_RANGES = 4096
#: Rows of one task of a fit, about.
TASK_ROWS = 20_000


def id_hash(udi: str | Column = S.UDI, salt: str = "") -> Column:
    """First 32 bits of ``md5(salt + id)``."""
    c = F.col(udi) if isinstance(udi, str) else udi
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), c.cast("string"))), 1, 8), 16, 10).cast("bigint")


Cuts = dict[int, tuple[int, object]]


def fit_cuts(df: DataFrame, share: float = TEST_SIZE, label: str = "label", salt: str = "") -> Cuts:
    """The last (hash, id) of each class that belongs to its first ``share``, rounded half up.

    Two small jobs: counts by class and hash range (at most ``CUT_RANGES`` rows a class reach the
    driver), then the ranks inside the one range that holds the class's cut. A class whose share
    rounds to no row has no cut. Ids are unique, as in the reference; rows that share the id of the
    cut all stay on its side.
    """
    width = 2**HASH_BITS // CUT_RANGES
    h = df.select(F.col(label).alias("_y"), id_hash(salt=salt).alias("_h"), F.col(S.UDI).alias("_id"))
    h = h.withColumn("_r", F.expr(f"_h div {width}"))
    sizes: dict[int, list[tuple[int, int]]] = {}
    for y, r, n in sorted(tuple(x) for x in h.groupBy("_y", "_r").count().collect()):
        sizes.setdefault(y, []).append((r, n))
    wanted = {}
    for y, ranges in sizes.items():
        left = math.floor(sum(n for _, n in ranges) * share + 0.5)
        for r, n in ranges:
            if left and n >= left:
                wanted[y] = (r, left)
                break
            left -= n
    if not wanted:
        return {}
    here = reduce(lambda a, b: a | b, [(F.col("_y") == y) & (F.col("_r") == r) for y, (r, _) in wanted.items()])
    rank = F.row_number().over(Window.partitionBy("_y").orderBy("_h", "_id"))
    at = reduce(lambda a, b: a | b, [(F.col("_y") == y) & (F.col("_k") == k) for y, (_, k) in wanted.items()])
    return {x["_y"]: (x["_h"], x["_id"]) for x in h.where(here).withColumn("_k", rank).where(at).collect()}


def first_share(cuts: Cuts, label: str = "label", salt: str = "") -> Column:
    """Whether a row is at or before its class's cut."""
    h, i = id_hash(salt=salt), F.col(S.UDI)
    inside = F.lit(False)
    for y, (ch, ci) in cuts.items():
        before = (h < F.lit(ch)) | ((h == F.lit(ch)) & (i <= F.lit(ci)))
        inside = F.when(F.col(label) == y, before).otherwise(inside)
    return inside


def train_test_split(df: DataFrame, test_size: float = TEST_SIZE) -> DataFrame:
    """Adds ``split``: 'test' for exactly ``test_size`` of each class (to rounding), else 'train'."""
    return df.select("*", F.when(first_share(fit_cuts(df, test_size)), "test").otherwise("train").alias("split"))


def class_distribution(split_df: DataFrame, label: str = "label") -> DataFrame:
    return split_df.groupBy("split", label).agg(F.count(F.lit(1)).alias("n"))


@dataclass
class Scaler:
    """Per feature (mean, population std with 0 -> 1), fitted on the training split."""

    stats: dict[str, tuple[float, float]]

    def transform(self, df: DataFrame, cols: list[str] = S.FEATURES) -> DataFrame:
        out = [F.col(c) for c in df.columns if c not in cols]
        for c in cols:
            mean, sd = self.stats[c]
            out.append(((F.col(c) - F.lit(mean)) / F.lit(sd)).alias(c))
        return df.select(*out)


def fit_scaler(train: DataFrame, cols: list[str] = S.FEATURES) -> Scaler:
    """One aggregate over the training rows; a row of 2 x 8 numbers reaches the driver."""
    row = train.agg(*[x for c in cols for x in (F.avg(c).alias(f"{c}__m"), F.stddev_pop(c).alias(f"{c}__s"))]).first()
    stats = {}
    for c in cols:
        m, s = row[f"{c}__m"], row[f"{c}__s"]
        stats[c] = (m if m is not None else 0.0, s if s else 1.0)
    return Scaler(stats)


def estimator(name: str, n_train: int):
    """The settings of the reference's five classifiers, as Spark ML estimators."""
    common = dict(featuresCol="features", labelCol="label")
    if name == "Random Forest":
        return RandomForestClassifier(numTrees=100, maxDepth=30, maxBins=64, featureSubsetStrategy="sqrt",
                                      seed=SEED, **common)
    if name == "Gradient Boosting":
        return GBTClassifier(maxIter=100, maxDepth=3, stepSize=0.1, maxBins=64, seed=SEED, **common)
    if name == "Logistic Regression":
        return LogisticRegression(maxIter=1000, regParam=1.0 / max(n_train, 1), elasticNetParam=0.0,
                                  standardization=False, **common)
    if name == "Decision Tree":
        return DecisionTreeClassifier(maxDepth=10, maxBins=64, seed=SEED, **common)
    if name == "Neural Network MLP":
        return MultilayerPerceptronClassifier(layers=[len(S.FEATURES), 64, 32, 2], maxIter=300, seed=SEED, **common)
    raise ValueError(f"unknown model {name!r}")


def assemble(df: DataFrame, cols: list[str] = S.FEATURES) -> DataFrame:
    """Adds the ``features`` vector (fixed column order)."""
    return VectorAssembler(inputCols=cols, outputCol="features").transform(df)


@dataclass
class Suite:
    """Fitted scaler (None: not scaled), models and their test metrics (``metrics``: one row per model)."""

    scaler: Scaler | None
    models: dict[str, object]
    metrics: DataFrame
    best: str | None
    n_train: int


def prepared(readings: DataFrame, test_size: float = TEST_SIZE) -> DataFrame:
    """Feature matrix with its split."""
    return train_test_split(feature_matrix(readings), test_size)


def predictions(model, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``prediction`` (int) and ``p1`` = P(failure) from a fitted classifier over a ``features`` column."""
    out = model.transform(df)
    keep = keep if keep is not None else [c for c in df.columns if c != "features"]
    return out.select(*keep, F.col("prediction").cast("int").alias("prediction"),
                      vector_to_array("probability")[1].alias("p1"))


def fit_early(train: DataFrame, rest: dict, max_iter: int = 300, step: int = 10, patience: int = 10,
              held: float = 0.1, tol: float = 1e-4):
    """A perceptron fitted in rounds of ``step`` iterations, each from the last one's weights.

    After a round the held-out ``held`` of each class is scored; ``patience`` rounds without ``tol``
    more accuracy end the fit, as do ``max_iter`` iterations. Returns (best model, iterations done).
    ``train`` has ``udi, label, features``.
    """
    inside = first_share(fit_cuts(train, held, salt="held"), salt="held")
    layers, seed = list(rest["layers"]), rest.get("seed", SEED)
    held_rows = perceptron.stored_blocks(train.where(inside), layers[0])
    fit_rows = perceptron.stored_blocks(train.where(~inside), layers[0])
    loss = perceptron.objective(fit_rows, layers)
    weights = perceptron.first_weights(train, layers, seed)
    best, best_score, stale, done = None, -1.0, 0, 0
    while done < max_iter and stale < patience:
        weights = perceptron.lbfgs(loss, weights, step)
        model = PerceptronModel(layer_sizes=np.array(layers), weight=weights)
        done += step
        score_now = perceptron.share_right(held_rows, model)
        # without a held-out row nothing can be told apart: the last round counts
        better = score_now is None or score_now > best_score + tol
        stale = 0 if better else stale + 1
        if better or best is None:
            best, best_score = model, score_now if score_now is not None else -1.0
    held_rows.unpersist()
    fit_rows.unpersist()
    return best, done


def fit_model(name: str, train: DataFrame, n_train: int):
    """One of the five classifiers, fitted on ``train`` (``udi, label, features``)."""
    est = estimator(name, n_train)
    if isinstance(est, RandomForestClassifier):
        return trees.fit_forest(train, len(S.FEATURES), S.UDI, est.getNumTrees(), est.getMaxDepth(), est.getMaxBins(),
                                math.ceil(math.sqrt(len(S.FEATURES))), est.getSeed())
    if isinstance(est, GBTClassifier):
        return trees.fit_boosted(train, len(S.FEATURES), S.UDI, est.getMaxIter(), est.getMaxDepth(), est.getMaxBins(), est.getStepSize())
    if isinstance(est, MultilayerPerceptronClassifier):
        return fit_early(train, dict(layers=est.getLayers(), seed=est.getSeed()), est.getMaxIter())[0]
    return est.fit(train)


def train_suite(readings: DataFrame, names: list[str] | None = None, test_size: float = TEST_SIZE,
                scale_features: bool = True) -> Suite:
    """Fit the chosen models on the training split and evaluate them on the test split.

    ``names`` stand in the order of ``S.MODEL_NAMES``; other names raise. The feature matrix is stored
    once, so the readings are read once; the assembled training data is persisted for the fits, which
    run side by side, and released after; the test predictions of all models are stored as one narrow
    table.
    """
    names = list(S.MODEL_NAMES) if names is None else [n for n in S.MODEL_NAMES if n in names] + [
        n for n in names if n not in S.MODEL_NAMES]
    data = train_test_split(stored(feature_matrix(readings), "features"), test_size)
    scaler = fit_scaler(data.where(F.col("split") == "train")) if scale_features else None
    vec = assemble(dealt(scaler.transform(data) if scaler else data)).select(S.UDI, "split", "label", "features").persist()
    train = vec.where(F.col("split") == "train")
    test = vec.where(F.col("split") == "test")
    n_train = train.count()
    fits = map(inheritable_thread_target(train.sparkSession), [lambda n=name: fit_model(n, train, n_train) for name in names])
    with ThreadPoolExecutor(max(len(names), 1)) as pool:
        models = dict(zip(names, [f.result() for f in [pool.submit(fit) for fit in fits]]))
    table = evaluate(models, test)
    vec.unpersist()
    best = best_model(table).first()
    return Suite(scaler, models, table, best["model"] if best else None, n_train)


def dealt(df: DataFrame) -> DataFrame:
    """``df`` over partitions of some ``TASK_ROWS`` rows; as it is where it has no fewer partitions already."""
    parts = -(-df.count() // TASK_ROWS)
    return df.repartition(parts, *df.columns) if parts > df.rdd.getNumPartitions() else df


def only(suite: Suite, name: str) -> Suite:
    """The suite of one of its models."""
    return replace(suite, models={name: suite.models[name]}, metrics=suite.metrics.where(F.col("model") == name), best=name)


def joined(spark, suites: list[Suite]) -> Suite:
    """Suites of the same readings and split as one, in the order of ``S.MODEL_NAMES``."""
    models = {name: s.models[name] for name in S.MODEL_NAMES for s in suites if name in s.models}
    found = {r["model"]: r for s in suites for r in s.metrics.collect()}  # a row for each model
    rows = [tuple({**found[name].asDict(), "pos": S.MODEL_NAMES.index(name)}[c] for c in METRIC_COLUMNS) for name in models]
    table = spark.createDataFrame(rows, METRICS)
    best = best_model(table).first()
    return Suite(suites[0].scaler, models, table, best["model"], suites[0].n_train)


METRICS = ("model string, pos int, accuracy double, precision double, recall double, f1 double, roc_auc double, "
           "tn bigint, fp bigint, fn bigint, tp bigint")
METRIC_COLUMNS = [c.split()[0] for c in METRICS.split(", ")]


def evaluate(models: dict[str, object], test: DataFrame) -> DataFrame:
    """Test metrics, one row per model, in fitting order (``pos``); a row of figures each reaches the driver."""
    spark = test.sparkSession
    if not models:
        return spark.createDataFrame([], METRICS)
    scored = [predictions(m, test, [F.lit(i).alias("pos"), F.lit(name).alias("model"), F.col("label")])
              for i, (name, m) in enumerate(models.items())]
    table = stored(reduce(DataFrame.unionByName, scored), "predictions")
    rows = metrics.model_metrics(table, ["model", "pos"], score="p1")
    return spark.createDataFrame([tuple(r) for r in rows.select(*METRIC_COLUMNS).collect()], METRICS)


def model_comparison(table: DataFrame) -> DataFrame:
    """Models sorted by recall, descending (training order breaks ties)."""
    return table.orderBy(F.desc("recall"), "pos")


def best_model(table: DataFrame) -> DataFrame:
    """Highest recall, then highest ROC-AUC; on a full tie the first trained."""
    return table.orderBy(F.desc("recall"), F.desc_nulls_last("roc_auc"), "pos").limit(1)


def feature_importance(suite: Suite) -> list[tuple[str, str, float]]:
    """(model, feature, importance): tree importances; |coefficient| share for logistic regression."""
    out = []
    for name, m in suite.models.items():
        if hasattr(m, "featureImportances"):
            vals = m.featureImportances.toArray().tolist()
        elif hasattr(m, "coefficients"):
            co = [abs(x) for x in m.coefficients.toArray().tolist()]
            tot = sum(co) or 1.0
            vals = [x / tot for x in co]
        else:
            continue
        out += [(name, f, float(v)) for f, v in zip(S.FEATURES, vals)]
    return out


def score(suite: Suite, readings: DataFrame, model_name: str | None = None) -> DataFrame:
    """Best (or named) model on new readings (row-wise): adds ``prediction`` and ``p1``.

    A missing value, or an absent column, counts 0, as in training.
    """
    name = model_name or suite.best
    if name is None:
        raise ValueError("no trained model")
    t = F.col(S.TYPE) if S.TYPE in readings.columns else F.lit(None).cast("string")
    raw = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in readings.columns else F.lit(0.0) for c in S.NUMERIC_FEATURES}
    raw.update({f"type_{v.lower()}": F.when(t == v, 1.0).otherwise(0.0) for v in ("H", "L", "M")})
    stats = suite.scaler.stats if suite.scaler else dict.fromkeys(S.FEATURES, (0.0, 1.0))
    scaled = readings.select("*", *[((raw[c] - F.lit(stats[c][0])) / F.lit(stats[c][1])).alias(f"_s_{c}") for c in S.FEATURES])
    vec = assemble(scaled, [f"_s_{c}" for c in S.FEATURES])
    return predictions(suite.models[name], vec, list(readings.columns))


def risk_tier(pct: Column) -> Column:
    """HIGH above 70 %, MEDIUM above 40 %, else LOW."""
    return (F.when(pct > F.lit(S.RISK_HIGH), "HIGH RISK").when(pct > F.lit(S.RISK_MEDIUM), "MEDIUM RISK")
            .otherwise("LOW RISK"))


def confidence(p1: Column, prediction: Column, component: Column) -> Column:
    """Percent: clip(0.7 * certainty + 0.3 * quality component, 0, 1) * 100."""
    certainty = F.when(prediction == 1, p1).otherwise(F.lit(1.0) - p1)
    c = F.lit(S.CERTAINTY_WEIGHT) * certainty + F.lit(S.QUALITY_WEIGHT) * F.coalesce(component, F.lit(S.NEUTRAL_COMPONENT))
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)) * F.lit(100.0)


def confidence_label(pct: Column) -> Column:
    return F.when(pct >= F.lit(S.CONFIDENCE_HIGH), "HIGH").when(pct >= F.lit(S.CONFIDENCE_MEDIUM), "MEDIUM").otherwise("LOW")
