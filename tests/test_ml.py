"""Exact stratified split, early stopping, every fit, grouped metrics, saved state."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from millwright import schema as S
from millwright.operators import metrics, ml, report, state
from millwright.operators.features import feature_matrix
from millwright.plans import ml_queries
from millwright.plans.registry import state_path
from millwright.sources.readings import readings_from_events

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def readings(spark):
    return readings_from_events(spark, SMALL).cache()


@pytest.fixture(scope="module")
def saved(spark, readings, tmp_path_factory):
    """A state fitted to the readings, and the folder it is saved in."""
    fitted = state.fit_state(readings)
    path = str(tmp_path_factory.mktemp("state"))
    return fitted, path, state.save_state(spark, fitted, path)


# --- split -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [0.2, 0.1, 0.333, 0.0, 1.0])
def test_split_is_exact_in_each_class(readings, size):
    got = {(r.split, r.label): r.n for r in ml.class_distribution(ml.prepared(readings, size)).collect()}
    for y in (0, 1):
        n = got.get(("test", y), 0) + got.get(("train", y), 0)
        assert n > 0 and got.get(("test", y), 0) == int(n * size + 0.5)


def test_split_does_not_depend_on_partitions(readings):
    ids = lambda df: sorted(r.udi for r in ml.prepared(df).where("split = 'test'").select("udi").collect())
    assert ids(readings) == ids(readings.repartition(7, "rpm"))


def test_split_of_tiny_classes(spark):
    df = spark.createDataFrame([(i, 0) for i in range(9)] + [(100, 1)], "udi long, label int")
    got = ml.train_test_split(df).groupBy("label", "split").count().collect()
    assert {(r.label, r.split): r["count"] for r in got} == {(0, "test"): 2, (0, "train"): 7, (1, "train"): 1}
    assert ml.train_test_split(df.limit(0)).collect() == []


# --- fits ------------------------------------------------------------------------------------------


def test_every_model_is_fitted_and_judged(saved):
    suite = saved[0].suite
    rows = {r.model: r for r in suite.metrics.collect()}
    assert list(suite.models) == S.MODEL_NAMES and set(rows) == set(S.MODEL_NAMES)
    for r in rows.values():
        assert all(0.0 <= r[k] <= 1.0 for k in ("accuracy", "precision", "recall", "f1", "roc_auc"))
        assert r.tn + r.fp + r.fn + r.tp == sum(rows["Random Forest"][k] for k in ("tn", "fp", "fn", "tp"))
    assert max(r.roc_auc for r in rows.values()) > 0.9
    assert suite.best == max(S.MODEL_NAMES, key=lambda m: (rows[m].recall, rows[m].roc_auc))


def test_selected_models_unscaled_and_unknown(readings):
    suite = ml.train_suite(readings, ["Decision Tree", "Logistic Regression"], test_size=0.3, scale_features=False)
    assert list(suite.models) == ["Logistic Regression", "Decision Tree"] and suite.scaler is None
    assert ml.train_suite(readings, []).best is None
    again = ml.train_suite(readings, ["Decision Tree", "Logistic Regression"], test_size=0.3, scale_features=False)
    assert again.best == suite.best and again.metrics.collect() == suite.metrics.collect()
    with pytest.raises(ValueError):
        ml.train_suite(readings, ["Nothing"])


def test_a_query_fits_the_models_that_it_needs(spark, monkeypatch):
    """One model's query fits that one; what a later query needs is taken from the store, in the models' own order."""
    fitted = []
    fit = ml.fit_model
    monkeypatch.setattr(ml, "fit_model", lambda name, *rest: fitted.append(name) or fit(name, *rest))
    monkeypatch.setattr(ml_queries, "state_path", lambda spark, sf_dir, name, own=uuid.uuid4().hex: state_path(spark, sf_dir, f"{own}-{name}"))
    row = ml_queries._model_row("Decision Tree")(spark, SMALL).collect()
    assert fitted == ["Decision Tree"] and [(r.model, r.pos) for r in row] == [("Decision Tree", 3)]
    both = ml_queries.fitted_suite(spark, SMALL, ["Decision Tree", "Logistic Regression"])
    assert fitted == ["Decision Tree", "Logistic Regression"] and list(both.models) == ["Logistic Regression", "Decision Tree"]
    whole = ml.train_suite(readings_from_events(spark, SMALL), ["Decision Tree", "Logistic Regression"])
    key = lambda s: {r.model: tuple(r)[2:] for r in s.metrics.collect()}
    assert key(both) == key(whole) and both.best == whole.best and both.scaler == whole.scaler and both.n_train == whole.n_train


def test_one_file_is_fitted_by_many_tasks(spark, monkeypatch):
    df = spark.range(1000, numPartitions=1).selectExpr("id AS udi", "id * 1.5D AS x")
    monkeypatch.setattr(ml, "TASK_ROWS", 100)
    many = ml.dealt(df)
    assert many.rdd.getNumPartitions() == 10 and sorted(map(tuple, many.collect())) == sorted(map(tuple, df.collect()))
    monkeypatch.setattr(ml, "TASK_ROWS", 1000)
    assert ml.dealt(df) is df


def test_no_leakage_column(readings):
    """What the models see does not change with the mode columns that the label is made of."""
    flipped = readings.select(*[(1 - F.col(c)).alias(c) if c in S.MODE_COLS else F.col(c) for c in readings.columns])
    key = lambda df: sorted(map(tuple, feature_matrix(df).collect()))
    assert key(readings) == key(flipped) and not set(S.MODE_COLS) & set(S.FEATURES)


def test_perceptron_stops_early_and_keeps_its_best(spark):
    r = random.Random(1)
    rows = [(i, float(x), float(x > 0.5)) for i, x in enumerate(r.random() for _ in range(400))]
    df = spark.createDataFrame(rows, "udi long, x double, label double").withColumn("label", F.col("label").cast("int"))
    vec = ml.assemble(df, ["x"]).select("udi", "label", "features")
    rest = dict(layers=[1, 4, 2], featuresCol="features", labelCol="label")
    model, done = ml.fit_early(vec, rest, max_iter=300, patience=2)
    again, same = ml.fit_early(vec, rest, max_iter=300, patience=2)
    assert done < 300 and same == done and model.weights == again.weights
    right = model.transform(vec).where("prediction = label").count()
    assert right > 380


def test_absent_columns_count_zero(spark, saved):
    suite = saved[0].suite
    one = spark.createDataFrame([(1, 1500.0)], "udi long, rpm double")
    full = one.selectExpr("udi", "rpm", "0d AS air_temp_k", "0d AS process_temp_k", "0d AS torque_nm", "0d AS tool_wear_min", "'?' AS type")
    assert ml.score(suite, one).first().p1 == ml.score(suite, full).first().p1


def test_importance(saved):
    rows = ml.feature_importance(saved[0].suite)
    by = {}
    for model, feature, share in rows:
        by.setdefault(model, {})[feature] = share
    assert set(by) == set(S.MODEL_NAMES) - {"Neural Network MLP"}
    assert all(set(v) == set(S.FEATURES) and abs(sum(v.values()) - 1) < 1e-6 for v in by.values())


# --- metrics of many models ------------------------------------------------------------------------


def test_grouped_metrics_equal_single_ones(spark):
    r = random.Random(9)
    rows = [(m, r.randrange(2), r.randrange(2), r.choice([None, float("nan"), r.randrange(9) / 8, r.random()]))
            for m in ("a", "b", None) for _ in range(300)]
    rows += [("a", None, 1, 0.5), ("a", 2, 1, 0.5), ("b", 1, None, 0.5), ("b", 1, 7, 0.5), ("one", 1, 1, 0.4)]
    df = spark.createDataFrame(rows, "model string, label int, prediction int, score double")
    both = {x.model: x for x in metrics.model_metrics(df, ["model"]).collect()}
    forced = {x.model: x for x in metrics.model_metrics(df, ["model"], rows_per_bucket=20).collect()}
    for m in ("a", "b", None, "one"):
        part = df.where(F.col("model").eqNullSafe(F.lit(m)))
        one, auc = metrics.classification_metrics(part).first(), metrics.roc_auc(part).first().roc_auc
        assert all(both[m][c] == one[c] for c in ("tn", "fp", "fn", "tp", "accuracy", "precision", "recall", "f1", "skipped"))
        scored = [(y, s) for k, y, _, s in rows if k == m and y in (0, 1) and s is not None and s == s]
        pairs = [(p > n) + (p == n) / 2 for y, p in scored if y for z, n in scored if not z]
        want = sum(pairs) / len(pairs) if pairs else None
        for got in (auc, both[m].roc_auc, forced[m].roc_auc):
            assert got == want or abs(got - want) < 1e-12
    assert [both[m].skipped for m in ("a", "b")] == [2, 2]
    assert both["a"].unscored == sum(k == "a" and (s is None or s != s) for k, _, _, s in rows)


def test_nothing_to_judge(spark):
    df = spark.createDataFrame([], "model string, label int, prediction int, score double")
    assert metrics.model_metrics(df, ["model"]).collect() == []
    assert metrics.roc_auc(df).first().roc_auc is None


# --- state -----------------------------------------------------------------------------------------


def test_loaded_state_scores_as_the_fitted_one(spark, readings, saved):
    fitted, path, version = saved
    other = spark.newSession()
    loaded = state.load_state(other, path)
    assert loaded.thresholds == fitted.thresholds and loaded.profile == fitted.profile
    assert loaded.suite.best == fitted.suite.best and loaded.suite.scaler == fitted.suite.scaler
    mine = report.score_report(readings, fitted, "udi")
    files = other.read.schema(readings.schema).parquet(_written(readings, path))
    theirs = report.score_report(files, loaded, "udi")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(mine) == key(theirs) and len(key(mine)) == readings.count()
    assert key(fitted.risk.knots) == key(loaded.risk.knots)
    for name, model in loaded.suite.models.items():
        a, b = (ml.score(s, df, name).agg(F.sum("p1"), F.sum("prediction")).first()
                for s, df in ((fitted.suite, readings), (loaded.suite, files)))
        assert tuple(a) == pytest.approx(tuple(b)), name
        assert type(model) is type(fitted.suite.models[name])


def _written(df, path):
    df.write.mode("overwrite").parquet(f"{path}/readings")
    return f"{path}/readings"


def test_versions(spark, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        state.load_state(spark, path)
    a = state.save_state(spark, state.FittedState(thresholds={"high": 1.0, "urgent": 2.0, "method": "quantile"}), path)
    b = state.save_state(spark, state.FittedState(thresholds={"high": 3.0, "urgent": 4.0, "method": "quantile"}, profile={}), path, "second")
    spark.range(1).write.parquet(f"{path}/versions/third/thresholds")  # never finished: not in the manifest
    assert b == "second" and state.load_state(spark, path).thresholds["high"] == 3.0
    assert state.load_state(spark, path, a).thresholds["high"] == 1.0 and state.load_state(spark, path, a).suite is None
    with pytest.raises(FileNotFoundError):
        state.load_state(spark, path, "third")
