"""Store of fitted state: what the fleet was fitted to, saved once and loaded by any later session.

A version is a folder under the store with the risk knots and their bucket boundaries, the scaler,
the models with their test metrics, the maintenance thresholds and the feature profile, each where
the state has it. The row in ``manifest`` is written last: a version without one is incomplete (a
lost driver, say) and is never loaded. Versions are not changed once they are there.

Knots and models are read where they are used, from storage that every executor sees; all other
parts are a few rows.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.ml.classification import (
    DecisionTreeClassificationModel,
    GBTClassificationModel,
    LogisticRegressionModel,
    MultilayerPerceptronClassificationModel,
    RandomForestClassificationModel,
)
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from millwright.operators import fleet, ml, quality, risk
from millwright.operators.perceptron import PerceptronModel
from millwright.operators.trees import BoostedModel, ForestModel

MODEL_KINDS = {c.__name__: c for c in (
    DecisionTreeClassificationModel, GBTClassificationModel, LogisticRegressionModel,
    MultilayerPerceptronClassificationModel, RandomForestClassificationModel, BoostedModel, ForestModel, PerceptronModel)}


@dataclass
class FittedState:
    """Any of its parts may be missing (None); operators that need one then raise or give their neutral result."""

    risk: risk.RiskModel | None = None
    suite: ml.Suite | None = None
    thresholds: dict | None = None
    profile: quality.Profile | None = None


def fit_state(readings, names: list[str] | None = None, test_size: float = ml.TEST_SIZE,
              scale_features: bool = True) -> FittedState:
    """All parts fitted to one table of readings, as the reference fits them at its start."""
    return FittedState(risk.fit_risk_model(readings), ml.train_suite(readings, names, test_size, scale_features),
                       fleet.thresholds_row(readings), quality.fit_profile(readings))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def save_state(spark: SparkSession, state: FittedState, path: str, version: str | None = None) -> str:
    """Writes a new version below ``path`` and returns its name (a random one by default)."""
    version = version or uuid.uuid4().hex
    at = f"{path}/versions/{version}"
    parts = []

    def write(name: str, rows: list[tuple], schema: str) -> None:
        parts.append(name)
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/{name}")

    if state.risk:
        parts.append("knots")
        state.risk.knots.write.parquet(f"{at}/knots")
        write("bounds", [(*k, i, float(b)) for k, bs in state.risk.bounds.items() for i, b in enumerate(bs)],
              "part string, type string, pos int, bound double")
    if state.suite:
        s = state.suite
        if s.scaler:
            write("scaler", [(c, float(m), float(d)) for c, (m, d) in s.scaler.stats.items()], "feature string, mean double, std double")
        parts.append("metrics")
        s.metrics.write.parquet(f"{at}/metrics")
        write("suite", [(s.best, s.n_train)], "best string, n_train long")
        write("models", [(i, name, type(m).__name__) for i, (name, m) in enumerate(s.models.items())], "pos int, name string, kind string")
        for i, m in enumerate(s.models.values()):
            m.write().save(f"{at}/model-{i}")
    if state.thresholds:
        t = state.thresholds
        write("thresholds", [(float(t["high"]), float(t["urgent"]), t["method"])], "high double, urgent double, method string")
    if state.profile is not None:
        write("profile", [(f, *(float(p[k]) for k in ("min", "max", "mean", "std"))) for f, p in state.profile.items()],
              "feature string, min double, max double, mean double, std double")
    done = spark.createDataFrame([(version, parts)], "version string, parts array<string>")
    done.withColumn("saved_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return version


def load_state(spark: SparkSession, path: str, version: str | None = None) -> FittedState:
    """The named version, or the one saved last; raises where there is none that is complete."""
    found = spark.read.parquet(f"{path}/manifest") if exists(spark, f"{path}/manifest") else None
    if found is not None and version:
        found = found.where(F.col("version") == version)
    row = found.orderBy(F.desc("saved_at"), F.desc("version")).first() if found is not None else None
    if row is None:
        raise FileNotFoundError(f"no saved state {version or ''} in {path}")
    at, parts = f"{path}/versions/{row['version']}", set(row["parts"])

    def rows(name: str, order: str) -> list[dict]:
        return [r.asDict() for r in spark.read.parquet(f"{at}/{name}").orderBy(order).collect()]

    state = FittedState()
    if "knots" in parts:
        bounds: dict[tuple, list[float]] = {}
        for b in rows("bounds", "pos"):
            bounds.setdefault((b["part"], b["type"]), []).append(b["bound"])
        state.risk = risk.RiskModel(spark.read.parquet(f"{at}/knots"), bounds)
    if "suite" in parts:
        scaler = ml.Scaler({r["feature"]: (r["mean"], r["std"]) for r in rows("scaler", "feature")}) if "scaler" in parts else None
        models = {r["name"]: MODEL_KINDS[r["kind"]].load(f"{at}/model-{r['pos']}") for r in rows("models", "pos")}
        [of] = rows("suite", "n_train")
        state.suite = ml.Suite(scaler, models, spark.read.parquet(f"{at}/metrics"), of["best"], of["n_train"])
    if "thresholds" in parts:
        [state.thresholds] = rows("thresholds", "high")
    if "profile" in parts:
        state.profile = {r.pop("feature"): r for r in rows("profile", "feature")}
    return state
