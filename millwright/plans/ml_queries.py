"""Registered queries: split, scaling, the five classifiers, evaluation, choice and scoring.

Classifiers are trained on the event readings (unique ids); model outputs are
checked rows-only. Split, scaling, class counts and the probability-to-tier
and confidence formulas have exact SQL oracles (the latter two over a
transparent baseline score: the failure rate of the reading's product).
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from millwright import schema as S
from millwright.operators import fleet, metrics, ml, quality, report
from millwright.operators.state import FittedState, exists, load_state, save_state
from millwright.plans.registry import fitted, register, round_doubles, state_path
from millwright.plans.risk_queries import fitted_model
from millwright.plans.sql import SPLIT_HASH, with_readings
from millwright.sources.readings import readings_from_events, readings_from_lineitem
from millwright.sources.requests import validated_requests


def fitted_suite(spark, sf_dir: str, names: list[str] = S.MODEL_NAMES) -> ml.Suite:
    """The named models of the event readings. Each is in the session's store by itself, so a query fits only those that it needs."""
    at = {name: state_path(spark, sf_dir, f"events-{name.lower().replace(' ', '-')}") for name in names}
    missing = [name for name in names if not exists(spark, f"{at[name]}/manifest")]
    if missing:
        suite = ml.train_suite(readings_from_events(spark, sf_dir), missing)
        for name in missing:
            save_state(spark, FittedState(suite=ml.only(suite, name)), at[name])
    return ml.joined(spark, [load_state(spark, at[name]).suite for name in names])


def fitted_state(spark, sf_dir: str) -> FittedState:
    """Models and feature profile of the event readings, from the session's store."""
    profile = fitted(spark, sf_dir, "events", lambda: FittedState(profile=quality.fit_profile(readings_from_events(spark, sf_dir))))
    return replace(profile, suite=fitted_suite(spark, sf_dir))


_FM0 = ("udi, coalesce(air_temp_k, 0) AS air_temp_k, coalesce(process_temp_k, 0) AS process_temp_k, "
       "coalesce(rpm, 0) AS rpm, coalesce(torque_nm, 0) AS torque_nm, coalesce(tool_wear_min, 0) AS tool_wear_min, "
       "CASE WHEN type = 'H' THEN 1e0 ELSE 0e0 END AS type_h, CASE WHEN type = 'L' THEN 1e0 ELSE 0e0 END AS type_l, "
       "CASE WHEN type = 'M' THEN 1e0 ELSE 0e0 END AS type_m, coalesce(machine_failure, 0) AS label")
_FM = (f"* EXCLUDE (rk, nk), CASE WHEN rk <= floor(nk * 2e-1 + 5e-1) THEN 'test' ELSE 'train' END AS split FROM ("
       f"SELECT *, row_number() OVER (PARTITION BY label ORDER BY {SPLIT_HASH}, udi) AS rk, "
       f"count(*) OVER (PARTITION BY label) AS nk FROM (SELECT {_FM0} FROM readings) f0) f1")


@register("train_test_split", with_readings(f"SELECT udi, label, split FROM (SELECT {_FM}) f", "events"))
def q_train_test_split(spark, sf_dir):
    return ml.prepared(readings_from_events(spark, sf_dir)).select(S.UDI, "label", "split")


@register("class_distribution", with_readings(
    f"SELECT split, label, count(*) AS n FROM (SELECT {_FM}) f GROUP BY split, label", "events"))
def q_class_distribution(spark, sf_dir):
    return ml.class_distribution(ml.prepared(readings_from_events(spark, sf_dir)))


@register("scaled_features", with_readings(
    f"WITH f AS (SELECT {_FM}), st AS (SELECT "
    + ", ".join(f"avg({c}) AS {c}_m, CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1e0 END AS {c}_s"
                for c in S.FEATURES)
    + " FROM f WHERE split = 'train') SELECT f.udi, f.split, "
    + ", ".join(f"round((f.{c} - st.{c}_m) / st.{c}_s, 4) AS {c}" for c in S.FEATURES)
    + " FROM f, st", "events"))
def q_scaled_features(spark, sf_dir):
    data = ml.prepared(readings_from_events(spark, sf_dir))
    scaler = ml.fit_scaler(data.where(F.col("split") == "train"))
    return round_doubles(scaler.transform(data).select(S.UDI, "split", *S.FEATURES))


def _model_row(name: str):
    def q(spark, sf_dir):
        return fitted_suite(spark, sf_dir, [name]).metrics
    return q


for _key, _name in [("train_rf", "Random Forest"), ("train_gbt", "Gradient Boosting"),
                    ("train_lr", "Logistic Regression"), ("train_dt", "Decision Tree"),
                    ("train_mlp", "Neural Network MLP")]:
    register(_key)(_model_row(_name))


@register("trained_comparison")
def q_trained_comparison(spark, sf_dir):
    return ml.model_comparison(fitted_suite(spark, sf_dir).metrics)


@register("trained_best")
def q_trained_best(spark, sf_dir):
    return ml.best_model(fitted_suite(spark, sf_dir).metrics)


# --- metrics of many models over one prediction table, with exact SQL ---------
# The predictions are transparent scores of the line-item readings, one "model" each.

_SCORERS = [("wear", "tool_wear_min", 150.0), ("torque", "torque_nm", 50.0), ("speed", "0 - rpm", -1380.0),
            ("cooling", "air_temp_k - process_temp_k", -8.6), ("load", "tool_wear_min * torque_nm", 9000.0)]
_PREDICTIONS = "\nUNION ALL\n".join(
    f"SELECT '{m}' AS model, {i} AS pos, machine_failure AS label, CASE WHEN {e} >= {t:e} THEN 1 ELSE 0 END AS prediction, {e} AS score "
    "FROM readings" for i, (m, e, t) in enumerate(_SCORERS))
_BY_MODEL = f"""
 p AS ({_PREDICTIONS}),
 c AS (SELECT model, pos, count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn, count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
   count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn, count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp FROM p GROUP BY model, pos),
 h AS (SELECT model, score, sum(label) * 1e0 AS y, sum(1 - label) * 1e0 AS n FROM p WHERE score IS NOT NULL GROUP BY model, score),
 r AS (SELECT *, sum(n) OVER (PARTITION BY model ORDER BY score) - n AS below FROM h),
 a AS (SELECT model, sum(y * (below + n / 2e0)) / (sum(y) * sum(n)) AS auc FROM r GROUP BY model),
 m AS (SELECT c.*, (tp + tn) * 1e0 / (tn + fp + fn + tp) AS accuracy, CASE WHEN tp + fp > 0 THEN tp * 1e0 / (tp + fp) ELSE 0e0 END AS precision,
   CASE WHEN tp + fn > 0 THEN tp * 1e0 / (tp + fn) ELSE 0e0 END AS recall, 2e0 * tp / (2 * tp + fp + fn) AS f1, auc AS roc_auc
   FROM c JOIN a ON a.model = c.model)
"""
_ROUNDED = "model, pos, tn, fp, fn, tp, " + ", ".join(f"round({c}, 4) AS {c}" for c in ("accuracy", "precision", "recall", "f1", "roc_auc"))


def _by_model(spark, sf_dir):
    r = readings_from_lineitem(spark, sf_dir)
    each = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(i).alias("pos"), F.col(S.LABEL).alias("label"),
                              F.when(F.expr(e) >= t, 1).otherwise(0).alias("prediction"), F.expr(e).alias("score"))
                     for i, (m, e, t) in enumerate(_SCORERS)])
    return metrics.model_metrics(r.select(F.inline(each)), ["model", "pos"])


@register("model_metrics", with_readings(f"WITH {_BY_MODEL} SELECT {_ROUNDED}, 0 AS skipped, 0 AS unscored FROM m"))
def q_model_metrics(spark, sf_dir):
    return round_doubles(_by_model(spark, sf_dir))


@register("model_comparison", with_readings(
    f"WITH {_BY_MODEL} SELECT row_number() OVER (ORDER BY recall DESC, pos) AS place, {_ROUNDED} FROM m"))
def q_model_comparison(spark, sf_dir):
    """The models in order of recall; ``place`` is over a row for each model."""
    table = _by_model(spark, sf_dir).drop("skipped", "unscored")
    ranked = ml.model_comparison(table).withColumn("place", F.row_number().over(Window.orderBy(F.desc("recall"), "pos")))
    return round_doubles(ranked)


@register("best_model", with_readings(
    f"WITH {_BY_MODEL} SELECT {_ROUNDED} FROM m ORDER BY recall DESC, roc_auc DESC NULLS LAST, pos LIMIT 1"))
def q_best_model(spark, sf_dir):
    return round_doubles(ml.best_model(_by_model(spark, sf_dir).drop("skipped", "unscored")))


@register("feature_importance")
def q_feature_importance(spark, sf_dir):
    rows = ml.feature_importance(fitted_suite(spark, sf_dir))
    return spark.createDataFrame(rows, "model string, feature string, importance double").orderBy(
        "model", F.desc("importance"))


@register("summary_stats")
def q_summary_stats(spark, sf_dir):
    """Total, failures, rate and the chosen model's test accuracy in percent (1 decimal)."""
    suite = fitted_suite(spark, sf_dir)
    k = fleet.kpis(readings_from_events(spark, sf_dir))
    acc = suite.metrics.where(F.col("model") == F.lit(suite.best)).select(F.round(F.col("accuracy") * 100.0, 1))
    return k.select("total_operations", "failures", "failure_rate",
                    F.coalesce(acc.scalar(), F.lit(0.0)).alias("model_acc"))


def _scored_requests(spark, sf_dir):
    return validated_requests(spark, sf_dir).where(F.col("status") == "scored")


@register("predict")
def q_predict(spark, sf_dir):
    """Best model on the valid scoring requests: prediction and failure probability."""
    suite = fitted_suite(spark, sf_dir)
    p = ml.score(suite, _scored_requests(spark, sf_dir))
    return p.select("request_id", "prediction", (F.col("p1") * 100.0).alias("failure_risk"))


@register("score_report")
def q_score_report(spark, sf_dir):
    """Full report per valid request: risk, tier, outcome, confidence, modes with risk, anomaly, warnings."""
    state = replace(fitted_state(spark, sf_dir), risk=fitted_model(spark, sf_dir))
    return report.score_report(_scored_requests(spark, sf_dir), state)


# --- tier and confidence formulas over a baseline score ---------------------

_PRIOR_SQL = f"""WITH prior AS (SELECT product_id, avg(machine_failure * 1e0) AS p FROM readings GROUP BY product_id),
 sc AS (SELECT r.*, prior.p FROM readings r JOIN prior ON prior.product_id = r.product_id)"""


def _prior_scores(spark, sf_dir):
    r = readings_from_lineitem(spark, sf_dir)
    prior = r.groupBy(S.PRODUCT_ID).agg(F.avg(F.col(S.LABEL).cast("double")).alias("p"))
    return r.join(prior, S.PRODUCT_ID)


@register("risk_tier", with_readings(_PRIOR_SQL + """
SELECT udi, product_id, round(p * 100e0, 4) AS failure_risk,
  CASE WHEN p * 100e0 > 70 THEN 'HIGH RISK' WHEN p * 100e0 > 40 THEN 'MEDIUM RISK' ELSE 'LOW RISK' END AS status FROM sc"""))
def q_risk_tier(spark, sf_dir):
    """Tier of a failure probability; the score is the product's empirical failure rate."""
    s = _prior_scores(spark, sf_dir)
    pct = F.col("p") * 100.0
    return round_doubles(s.select(S.UDI, S.PRODUCT_ID, pct.alias("failure_risk"), ml.risk_tier(pct).alias("status")))


_PROFILE = ", ".join(
    f"(SELECT avg({c}) FROM readings) AS {c}_mean, "
    f"(SELECT CASE WHEN stddev_samp({c}) > 0 THEN stddev_samp({c}) ELSE 1e-9 END FROM readings) AS {c}_std, "
    f"(SELECT min({c}) FROM readings) AS {c}_min, (SELECT max({c}) FROM readings) AS {c}_max" for c in S.SENSORS)


@register("confidence", with_readings(_PRIOR_SQL + f""",
 prof AS (SELECT {_PROFILE}),
 z AS (SELECT sc.udi, sc.p, CASE WHEN sc.p >= 0.5 THEN 1 ELSE 0 END AS pred,
   greatest({", ".join(f"abs((sc.{c} - prof.{c}_mean) / prof.{c}_std)" for c in S.SENSORS)}) AS mz,
   {" OR ".join(f"sc.{c} < prof.{c}_min OR sc.{c} > prof.{c}_max" for c in S.SENSORS)} AS oor FROM sc, prof),
 c AS (SELECT udi, pred, least(greatest(0.7e0 * CASE WHEN pred = 1 THEN p ELSE 1e0 - p END
   + 0.3e0 * least(greatest(1e0 - (0.6e0 * least(mz / 4e0, 1e0) + CASE WHEN oor THEN 0.4e0 ELSE 0e0 END), 0e0), 1e0),
   0e0), 1e0) * 100e0 AS confidence FROM z)
SELECT udi, pred AS prediction, round(confidence, 4) AS confidence,
  CASE WHEN confidence >= 80 THEN 'HIGH' WHEN confidence >= 60 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_label FROM c"""))
def q_confidence(spark, sf_dir):
    """Confidence of the baseline prediction (rate >= 0.5), with the reading's quality component."""
    r = readings_from_lineitem(spark, sf_dir)
    prof = quality.fit_profile(r)
    s = quality.assess_quality(_prior_scores(spark, sf_dir), prof)
    pred = F.when(F.col("p") >= 0.5, 1).otherwise(0)
    s = s.select(S.UDI, pred.alias("prediction"),
                 ml.confidence(F.col("p"), pred, F.col("confidence_component")).alias("confidence"))
    return round_doubles(s.select("*", ml.confidence_label(F.col("confidence")).alias("confidence_label")))
