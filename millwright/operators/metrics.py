"""Binary classification metrics of one or many models, exact, in one pass over their predictions.

Everything follows from a histogram: rows per (model, score, label, prediction), map-side combined.
Confusion counts are sums over it; the rank AUC needs the running count of negatives in score order,
a bucketed prefix sum for all models together (``ordered.running_sum``). Rows whose label or
prediction is no 0/1 take part in no figure and are counted in ``skipped``; a missing or NaN score
leaves a row out of the AUC only and counts in ``unscored``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.operators import ordered

COUNTS = ["tn", "fp", "fn", "tp"]


def _count(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col("_n")).otherwise(F.lit(0))), F.lit(0)).cast("bigint")


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def histogram(df: DataFrame, by: list[str], label: str, prediction: str | None, score: str | None) -> DataFrame:
    """``by, _y, _p, _s, _n``: rows by label, prediction and score, whatever their values are.

    What is no 0/1 or no number is told apart on the histogram's few rows, not on the input's.
    """
    value = lambda c: F.col(c).cast("double") if c else F.lit(None).cast("double")
    keys = df.select(*by, value(label).alias("_y"), value(prediction).alias("_p"), value(score).alias("_s"))
    return keys.groupBy(*by, "_y", "_p", "_s").agg(F.count(F.lit(1)).alias("_n"))


def _confusion(hist: DataFrame, by: list[str]) -> DataFrame:
    y, p, s = F.col("_y"), F.col("_p"), F.col("_s")
    cell = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}
    told = F.coalesce(y.isin(0.0, 1.0) & p.isin(0.0, 1.0), F.lit(False))
    return hist.groupBy(*by).agg(*[_count((y == a) & (p == b)).alias(k) for k, (a, b) in cell.items()],
                                 _count(~told).alias("skipped"), _count(s.isNull() | F.isnan(s)).alias("unscored"))


def _figures(counts: DataFrame, by: list[str], keep: list[str]) -> DataFrame:
    tn, fp, fn, tp = (F.col(c).cast("double") for c in COUNTS)
    return counts.select(
        *by, *COUNTS, _ratio(tp + tn, tn + fp + fn + tp).alias("accuracy"), _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"), _ratio(2.0 * tp, 2.0 * tp + fp + fn).alias("f1"), *keep)


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction", by: list[str] = ()) -> DataFrame:
    """``tn, fp, fn, tp`` and ``skipped`` (labels or predictions that are no 0/1), a row for each ``by``."""
    return _confusion(histogram(df, [*by], label, prediction, None), [*by]).drop("unscored")


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction", by: list[str] = ()) -> DataFrame:
    """Accuracy, precision, recall, F1 (0 when a denominator is 0), the confusion counts and ``skipped``."""
    return _figures(confusion_matrix(df, label, prediction, by), [*by], ["skipped"])


def _auc(hist: DataFrame, by: list[str], rows_per_bucket: int) -> DataFrame:
    scores = (hist.where("_s is not null and not isnan(_s) and _y in (0, 1)").withColumn("_g", F.lit(0)).groupBy("_g", *by, "_s")
              .agg(_count(F.col("_y") == 1).alias("_ones"), _count(F.col("_y") == 0).alias("_zeros")))
    group = ["_g", *by]
    bounds = ordered.range_bounds(scores, group, "_s", rows_per_bucket)
    cum = ordered.running_sum(scores, group, "_s", "_zeros", bounds, out="_upto")
    pos, neg = F.col("_ones").cast("double"), F.col("_zeros").cast("double")
    below = F.col("_upto").cast("double") - neg
    a = cum.groupBy(*by).agg(F.sum(pos * (below + neg / 2.0)).alias("_num"), F.sum(pos).alias("_pos"), F.sum(neg).alias("_neg"))
    both = (F.col("_pos") > 0) & (F.col("_neg") > 0)
    return a.select(*by, F.when(both, F.col("_num") / (F.col("_pos") * F.col("_neg"))).alias("roc_auc"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score",
            rows_per_bucket: int = ordered.ROWS_PER_BUCKET, by: list[str] = ()) -> DataFrame:
    """Exact ROC-AUC with ties counted half (the Mann-Whitney form); NULL when a class is absent.

    The sum over distinct scores of ``pos * (neg_below + neg / 2)``, divided by P * N.
    """
    return _auc(ordered.stored(histogram(df, [*by], label, None, score), "scores"), [*by], rows_per_bucket)


def model_metrics(df: DataFrame, by: list[str], label: str = "label", prediction: str = "prediction",
                  score: str = "score", rows_per_bucket: int = ordered.ROWS_PER_BUCKET) -> DataFrame:
    """All figures of each model of a prediction table: its histogram is stored once and read by both parts."""
    hist = ordered.stored(histogram(df, by, label, prediction, score), "scores")
    auc = _auc(hist, by, rows_per_bucket)
    named = auc.select(*[F.col(c).alias(f"_of_{c}") for c in by], "roc_auc")
    on = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by]
    joined = _confusion(hist, by).join(named, on, "left")
    return _figures(joined, by, ["roc_auc", "skipped", "unscored"])
