import random

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.linalg import Vectors

from millwright.operators import metrics


def test_auc_equals_evaluator_and_forced_buckets(spark):
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 1), float(rnd.randint(0, 50))) for _ in range(2000)]
    df = spark.createDataFrame(rows, "label int, score double")
    ours = metrics.roc_auc(df).first().roc_auc
    forced = metrics.roc_auc(df, rows_per_bucket=5).first().roc_auc
    ev = BinaryClassificationEvaluator(rawPredictionCol="raw", labelCol="label", metricName="areaUnderROC")
    vec = spark.createDataFrame([(float(y), Vectors.dense([-s, s])) for y, s in rows], ["label", "raw"])
    assert abs(ours - ev.evaluate(vec)) < 1e-9
    assert abs(ours - forced) < 1e-12


def test_confusion_and_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "label int, prediction int")
    m = metrics.classification_metrics(df).first()
    assert (m.tn, m.fp, m.fn, m.tp) == (2, 0, 1, 0)
    assert m.precision == 0.0 and m.recall == 0.0 and m.f1 == 0.0
