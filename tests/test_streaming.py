from pyspark.sql import functions as F

from conftest import SF_SMALL
from millwright.streaming import monitor


def test_hourly_kpis_stream_matches_batch(spark, tmp_path):
    """Every hour that the watermark has passed is in the sink once, with the batch's figures, and no other is."""
    folders = str(tmp_path / "q"), str(tmp_path / "out")
    out = monitor.run_hourly_kpis(spark, SF_SMALL, *folders)
    batch = monitor.flagged_readings(spark.read.parquet(f"{SF_SMALL}/events.parquet"))
    hours = monitor.hourly_kpis(batch)
    latest = batch.agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    final = hours.where(F.col("hour_end") <= F.lit(latest) - F.expr("INTERVAL 2 HOURS"))
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(out) == key(final) and 0 < final.count() < hours.count()
    again = monitor.run_hourly_kpis(spark, SF_SMALL, *folders)
    assert key(again) == key(final)
