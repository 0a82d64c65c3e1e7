import pytest
from pyspark.sql import functions as F

from gridloom.streaming import panels


def test_stream_panel_equals_batch(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    made = panels.drain(panels.stream_panel(stream, "ts", "event_type", "value", late="400 days"), "streamed", "complete")
    batch = source.groupBy(F.col("event_type").alias("series_id"), F.date_trunc("day", F.col("ts").cast("timestamp")).alias("ts")).agg(F.sum("value").alias("y"), F.count(F.lit(1)).alias("n"))
    key = lambda df: {(r["series_id"], r["ts"]): (pytest.approx(r["y"]), r["n"]) for r in df.collect()}
    assert key(made) == key(batch)


def test_stream_levels(spark, tmp_path):
    for i, y in enumerate([10.0, 20.0, 40.0]):
        spark.createDataFrame([("a", f"2026-01-0{i + 1}", y)], "series_id string, t string, y double").select("series_id", F.to_timestamp("t").alias("ts"), "y").coalesce(1).write.parquet(str(tmp_path / "in" / f"d={i}"))
    stream = spark.readStream.schema("series_id string, ts timestamp, y double, d int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = panels.drain(panels.stream_levels(stream, 0.5), "levels")
    assert sorted(round(r["level"], 6) for r in got.collect())[-1] >= 20
    assert got.count() == 3
