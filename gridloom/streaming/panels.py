"""Streaming panels: windowed sums with a watermark, and a recursive level carried per series."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_panel(events: DataFrame, ts: str, series: str, value: str, width: str = "1 day", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """series_id, window start, sum and count; rows later than the watermark are left out, state is dropped behind it."""
    stamped = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    win = F.window("_ts", width, slide) if slide else F.window("_ts", width)
    out = stamped.groupBy(win.alias("w"), F.col(series).cast("string").alias("series_id")).agg(F.sum(value).alias("y"), F.count(F.lit(1)).alias("n"))
    return out.select("series_id", F.col("w.start").alias("ts"), "y", "n")


def stream_levels(rows: DataFrame, alpha: float = 0.3) -> DataFrame:
    """Exponential level of each series over a stream of (series_id, ts, y); one state row a series, rows in time order
    within a batch."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        level, n = state.get if state.exists else (None, 0)
        pdf = pd.concat(list(batches)).sort_values("ts")
        out = []
        for y in pdf["y"]:
            level = float(y) if level is None else alpha * float(y) + (1 - alpha) * level
            n += 1
            out.append(level)
        state.update((level, n))
        yield pd.DataFrame({"series_id": pdf["series_id"], "ts": pdf["ts"], "level": out})

    narrow = rows.select(F.col("series_id").cast("string").alias("series_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("y").cast("double").alias("y"))
    return narrow.groupBy("series_id").applyInPandasWithState(run, "series_id string, ts timestamp, level double", "level double, n long", "append", "NoTimeout")


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a bounded stream to its end into a memory table (tests and small reports)."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
