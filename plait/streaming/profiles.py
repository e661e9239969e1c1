"""Event-time profiles with watermarks: class counts and column profiles that arrive over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_counts(events: DataFrame, ts: str = "ts", klass: str = "event_type", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, klass, n) in tumbling windows; rows later than ``late`` are dropped with the state.  Batch or stream."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), F.col(klass).alias("klass")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "klass", "n")


def column_profile(cells: DataFrame, ts: str = "ts", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, col, base, n) of alignment cells that carry a time."""
    return cells.where("base != ' '").withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), "col", "base").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "col", "base", "n")
