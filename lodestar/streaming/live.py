"""Streams: log lines as they arrive, totals of tumbling windows, and running totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import log_level


def follow_lines(spark: SparkSession, folder: str, levels: list[str] | None = None, glob: str = "*.log") -> DataFrame:
    """path, line, level of log files that come into a folder, of the levels asked for (null: all)."""
    rows = spark.readStream.option("pathGlobFilter", glob).text(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))
    rows = rows.withColumn("level", log_level(F.col("line")))
    return rows.filter(F.col("level").isin(levels)) if levels else rows


def windowed_totals(events: DataFrame, ts: str, key: str, value: str, width: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """key, started, calls, units of each window, given out once it is complete (append mode): its end is `late` behind the stream."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), key).agg(F.count(F.lit(1)).alias("calls"), F.sum(value).alias("units")).select(key, F.col("w.start").alias("started"), "calls", "units")


def running_totals(events: DataFrame, key: str, value: str) -> DataFrame:
    """key, calls, units, highest since the start (update or complete mode); the state is a row a key."""
    return events.groupBy(key).agg(F.count(F.lit(1)).alias("calls"), F.sum(value).alias("units"), F.max(value).alias("highest"))
