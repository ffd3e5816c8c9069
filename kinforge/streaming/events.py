"""Streams of events and of family-tree files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events of each type in windows of ``width``; on a stream, windows close ``late`` after their end."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Each user's sessions: runs of events less than ``gap`` apart."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def arriving_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of family-tree files (UTF-8) as they arrive in a folder."""
    return spark.readStream.format("text").option("wholetext", "false").load(folder).select(F.input_file_name().alias("file"), F.col("value").alias("raw"))
