"""Structured Streaming over change events; an extension beside the batch operators.

Sources are folders of files (`readStream`), state is bounded by watermarks, and every function
takes and returns a streaming DataFrame, so callers choose sink and trigger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, names: str = "*.parquet", files_per_trigger: int = 16) -> DataFrame:
    """Events of the files in a folder whose names match, as they arrive."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", names).parquet(folder)


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, event_type, n, total): tumbling windows, closed `late` after their end."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return by.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, session_start, n): sessions that end after a gap."""
    by = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return by.select("user_id", F.col("session_window.start").alias("session_start"), "n")


def first_seen(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events without repeats of their id, within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
