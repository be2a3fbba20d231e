"""Event streams: windows with watermarks. An addition; every function takes batch frames as well."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", max_files).parquet(folder)


def watermarked(events: DataFrame, late: str) -> DataFrame:
    """Events with a watermark; one that they have already stays."""
    return events if "spark.watermarkDelayMs" in events.schema["ts"].metadata else events.withWatermark("ts", late)


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) by window; windows close once the watermark passes them."""
    out = watermarked(events, late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 days", step: str = "1 day", late: str = "1 hour") -> DataFrame:
    out = watermarked(events, late).groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """(user_id, start, n): events of a user that follow one another within the gap."""
    out = watermarked(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), "n")


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events without repeats of an event_id within the watermark."""
    marked = watermarked(events, late)
    return marked.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else marked.dropDuplicates(["event_id"])
