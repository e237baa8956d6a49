"""Listening sessions as a stream: seconds by user and day. An addition; a catalogue's own statistics are a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.sources.catalog import schema


def read(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Session records from a folder of Parquet files, as they come."""
    return spark.readStream.schema(schema("session")).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def daily(sessions: DataFrame, late: str = "2 days", at: str = "updated_at") -> DataFrame:
    """user_id, day, seconds, sessions; a session counts once, and a day closes when the watermark has passed it."""
    once = sessions.withWatermark(at, late).dropDuplicatesWithinWatermark(["id"])
    days = once.groupBy(F.window(at, "1 day"), "user_id").agg(F.sum("time_listening").alias("seconds"), F.count(F.lit(1)).alias("sessions"))
    return days.select("user_id", F.to_date("window.start").alias("day"), "seconds", "sessions")


def write(days: DataFrame, path: str, checkpoint: str):
    """Appends closed days to a Parquet table; restarts where it stopped. Handles all that is there, then ends."""
    return days.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
