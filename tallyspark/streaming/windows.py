"""Streams of events: windowed counts with a watermark, intake without repeated files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) for tumbling windows; the same plan runs on a table and, with a watermark, on a stream.

    Event times without a zone count in the session's time zone, on a table as on a stream; start has the type of `ts`.
    Rows later than `late` are left out of a stream's closed windows, never of a table's. Null times form no window.
    """
    kind = events.schema["ts"].dataType
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    got = events.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"))
    return got.select(F.col("window.start").cast(kind).alias("start"), "event_type", "n", "total")


def fresh_files(files: DataFrame, late: str = "1 hour") -> DataFrame:
    """Files of an intake stream or table without byte-identical repeats."""
    hashed = files.withColumn("content_hash", F.sha2("content", 256))
    if files.isStreaming:
        return hashed.withWatermark("modificationTime", late).dropDuplicatesWithinWatermark(["content_hash"])
    return hashed.groupBy("content_hash").agg(F.min_by(F.struct(*files.columns), F.struct("modificationTime", "path")).alias("f")).select("f.*", "content_hash")
