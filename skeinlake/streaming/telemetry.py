"""Running telemetry over event time, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, time: str, width: str, key: str, value: str, late: str = "1 hour") -> DataFrame:
    """(window, key, n, total); on a stream, rows later than late are dropped and closed windows leave the state."""
    if events.isStreaming:  # watermarks want an instant
        source = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    else:
        source = events
    return source.groupBy(F.window(time, width), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def first_seen(events: DataFrame, time: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """A stream without rows that repeat keys within the watermark; as a batch, without any."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)
