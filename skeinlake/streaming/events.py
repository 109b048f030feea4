"""Event logs as streams: tailing segments, topics in order, and near-duplicate memory."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "schema_version string, timestamp string, event string, target string, scan_id long, data string"


def tail(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Lines of the segments that are added to folder, as a stream. Segments don't change: a log that is appended in place is cut into them by whoever writes it."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)


def records(lines: DataFrame, value: str = "value") -> DataFrame:
    """Event records of JSON lines, batch or stream; what is no record is passed over. data stays JSON text."""
    one = F.from_json(value, RECORD)
    return lines.select(one.alias("r"), F.get_json_object(value, "$.data").alias("d")).where("r.event is not null").select("r.schema_version", "r.timestamp", "r.event", "r.target", "r.scan_id", F.col("d").alias("data"))


def dispatch(stream: DataFrame, handlers: Mapping[str, Callable[[DataFrame], None]], priority: str = "priority", sequence: str = "sequence", topic: str = "topic"):
    """A writer that hands each batch to its topic's handler, then to that of *, in order of priority and sequence."""

    def each(batch: DataFrame, _: int) -> None:
        batch.persist()
        for name, handle in handlers.items():
            own = batch if name == "*" else batch.where(F.col(topic) == name)
            handle(own.orderBy(priority, sequence))
        batch.unpersist()

    return stream.writeStream.foreachBatch(each)
