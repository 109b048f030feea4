"""Helpers that the corpus operators share: shared-folder tables, size-checked joins, table readers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join may be broadcast up to this many rows of a few numbers each (about 24 MB).
BROADCAST_ROWS = 500_000
#: Deletes a query's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of an Arrow batch that goes to Python.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where that is unset and all runs in one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="skeinlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/skeinlake/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str, *by: str) -> DataFrame:
    """Writes df to the shared folder, in folders by the columns named, and reads it back: lineage ends there, and a lost executor costs no recomputation.

    The shuffles behind it are deleted once it is written, not when their plan is collected as garbage.
    """
    spark = df.sparkSession
    path = new_path(spark, what)
    own = {CLEANUP: "true", BATCH: BATCH_BYTES}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        df.write.partitionBy(*by).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._skeinlake_path = path
    return out


#: What empties each memory that a worker keeps from task to task, by the memory's name.
MEMORIES: dict[str, Callable[[], None]] = {}


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], memory: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run as a task for mapInArrow that gives memory back: a worker serves many stages, and what one remembers is no use to the next.

    All of MEMORIES but the one named are emptied at the start; at the end free pages go back to the system.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(memory)
        try:
            yield from run(batches)
        finally:
            release(memory)

    return task


def release(memory: str) -> None:
    for name, forget in MEMORIES.items():
        if name != memory:
            forget()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library, which keeps its free pages


def discard(*frames: DataFrame) -> None:
    """Deletes what materialize() wrote, once nothing reads it any more."""
    for df in frames:
        path = getattr(df, "_skeinlake_path", None)
        if path:
            delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def shield(docs: DataFrame, own: Sequence[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with all columns but own under names that no operator uses, and what gives them their names and places back."""
    names = docs.columns
    inner = {c: c if c in own else f"_kept{i}" for i, c in enumerate(names)}
    return docs.select(*[docs[c].alias(inner[c]) for c in names]), lambda out: out.select(*[F.col(inner[c]).alias(c) for c in names])


def broadcast_if_small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint only behind a check of the size; beyond it Spark shuffles both sides and splits hot keys."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df
