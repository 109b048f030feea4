"""One text file that many tasks write, each line at its own place, and that is there whole or not at all."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.window import Window

from ..runtime import drop_folder, new_folder, ship


@dataclass
class Written(WriterCommitMessage):
    bytes: int


class OneFileWriter(DataSourceArrowWriter):
    """Writes rows (at long, text string) into a file that the driver has made beside its target, and puts it in the target's place at commit.

    A row says where its bytes belong, so tasks may come in any order, twice, or again after a lost executor. They open the file and never make it:
    a task that outlives an abort finds none, and leaves nothing.
    """

    def __init__(self, options: dict[str, str]):
        self.path, self.part, self.size = options["path"], options["part"], int(options["size"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        total, fd = 0, os.open(self.part, os.O_WRONLY)
        try:
            for batch in iterator:
                texts = [t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
                at = batch.column("at").to_numpy()
                sizes = np.fromiter(map(len, texts), np.int64, len(texts))
                starts = np.flatnonzero(np.r_[True, at[1:] != (at + sizes)[:-1]][: len(texts)])
                for lo, hi in zip(starts, np.r_[starts[1:], len(texts)], strict=True):
                    data, place = memoryview(b"".join(texts[lo:hi])), int(at[lo])
                    while data:
                        done = os.pwrite(fd, data, place)
                        data, place = data[done:], place + done
                total += int(sizes.sum())
            os.fsync(fd)
        finally:
            os.close(fd)
        return Written(total)

    def commit(self, messages: list[Written | None]) -> None:
        found = sum(m.bytes for m in messages if m)
        if found != self.size or os.path.getsize(self.part) != self.size:
            raise OSError(f"{found} of {self.size} bytes were written for {self.path}")
        os.replace(self.part, self.path)
        folder = os.open(os.path.dirname(self.path), os.O_RDONLY)
        try:
            os.fsync(folder)
        finally:
            os.close(folder)

    def abort(self, messages: list[Written | None]) -> None:
        remove(self.part)


class OneFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "skeinlake-onefile"

    def writer(self, schema: T.StructType, overwrite: bool) -> OneFileWriter:
        return OneFileWriter(dict(self.options))


def remove(path: str) -> None:
    try:
        os.unlink(path)
    except FileNotFoundError:
        pass


def shared_file(path: str) -> str:
    """A path or file: URL as a path; other file systems can't be written at places."""
    found = urlsplit(path)
    if found.scheme not in ("", "file"):
        raise ValueError(f"{path}: one file needs a folder that the driver and all executors see as files")
    return os.path.abspath(unquote(found.path) if found.scheme else path)


def placed(rows: DataFrame, order: Sequence[str], text: str, kept: str) -> DataFrame:
    """(at, text): where the bytes of each text start if all are written in order, one after another.

    Rows are dealt by ranges of the order and written once to kept, since Spark draws ranges from a sample and would draw others the second time. A
    place is the bytes of the ranges before (a row each) and of the rows before in the own range.
    """
    spark = rows.sparkSession
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = rows.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)], F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    keys = own.columns[:-1]
    own.repartitionByRange(n, *keys).withColumn("range", F.spark_partition_id()).write.parquet(kept)
    ranged = spark.read.schema(T.StructType([*own.schema.fields, T.StructField("range", T.IntegerType())])).parquet(kept)
    size = F.octet_length("text").cast("long")
    sizes = ranged.groupBy("range").agg(F.sum(size).alias("bytes"))
    before = lambda w: F.coalesce(F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select("range", before(Window.orderBy("range")).alias("base"))  # a row for each range
    inside = ranged.withColumn("bytes", size).withColumn("inside", before(Window.partitionBy("range").orderBy(*keys)))
    return inside.join(F.broadcast(bases), "range").select((F.col("base") + F.col("inside")).alias("at"), "text")


def write(rows: DataFrame, order: Sequence[str], text: str, path: str, end: str = "\n") -> int:
    """Writes a column of rows as the lines of one UTF-8 file, in order, and gives its size in bytes.

    The file takes its place by a rename when all of it is written, readable by its owner alone; until then, and if the job fails, what was there
    stays. No task and no driver sees all lines. order should tell rows apart: those that are equal in it stand in any order, in one range. A null is an
    empty line, an empty table an empty file. Columns beside order and text are ignored.
    """
    spark = rows.sparkSession
    ship(spark)
    spark.dataSource.register(OneFile)
    target = shared_file(path)
    os.makedirs(os.path.dirname(target), exist_ok=True)
    part = f"{os.path.dirname(target)}/.{os.path.basename(target)}.{uuid.uuid4().hex}.part"
    kept = new_folder(spark, "lines")
    own = rows.select(*order, F.concat(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(end)).alias("_text"))
    try:
        lines = placed(own, order, "_text", kept)
        size = lines.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
        os.close(os.open(part, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600))
        lines.write.format(OneFile.name()).mode("append").option("path", target).option("part", part).option("size", size).save()
    finally:
        remove(part)
        drop_folder(spark, kept)
    return size
