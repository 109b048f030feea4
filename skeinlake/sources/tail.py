"""A log that is appended in place, truncated and rotated, as a stream."""

from __future__ import annotations

import glob
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..runtime import ship

#: Bytes of a file's start that tell whether it has been written anew, bytes of a task, bytes that are read at once.
HEAD, CHUNK, BLOCK = 256, 8 << 20, 1 << 20


@dataclass
class Part(InputPartition):
    """The lines of a file that start from lo up to hi; start says whether lo is where a line starts."""

    path: str
    inode: int
    lo: int
    hi: int
    start: bool


def find(path: str, inode: int) -> str | None:
    """Where the file of this inode is now: at path, or beside it under a longer name, as rotation leaves it."""
    for name in [path, *sorted(glob.glob(glob.escape(path) + "?*"))]:
        try:
            if os.stat(name).st_ino == inode:
                return name
        except FileNotFoundError:
            pass
    return None


def head(path: str, size: int) -> int:
    with open(path, "rb") as f:
        return zlib.crc32(f.read(min(size, HEAD)))


def ended(path: str) -> tuple[int, int]:
    """The inode, and the place after the last line that is whole."""
    with open(path, "rb") as f:
        inode, at = os.fstat(f.fileno()).st_ino, os.fstat(f.fileno()).st_size
        while at:
            lo = max(0, at - BLOCK)
            f.seek(lo)
            last = f.read(at - lo).rfind(b"\n")
            if last >= 0:
                return inode, lo + last + 1
            at = lo
    return inode, 0


class Tail(DataSource):
    """format("skeinlake_tail") with the options path, chunkBytes and failOnDataLoss (true)."""

    @classmethod
    def name(cls) -> str:
        return "skeinlake_tail"

    def schema(self) -> str:
        return "value string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


class TailReader(DataSourceStreamReader):
    """An offset is (inode, bytes read, checksum of the file's start): it names the file, not its path, so a renamed file is read to its end, and
    a batch that is planned again after a restart has the same lines. A line without its end stays for later, but for that of a file that was renamed.

    Of the same inode, fewer bytes than were read or another start mean that the file was written anew: it is read from its start.
    """

    def __init__(self, options: dict):
        self.path = options["path"].removeprefix("file://")
        self.chunk = int(options.get("chunkBytes", CHUNK))
        self.strict = str(options.get("failOnDataLoss", "true")).lower() == "true"
        self.last = self.initialOffset()

    def initialOffset(self) -> dict:
        return {"inode": 0, "at": 0, "head": 0}

    def latestOffset(self) -> dict:
        try:
            inode, at = ended(self.path)
            self.last = {"inode": inode, "at": at, "head": head(self.path, at)}
        except FileNotFoundError:
            pass  # between two files: what was seen last holds
        return self.last

    def partitions(self, start: dict, end: dict) -> list[Part]:
        if start == end:
            return []
        now = find(self.path, end["inode"])
        if now is None:
            return self._lost(f"the file of inode {end['inode']} is gone")
        same = start["inode"] == end["inode"]
        kept = same and end["at"] >= start["at"] and head(now, start["at"]) == start["head"]
        if kept:
            return self._cut(now, end["inode"], start["at"], end["at"])
        before = [] if same or not start["inode"] else self._rotated(start, end)
        return [*before, *self._cut(now, end["inode"], 0, end["at"])]

    def _rotated(self, start: dict, end: dict) -> list[Part]:
        """The rest of the file that was read so far, and files that came and went since."""
        old = find(self.path, start["inode"])
        if old is None:
            return self._lost(f"the file of inode {start['inode']} was rotated away before it was read to its end")
        rest = os.stat(old)
        out = self._cut(old, start["inode"], start["at"] if rest.st_size >= start["at"] else 0, rest.st_size)
        others = [(s.st_mtime_ns, name, s) for name in glob.glob(glob.escape(self.path) + "?*") for s in [os.stat(name)] if s.st_ino not in (start["inode"], end["inode"]) and s.st_mtime_ns > rest.st_mtime_ns]
        return out + [p for _, name, s in sorted(others, key=lambda x: x[:2]) for p in self._cut(name, s.st_ino, 0, s.st_size)]

    def _lost(self, what: str) -> list[Part]:
        if self.strict:
            raise ValueError(f"{self.path}: {what}; set failOnDataLoss to false to go on without it")
        return []

    def _cut(self, path: str, inode: int, lo: int, hi: int) -> list[Part]:
        return [Part(path, inode, at, min(at + self.chunk, hi), at == lo) for at in range(lo, hi, self.chunk)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        path = find(self.path, part.inode)  # it may have been renamed since the batch was planned
        if path is None:
            self._lost(f"the file of inode {part.inode} is gone")
            return
        with open(path, "rb") as f:
            f.seek(part.lo)
            if not part.start:
                f.seek(part.lo - 1)
                f.readline()  # a line that started before belongs to the part before
            held, size = [], 0
            while f.tell() < part.hi and (line := f.readline()):
                held.append(line.removesuffix(b"\n").removesuffix(b"\r").decode("utf-8", "replace"))
                size += len(line)
                if size >= BLOCK:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["value"])
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["value"])


def tail(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The lines of the log at path as a stream, from its start: appended, truncated and rotated ones.

    path is in a folder that the driver and all executors see as files, with inodes. Logs that are shipped as whole segments are better read by
    events.tail().
    """
    ship(spark)
    spark.dataSource.register(Tail)
    return spark.readStream.format(Tail.name()).option("path", path).options(**options).load()
