"""Import of word lists: distinct entries in order, an id of the content, lists that are whole or not there."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.verdicts import wordlist_category, wordlist_label
from ..runtime import new_folder
from ..sources.files import numbered_lines
from .store import Store, number

#: Entries whose texts meet in one digest, and digests that meet in one of the next level.
CHUNK = 4096
#: Fixed value: what ends a line beside a line feed.
LINE_ENDS = r"[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


class WordlistError(ValueError):
    """A list that can't be imported; entries are never part of the message."""


def entries(lines: DataFrame, order: Sequence[str], value: str = "value") -> DataFrame:
    """(ordinal, value): the distinct entries from 0 on, each at the place of its first line; empty ones and nulls go, blanks within and around stay.

    A line that holds other line ends is several. Equal entries meet with partial aggregation, ordinals come from ranges of places and
    their counts; so neither a repeated entry nor the whole order is in one task.
    """
    parts = lines.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.posexplode(F.split(value, LINE_ENDS)).alias("_at", "value"))
    place = F.struct(*[f"_o{i}" for i in range(len(order))], "_at")
    first = parts.where("value <> ''").groupBy("value").agg(F.min(place).alias("place"))
    return number(first, "place", -1).select(F.col("id").cast("long").alias("ordinal"), "value")


def digest(rows: DataFrame, chunk: int = CHUNK) -> str | None:
    """The SHA-256 of entries (ordinal, value) in order, the same for any partitioning; null for none.

    Lists of at most chunk entries: the digest of their lines in UTF-8. Longer ones: chunks' digests are the lines of a next level, and so on; so a
    group has at most chunk rows, and one row reaches the driver.
    """
    held, n = rows, rows.count()
    if not n:
        return None
    while True:
        text = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "value"))), lambda x: x["value"]), F.lit(""))
        held = held.groupBy(F.floor(F.col("ordinal") / chunk).alias("of")).agg(F.sha2(text, 256).alias("value")).withColumnRenamed("of", "ordinal")
        n = -(-n // chunk)
        if n == 1:
            return held.first()["value"]


def add(store: Store, lines: DataFrame, order: Sequence[str], category: str, name: str, known: Sequence[str], max_entries: int | None = None) -> dict:
    """Imports lines as a list of a category, and gives its row of the table wordlists: id, category, label, sha256, entries, path.

    The list is written below the store's root to a folder named by its digest, which counts once Spark's committer has marked it; the table names it only
    then. So a lost job leaves no list, a second import of the same entries writes none, and readers see all of a list or nothing.
    """
    spark = store.spark
    path = new_folder(spark, "wordlist")
    entries(lines, order).write.parquet(path)
    rows = spark.read.schema("ordinal long, value string").parquet(path)
    n = rows.count()
    if not n:
        raise WordlistError("no entries")
    if max_entries is not None and n > max_entries:
        raise WordlistError(f"more than {max_entries} entries")
    said = spark.range(1).select(wordlist_category(F.lit(category), list(known)).alias("category"), wordlist_label(F.lit(name)).alias("label")).first()
    if said["category"] is None:
        raise WordlistError("no known category")
    sha = digest(rows)
    folder = re.sub(r"[^a-z0-9_-]", "_", said["category"])
    found = {"id": f"{folder}_{sha[:16]}", "category": said["category"], "label": said["label"], "sha256": sha, "entries": n, "path": f"{folder}/{sha}"}
    target = f"{store.root}/{found['path']}"
    if not _done(spark, target):
        rows.write.mode("overwrite").parquet(target)
    row = spark.createDataFrame([tuple(found.values())], "id string, category string, label string, sha256 string, entries long, path string")
    old = store.read("wordlists")
    store.write("wordlists", row if old is None else old.where(F.col("id") != found["id"]).unionByName(row))
    return found


def add_file(store: Store, path: str, category: str, known: Sequence[str], max_entries: int | None = None) -> dict:
    """add() of a text file in UTF-8 (a byte order mark is left aside), read in blocks by many tasks."""
    raw = store.spark.read.option("lineSep", "\n").text(path)
    if not raw.where(~F.is_valid_utf8("value")).isEmpty():
        raise WordlistError("no UTF-8")
    return add(store, numbered_lines(store.spark, path), ["file", "line"], category, path, known, max_entries)


def read(store: Store, item: str, verify: bool = True) -> DataFrame:
    """(ordinal, value) of an imported list, whose digest is taken again unless verify is off."""
    known = store.read("wordlists")
    row = known.where(F.col("id") == item).first() if known is not None else None
    if row is None:
        raise WordlistError("no such list")
    rows = store.spark.read.schema("ordinal long, value string").parquet(f"{store.root}/{row['path']}")
    if verify and digest(rows) != row["sha256"]:
        raise WordlistError("stored entries differ from their digest")
    return rows


def _done(spark: SparkSession, folder: str) -> bool:
    mark = spark._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)
