"""Telemetry and detection-quality metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latency_snapshot(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, samples, median, p95): p95 is the element at index min(n - 1, int(0.95 n)) of the sorted sample.

    Ranks instead of collected lists: a key's values are counted by value first, so a key with many rows is as many rows as it has values.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    w = Window.partitionBy(key)
    ranked = counts.select(key, "v", F.sum("c").over(w.orderBy("v")).alias("upto"), F.sum("c").over(w).alias("n"), "c")
    at = lambda i: F.max(F.when((F.col("upto") - F.col("c") <= i) & (i < F.col("upto")), F.col("v")))
    n = F.col("n")
    return ranked.groupBy(key).agg(
        F.first("n").alias("samples"), ((at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2).alias("median"), at(F.least(n - 1, F.floor(n * 0.95))).alias("p95")
    )


def _counts(rows: DataFrame, key: str, truth: str, predicted: str) -> DataFrame:
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    return rows.groupBy(key).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))


def confusion(rows: DataFrame, key: str, truth: str, predicted: str) -> DataFrame:
    """Counts with precision, recall and specificity to six digits, null where there is nothing to divide by."""
    c = _counts(rows, key, truth, predicted)
    share = lambda a, b: F.round(F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0)), 6)
    return c.select(key, "tp", "fp", "fn", "tn", share("tp", "fp").alias("precision"), share("tp", "fn").alias("recall"), share("tn", "fp").alias("specificity"))


def macro_f1(rows: DataFrame, key: str, truth: str, predicted: str) -> DataFrame:
    """Means over the classes, 0 where there is nothing to divide by."""
    c = _counts(rows, key, truth, predicted)
    share = lambda a, b: F.when(F.col(a) + F.col(b) == 0, 0.0).otherwise(F.col(a) / (F.col(a) + F.col(b)))
    s = c.select(share("tp", "fp").alias("p"), share("tp", "fn").alias("r"))
    f1 = F.when(F.col("p") + F.col("r") == 0, 0.0).otherwise(2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r")))
    return s.agg(F.round(F.avg(f1), 6).alias("macro_f1"), F.round(F.avg("p"), 6).alias("macro_precision"), F.round(F.avg("r"), 6).alias("macro_recall"))


def coverage(found: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Share of known keys that were found."""
    k = known.select(key).distinct()
    return k.join(found.select(key).distinct().withColumn("hit", F.lit(1)), key, "left").agg(F.coalesce(F.count("hit") / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("coverage"))


def sample(rows: DataFrame, keys: Sequence[str], row_id: str, size: int, seed: str = "") -> DataFrame:
    """A uniform sample of at most size rows for each of keys: those whose seeded digest of row_id is least.

    Which rows those are doesn't depend on order or partitions, so samples of parts are merged by sampling their union. Tasks keep the least
    `size` of each key before the shuffle (Spark pushes the rank's bound below it), so a hot key sends that many rows from a task and no more.
    Rows of one id go in together or tie by nothing else; a null id counts as empty.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(row_id).cast("string"), F.lit(""))).cast("binary"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_digest"))
    return rows.withColumn("_digest", digest).withColumn("_place", place).where(F.col("_place") <= size).select(*rows.columns)
