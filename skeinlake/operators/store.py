"""Tables of scans, findings and caches on Parquet, with one writer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..runtime import new_folder


def number(rows: DataFrame, order: str, after: int) -> DataFrame:
    """rows with ids after, in order: ranks within ranges of the order, and the ranges' counts before them, so that no task sees all rows.

    The ranges are written once: Spark draws them from a sample, and would draw others for the counts than for the ranks.
    """
    spark = rows.sparkSession
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    path = new_folder(spark, "ranges")
    rows.repartitionByRange(n, order).withColumn("_p", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("_p", T.IntegerType())])).parquet(path)
    ranked = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy(order)))
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_c"))
    bases = counts.withColumn("_b", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_b")
    return ranked.join(bases, "_p").select((F.col("_n") + F.col("_b") + after).alias("id"), *rows.columns)


def cache_view(rows: DataFrame, keys: Sequence[str], order: Column, expires: Column, now: Column) -> DataFrame:
    """The latest row of each key, unless it has expired."""
    own = F.struct(*rows.columns, expires.alias("_e"))
    return rows.groupBy(*keys).agg(F.max_by(own, order).alias("_r")).select("_r.*").where(F.col("_e") >= now).drop("_e")


#: The table of the migrations that have been applied.
MIGRATED = "schema_migrations"


class Store:
    """Tables of scans, findings, endpoints, history and caches below one folder, with one writer at a time.

    A table is a series of versions; a new one is written whole to its own folder and counts once Spark's committer has marked it done,
    so a reader sees the old or the new version and a lost job leaves the old one.
    """

    def __init__(self, spark, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _versions(self, name: str) -> list[str]:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        done = [s.getPath().getName() for s in fs.listStatus(path) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        if any("." in v for v in done):
            applied = self.applied()
            done = [v for v in done if "." not in v or v.split(".", 1)[1] in applied]
        return sorted(done)

    def applied(self) -> dict[str, object]:
        """The migrations that count, with the times at which they were applied; a row each."""
        found = self.read(MIGRATED)
        return {} if found is None else {r["version"]: r["applied_at"] for r in found.collect()}

    def read(self, name: str) -> DataFrame | None:
        versions = self._versions(name)
        return self.spark.read.parquet(f"{self.root}/{name}/{versions[-1]}") if versions else None

    def write(self, name: str, rows: DataFrame, migration: str = "") -> DataFrame:
        """Writes the next version of a table; one of a migration counts once the migration does. What a lost job left in its place goes."""
        versions = self._versions(name)
        after = f"v{(int(versions[-1][1:9]) if versions else 0) + 1:08d}" + (f".{migration}" if migration else "")
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/{after}")
        return self.spark.read.parquet(f"{self.root}/{name}/{after}")

    def forget(self, migration: str) -> None:
        """Removes what an attempt at a migration left in any table."""
        jvm = self.spark._jvm
        left = jvm.org.apache.hadoop.fs.Path(f"{self.root}/*/v*.{migration}")
        fs = left.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for s in fs.globStatus(left) or ():
            fs.delete(s.getPath(), True)

    def add_scan(self, scan: dict, findings: DataFrame, keys: Sequence[str] = ("target", "id", "url", "parameter")) -> int:
        """Stores a scan and its findings (first of equal fingerprints), brings the history up to date, and gives the scan's id."""
        from ..functions.findings import fingerprint
        from .dedupe import first_wins, history

        old = self.read("scans")
        scan_id = 1 + (old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"] if old is not None else 0)
        row = self.spark.createDataFrame([(scan_id, scan.get("target", ""), scan.get("started", ""))], "id long, target string, started string")
        fp = fingerprint(*[F.col(k) if k in findings.columns else F.lit("") for k in keys])
        own = findings.withColumn("fp", fp).withColumn("scan_id", F.lit(scan_id).cast("long"))
        before = self.read("findings")
        kept = first_wins(own, [F.col("fp")], "ordinal")
        self.write("history", history(self.read("history"), own))
        self.write("findings", kept if before is None else before.unionByName(kept, allowMissingColumns=True))
        self.write("scans", row if old is None else old.unionByName(row, allowMissingColumns=True))
        return scan_id

    def recent_scans(self, limit: int = 20) -> DataFrame:
        return self.read("scans").orderBy(F.desc("id")).limit(max(1, min(200, limit)))

    def top_history(self, limit: int = 100) -> DataFrame:
        return self.read("history").orderBy(F.desc("last_seen"), "fp").limit(max(1, min(500, limit)))

    def problems(self) -> dict[str, int]:
        """Counts that are 0 in a sound store: findings without a scan, repeated fingerprints in a scan, histories that end before they begin."""
        f, s, h = self.read("findings"), self.read("scans"), self.read("history")
        return {
            "orphans": f.join(s.select(F.col("id").alias("scan_id")), "scan_id", "left_anti").count(),
            "repeated": f.groupBy("scan_id", "fp").count().where("count > 1").count(),
            "backwards": h.where("first_seen > last_seen").count(),
        }
