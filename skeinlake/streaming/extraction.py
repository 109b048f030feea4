"""Captured pages as a stream: one extraction, whose pages and forms are two outputs that a replayed batch leaves as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.web import FORM, with_bundle

#: Fixed value: the version that rows of both outputs carry.
SCHEMA_VERSION = "1.0"
KINDS = ("pages", "forms")
FORMS = f"schema_version string, url string, place int, form {FORM}"


def extracted(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """pages with what their HTML holds (found); the HTML itself goes. Null HTML holds nothing; a null URL resolves nothing."""
    return with_bundle(pages, url, html, "found").drop(html)


def page_rows(found: DataFrame) -> DataFrame:
    """A row for each page: its columns, what was found but forms, and their number."""
    return found.withColumn("schema_version", F.lit(SCHEMA_VERSION)).withColumn("n_forms", F.size("found.forms")).withColumn("found", F.col("found").dropFields("forms"))


def form_rows(found: DataFrame, url: str = "url") -> DataFrame:
    """A row for each form of each page, with its place among the page's forms."""
    return found.select(F.lit(SCHEMA_VERSION).alias("schema_version"), F.col(url).alias("url"), F.posexplode("found.forms").alias("place", "form"))


class Outputs:
    """Writes each batch of a query to path/pages and path/forms, in folders named by the query's id and the batch's number.

    A folder counts once Spark's committer has marked it done. A batch that comes again, since the query was ended between an output and its own
    commit, writes only what isn't marked, over what a lost job left; so both outputs hold each batch once. The id is that of the checkpoint: a
    query that starts anew writes beside earlier ones, or, with truncate, instead of them.
    """

    def __init__(self, path: str, url: str = "url", html: str = "html", truncate: bool = False):
        self.path, self.url, self.html, self.truncate = path.rstrip("/"), url, html, truncate

    def folder(self, kind: str, run: str, number: int) -> str:
        return f"{self.path}/{kind}/run={run}/batch={number}"

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        run = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        if self.truncate and number == 0:
            for kind in KINDS:
                for other in _matching(spark, f"{self.path}/{kind}/run=*"):
                    if other.getName() != f"run={run}":
                        other.getFileSystem(spark._jsc.hadoopConfiguration()).delete(other, True)
        left = [k for k in KINDS if not _matching(spark, f"{self.folder(k, run, number)}/_SUCCESS")]
        if not left:
            return
        found = extracted(batch, self.url, self.html)
        # pages are parsed once for both outputs; a lost executor's part is parsed again
        found = found.persist() if len(left) > 1 else found
        try:
            for kind in left:
                rows = page_rows(found) if kind == "pages" else form_rows(found, self.url)
                rows.write.mode("overwrite").option("ignoreNullFields", False).json(self.folder(kind, run, number))
        finally:
            found.unpersist()


def _matching(spark: SparkSession, glob: str) -> list:
    """Paths that a glob pattern finds."""
    path = spark._jvm.org.apache.hadoop.fs.Path(glob)
    return [s.getPath() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []]


def write(pages: DataFrame, path: str, checkpoint: str, url: str = "url", html: str = "html", truncate: bool = False) -> DataStreamWriter:
    """The writer of a stream of pages into both outputs; give it a trigger and start it."""
    return pages.writeStream.foreachBatch(Outputs(path, url, html, truncate)).option("checkpointLocation", checkpoint)


def read(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """The rows of an output's finished batches; none where there is no batch yet."""
    done = [p.getParent().toString() for p in _matching(spark, f"{path.rstrip('/')}/{kind}/run=*/batch=*/_SUCCESS")]
    return spark.read.schema(schema).json(done) if done else spark.createDataFrame([], schema)
