"""Technologies against advisories: the pairs of a plain join, without the plain join's work."""

import threading

import pytest
from pyspark.sql import functions as F

from skeinlake.operators import correlate

VERSIONS = ["1.2", " 1.2 ", "1.10.0", "v2", "junk", "", None, "0.0", "NA", "2.0.0"]
EXACT = ["*", "1.2", " 1.2", "NA", "", None, "2.0.0", "junk", "-"]
BOUNDS = [(None,) * 4, ("1", None, None, None), ("", "", "", ""), (None, "1.2", None, "2"), ("x", None, None, None), (None, None, "1.10", None), (" 0.0 ", None, "2", ""), (" ", None, None, None)]
ADVISORY = "cve string, product string, version string, start_in string, start_ex string, end_in string, end_ex string, vulnerable boolean, context_required boolean"


@pytest.fixture
def in_time(spark):
    """Cancels jobs that take too long, so that they fail."""
    timer = threading.Timer(90, spark.sparkContext.cancelAllJobs)
    timer.start()
    yield
    timer.cancel()


def test_pairs_are_those_of_a_plain_join(spark):
    tech = [(i, n, v, ("HIGH", "LOW", None)[i % 3]) for i, (n, v) in enumerate((n, v) for n in ("Http d", "HTTPD", "", None, "--") for v in VERSIONS)]
    adv = [(f"CVE-{i}" if i % 11 else None, p, e, *b, (True, True, False, None)[i % 4], (False, True, None)[i % 3]) for i, (p, e, b) in enumerate((p, e, b) for p in ("http-d", "httpd", None) for e in EXACT for b in BOUNDS)]
    t = spark.createDataFrame(tech + tech[:4], "id long, name string, version string, confidence string")
    a = spark.createDataFrame(adv + adv[1:3], ADVISORY)
    for confident in (False, True):
        x, y = t.where("name <> '' and version <> ''"), a.where("vulnerable and cve is not null and cve <> ''")
        if confident:
            x, y = x.where("confidence in ('HIGH', 'MEDIUM')"), y.where("not context_required")
        plain = x.withColumnRenamed("version", "tech_version").crossJoin(y).where(correlate.product_key(F.col("name")) == correlate.product_key(F.col("product")))
        plain = plain.where(correlate.version_matches(*[F.col(c) for c in ("tech_version", "version", "start_in", "start_ex", "end_in", "end_ex")]))
        got = correlate.correlate(t, a, confident)
        assert got.columns == plain.columns
        wanted = sorted(map(str, plain.collect()))
        assert wanted and sorted(map(str, got.collect())) == wanted


def _many(spark):
    """80 000 rows of 7 versions, and 40 000 advisories of 4 specs, for one product; only a few of them match."""
    tech = spark.range(80_000).select("id", F.lit("Httpd").alias("name"), F.concat(F.lit("1."), (F.col("id") % 7).cast("string")).alias("version"), F.lit("HIGH").alias("confidence"))
    k, none = F.col("id"), F.lit(None).cast("string")
    adv = spark.range(40_000).select(F.concat(F.lit("CVE-"), k.cast("string")).alias("cve"), F.lit("httpd").alias("product"), F.lit("*").alias("version"), F.concat(F.lit("2."), (k % 3).cast("string")).alias("start_in"), none.alias("start_ex"), none.alias("end_in"), none.alias("end_ex"), F.lit(True).alias("vulnerable"), F.lit(False).alias("context_required"))
    one = spark.createDataFrame([("CVE-x", "httpd", "*", "1.6", None, None, None, True, False)], ADVISORY)
    return tech, adv.unionByName(one)


def test_many_rows_of_one_product(spark, in_time):
    assert correlate.correlate(*_many(spark), confident=False).count() == 80_000 // 7


def test_many_confident_rows_of_one_product(spark, in_time):
    tech, adv = _many(spark)
    found = correlate.correlate(tech.withColumn("confidence", F.when(F.col("id") % 2 == 0, "LOW").otherwise("MEDIUM")), adv)
    assert found.count() == len([i for i in range(80_000) if i % 7 == 6 and i % 2])
