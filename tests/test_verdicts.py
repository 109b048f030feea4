"""Verdicts on awkward values."""

import threading

from pyspark.sql import functions as F

from skeinlake.functions import verdicts
from skeinlake.operators import lookups


def test_redirects_need_http(spark):
    wanted = {"https://evil.example/x": True, "HTTP://EVIL.example/x": True, "ftp://evil.example/x": False, "//evil.example/x": False, "https://evil.example/y": False, "https://other/x?evil.example/x": False, None: False}
    rows = spark.createDataFrame([(k,) for k in wanted], "x string").select("x", verdicts.redirects_to(F.col("x"), "evil.example", "/x").alias("v"))
    assert {r.x: r.v for r in rows.collect()} == wanted


def test_banner_rows(spark):
    cached = spark.createDataFrame(
        [(1, "Httpd", "EDB-7", "Httpd 1.0rc leak"), (2, "HTTPD", "CVE-2020-1", "httpd 1.0RC leak"), (3, "httpd", "CVE-2020-2", "httpd 1.0rc again"), (4, "other", "CVE-1", "other"), (5, "nginx", None, "nginx 2"), (6, "named", "CVE-2.5", "named")],
        "row int, product string, id string, text string",
    )
    banners = spark.createDataFrame([(1, "httpd", "1.0Rc"), (2, "nginx", "2"), (3, "named", "2.5"), (4, "httpd", ""), (5, "other", None), (6, "httpd", "9")], "banner int, product string, version string")
    assert {r.banner: r.row for r in lookups.banner_rows(banners, cached).collect()} == {1: 2, 3: 6}


def test_banners_of_few_products(spark):
    """200 000 banners ask for 2 things of 200 000 cached rows; nothing near all pairs is compared."""
    cached = spark.range(200_000).select(F.col("id").alias("row"), F.lit("Httpd").alias("product"), F.lit("CVE-1").alias("id"), F.when(F.col("id") > 190_000, "HTTPD 2.0RC").otherwise("httpd").alias("text"))
    banners = spark.range(200_000).select(F.col("id").alias("banner"), F.lit("httpd").alias("product"), F.concat((F.col("id") % 2 + 1).cast("string"), F.lit(".0rc")).alias("version"))
    timer = threading.Timer(40, spark.sparkContext.cancelAllJobs)
    timer.start()
    got = lookups.banner_rows(banners, cached).agg(F.count("*"), F.min("row"), F.max("row"), F.sum(F.col("banner") % 2)).first()
    timer.cancel()
    assert tuple(got) == (100_000, 190_001, 190_001, 100_000)
