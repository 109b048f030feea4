"""Readers of the base tables, and the web-observation tables that are derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, url"""
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), "url")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, href: the anchors of pages"""
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


def findings(spark: SparkSession, sf_dir: str, targets: int = 4000) -> DataFrame:
    """ordinal, target, id, severity, parameter, url, seen_at, scan_id from the event stream"""
    e = table(spark, sf_dir, "events")
    severity = F.when(F.col("event_type") == "error", "HIGH").when(F.col("event_type") == "purchase", "CRITICAL").when(F.col("event_type") == "signup", "MEDIUM").when(F.col("event_type") == "click", "LOW").otherwise("INFO")
    return e.select(
        F.col("event_id").alias("ordinal"), (F.col("event_id") % targets).alias("target"), F.col("event_type").alias("id"), severity.alias("severity"), F.get_json_object("props", "$.k").alias("parameter"),
        F.concat(F.lit("https://t"), (F.col("user_id") % 50).cast("string"), F.lit(".example/")).alias("url"), F.col("ts").alias("seen_at"), F.dayofmonth("ts").alias("scan_id"),
    )


FINDINGS_SQL = """(SELECT event_id AS ordinal, event_id % {targets} AS target, event_type AS id,
 CASE event_type WHEN 'error' THEN 'HIGH' WHEN 'purchase' THEN 'CRITICAL' WHEN 'signup' THEN 'MEDIUM' WHEN 'click' THEN 'LOW' ELSE 'INFO' END AS severity,
 json_extract_string(props, '$.k') AS parameter, 'https://t' || CAST(user_id % 50 AS VARCHAR) || '.example/' AS url, ts AS seen_at, day(ts) AS scan_id FROM events)"""


def findings_sql(targets: int = 4000) -> str:
    return FINDINGS_SQL.format(targets=targets)


def technologies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part_id, name, version, confidence"""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("part_id"), F.col("p_brand").alias("name"), F.concat_ws(".", (F.col("p_size") % 4).cast("string"), (F.col("p_partkey") % 10).cast("string"), (F.col("p_size") % 7).cast("string")).alias("version"),
        F.when(F.col("p_partkey") % 3 == 0, "HIGH").when(F.col("p_partkey") % 3 == 1, "MEDIUM").otherwise("LOW").alias("confidence"),
    )


TECHNOLOGIES_SQL = """(SELECT p_partkey AS part_id, p_brand AS name, concat_ws('.', CAST(p_size % 4 AS VARCHAR), CAST(p_partkey % 10 AS VARCHAR), CAST(p_size % 7 AS VARCHAR)) AS version,
 CASE p_partkey % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM part)"""


def advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cve, product, version, four bounds, vulnerable, context_required, severity"""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    v = lambda a, b: F.concat_ws(".", (k % a).cast("string"), (k % b).cast("string"))
    return s.select(
        F.concat(F.lit("CVE-2024-"), k.cast("string")).alias("cve"), F.concat(F.lit("Brand#"), (10 + 10 * (k % 5) + 1 + k % 5 - 9 + k % 4).cast("string")).alias("raw"), F.concat(F.lit("brand "), (11 + 10 * (k % 5) + F.floor(k / 5) % 5).cast("string")).alias("product"),
        F.when(k % 7 == 0, F.concat_ws(".", (k % 4).cast("string"), (k % 10).cast("string"), (k % 7).cast("string"))).otherwise("*").alias("version"),
        F.when(k % 7 == 0, None).when(k % 2 == 0, v(3, 10)).alias("start_in"), F.when(k % 7 == 0, None).when((k % 2 == 1) & (k % 3 == 0), v(2, 8)).alias("start_ex"),
        F.when(k % 7 == 0, None).when(k % 3 == 1, v(4, 9)).alias("end_in"), F.when(k % 7 == 0, None).when(k % 3 != 1, F.concat((k % 4).cast("string"), F.lit(".7.0"))).alias("end_ex"),
        (k % 11 != 0).alias("vulnerable"), (k % 13 == 0).alias("context_required"), F.when(k % 2 == 0, "HIGH").otherwise("LOW").alias("severity"),
    ).drop("raw")


ADVISORIES_SQL = """(SELECT 'CVE-2024-' || CAST(k AS VARCHAR) AS cve, 'brand ' || CAST(11 + 10 * (k % 5) + (k // 5) % 5 AS VARCHAR) AS product,
 CASE WHEN k % 7 = 0 THEN concat_ws('.', CAST(k % 4 AS VARCHAR), CAST(k % 10 AS VARCHAR), CAST(k % 7 AS VARCHAR)) ELSE '*' END AS version,
 CASE WHEN k % 7 = 0 THEN NULL WHEN k % 2 = 0 THEN concat_ws('.', CAST(k % 3 AS VARCHAR), CAST(k % 10 AS VARCHAR)) END AS start_in,
 CASE WHEN k % 7 = 0 THEN NULL WHEN k % 2 = 1 AND k % 3 = 0 THEN concat_ws('.', CAST(k % 2 AS VARCHAR), CAST(k % 8 AS VARCHAR)) END AS start_ex,
 CASE WHEN k % 7 = 0 THEN NULL WHEN k % 3 = 1 THEN concat_ws('.', CAST(k % 4 AS VARCHAR), CAST(k % 9 AS VARCHAR)) END AS end_in,
 CASE WHEN k % 7 = 0 THEN NULL WHEN k % 3 <> 1 THEN CAST(k % 4 AS VARCHAR) || '.7.0' END AS end_ex,
 k % 11 <> 0 AS vulnerable, k % 13 = 0 AS context_required, CASE WHEN k % 2 = 0 THEN 'HIGH' ELSE 'LOW' END AS severity FROM (SELECT s_suppkey AS k FROM supplier))"""
