"""Technologies against advisories by product and version range, and findings against observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = r"^v?[0-9]+(\.[0-9]+)*$"


def product_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", "")


def version_key(version: Column) -> Column:
    """Numbers of a version without trailing zeros, which compare as zero-padded ones do; null if it is no version."""
    v = F.trim(version)
    bare = F.regexp_replace(F.regexp_replace(v, "^v", ""), r"(\.0+)+$", "")
    return F.when(v.rlike(VERSION), F.when(bare.rlike("^0+$"), F.array().cast("array<long>")).otherwise(F.transform(F.split(bare, r"\."), lambda x: x.cast("long"))))


def _said(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def version_matches(version: Column, exact: Column, start_in: Column, start_ex: Column, end_in: Column, end_ex: Column, keys: Sequence[Column] = ()) -> Column:
    """Without bounds the version is the exact one; with bounds it lies within all of them. What is no version lies in no range.

    keys: the version_key() of the version and of each bound, where they are at hand.
    """
    named = ~F.coalesce(F.trim(exact), F.lit("")).isin("", "*", "-", "NA")
    same = F.trim(version) == F.trim(exact)
    bounds = (start_in, start_ex, end_in, end_ex)
    bounded = _said(start_in) | _said(start_ex) | _said(end_in) | _said(end_ex)
    v, *of = keys or [version_key(c) for c in (version, *bounds)]
    ranges = v.isNotNull() & (~named | same)
    for bound, b, ok in zip(bounds, of, (v >= of[0], v > of[1], v <= of[2], v < of[3]), strict=True):
        ranges = ranges & (~_said(bound) | (b.isNotNull() & F.coalesce(ok, F.lit(False))))
    return F.coalesce(F.when(bounded, ranges).otherwise(named & same), F.lit(False))


#: What an advisory says of versions; equal ones are judged once.
_SPEC = ("_exact", "_start_in", "_start_ex", "_end_in", "_end_ex")


def _hits(asked: DataFrame, specs: DataFrame, n: int, salts: int = 8) -> DataFrame:
    """(_k, _tv, *_SPEC) of the different versions (_k, _tv) of products and the different specs of their advisories that match.

    A spec that names a version meets that version alone, the others all versions of their product, which are copied over salts.
    Versions are parsed once each, not once for each pair.
    """
    bounds = [F.col(c) for c in _SPEC[1:]]
    asked = asked.withColumn("_v", version_key(F.col("_tv")))
    specs = specs.withColumns({f"_v{c}": version_key(F.col(c)) for c in _SPEC[1:]})
    matches = version_matches(F.col("_tv"), F.col("_exact"), *bounds, keys=[F.col("_v"), *[F.col(f"_v{c}") for c in _SPEC[1:]]])
    named = asked.join(specs.where("_exact <> ''").withColumn("_tv", F.col("_exact")), ["_k", "_tv"])
    open_ = specs.where((F.col("_exact") == "") & (F.concat(*bounds) != "")).withColumn("_salt", F.pmod(F.xxhash64(*_SPEC), F.lit(salts)))
    copies = asked.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    ranged = copies.repartition(n, "_k", "_salt").join(open_.repartition(n, "_k", "_salt"), ["_k", "_salt"])
    return named.where(matches).select("_k", "_tv", *_SPEC).unionByName(ranged.where(matches).select("_k", "_tv", *_SPEC))


def correlate(technologies: DataFrame, advisories: DataFrame, confident: bool = True) -> DataFrame:
    """Technologies (name, version, confidence, ...) that advisories (cve, product, version, bounds, vulnerable, context_required) speak of.

    The different versions of a product are held against the different specs of its advisories; the rows of both meet on what matched, so the work
    beyond that grows with the result. With confident, only certain technologies and advisories that need no context take part.
    """
    n = max(2, int(technologies.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tech = technologies.where("name <> '' and version <> ''").withColumn("_k", product_key(F.col("name"))).withColumn("_tv", F.trim("version")).withColumnRenamed("version", "tech_version")
    exact = F.trim("version")
    said = {"_k": product_key(F.col("product")), "_exact": F.when(exact.isin("*", "-", "NA"), "").otherwise(F.coalesce(exact, F.lit("")))}
    adv = advisories.where("vulnerable and cve is not null and cve <> ''").withColumns(said | {c: F.coalesce(F.col(c[1:]), F.lit("")) for c in _SPEC[1:]})
    if confident:
        tech = tech.where(F.col("confidence").isin("HIGH", "MEDIUM"))
        adv = adv.where("not context_required")
    hits = _hits(tech.select("_k", "_tv").distinct(), adv.select("_k", *_SPEC).distinct(), n)
    known = hits.join(adv, ["_k", *_SPEC]).drop(*_SPEC)
    # dealt by number: the result is far larger than its sides, by whose size Spark would put them into a few tasks
    return tech.repartition(n, "_k", "_tv").join(known.repartition(n, "_k", "_tv"), ["_k", "_tv"]).drop("_k", "_tv")


def with_observation(findings: DataFrame, observations: DataFrame) -> DataFrame:
    """findings (url, request_sha256, ...) with the observation (obs_id, url, request_sha256) of the same URL, or else of the same request."""
    by_url = observations.groupBy("url").agg(F.min("obs_id").alias("_o1"))
    by_request = observations.groupBy("request_sha256").agg(F.min("obs_id").alias("_o2"))
    return findings.join(by_url, "url", "left").join(by_request, "request_sha256", "left").withColumn("obs_id", F.coalesce("_o1", "_o2")).drop("_o1", "_o2")
