"""Crawl frontier: which URLs are visited, and in what order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import urls as u

#: What makes a URL worth an early visit.
DISCOVERY = (".js", "api", "graphql", "openapi", "swagger", "sitemap", "robots")


def schedule(candidates: DataFrame, max_depth: int, max_items: int) -> DataFrame:
    """(seq, url, depth, discovery, parameter, rank) of candidates (seq, url, depth): first sight of each canonical URL, by depth, discovery rank, parameter rank and seq.

    Seen URLs fall out by grouping on the canonical form. The cap is a top-n: every task hands on max_items rows at most, and only these are numbered.
    """
    canonical = u.normalize(F.col("url"))
    first = candidates.select("seq", canonical.alias("url"), "depth").where(F.col("depth") <= max_depth).groupBy("url").agg(F.min(F.struct("seq", "depth")).alias("f"))
    low = F.lower("url")
    discovery = F.lit(False)
    for mark in DISCOVERY:
        discovery = discovery | F.contains(low, F.lit(mark))
    ranked = first.select(F.col("f.seq").alias("seq"), "url", F.col("f.depth").alias("depth"), F.when(discovery, 0).otherwise(1).alias("discovery"), F.when(F.instr("url", "?") > 0, 1).otherwise(0).alias("parameter"))
    order = ("depth", "discovery", "parameter", "seq")
    top = ranked.orderBy(*order).limit(max_items)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def not_seen(candidates: DataFrame, seen: DataFrame) -> DataFrame:
    """candidates (url, ...) whose canonical form isn't in seen (url)."""
    return candidates.withColumn("_c", u.normalize(F.col("url"))).join(seen.select(u.normalize(F.col("url")).alias("_c")).distinct(), "_c", "left_anti").drop("_c")


def expand(links: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """(url, depth) of what seeds (url) reach in links (source, target), breadth first; each level is an anti-join against what is known."""
    known = seeds.select("url").distinct().withColumn("depth", F.lit(0))
    level = known
    for depth in range(1, max_depth + 1):
        level = level.join(links, F.col("url") == F.col("source")).select(F.col("target").alias("url")).distinct().join(known.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        if level.isEmpty():
            break
        known = known.unionByName(level)
    return known
