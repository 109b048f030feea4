"""Connected components by alternating large-star and small-star steps, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


#: Tasks that the neighbours of one node are dealt to.
SALTS = 16


def _salt(b: str) -> Column:
    return F.pmod(F.xxhash64(b), F.lit(SALTS)).cast("int")


def _with_least(pairs: DataFrame, least: DataFrame) -> DataFrame:
    """pairs (a, b) with m of least (a, m, salts): the pairs of a hub go to SALTS tasks, each of which gets the hub's least node.

    A node has a row for each salt of its pairs, so there are no more rows than pairs. Both sides are shuffled whatever Spark takes
    their size for: it estimates an exploded row as one row, and would gather and broadcast many times what its limit says.
    """
    salt = F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.getbit("salts", i) == 1))
    return pairs.withColumn("s", _salt("b")).join(least.select("a", "m", salt.alias("s")).hint("merge"), ["a", "s"]).drop("s")


def _pull(pairs: DataFrame) -> DataFrame:
    """For each node a of (a, b): m, the least of a and its b, and salts, a bit for each salt that its b have."""
    salts = F.bit_or(F.call_function("shiftleft", F.lit(1), _salt("b")))
    return pairs.groupBy("a").agg(F.min("b").alias("m"), salts.alias("salts")).select("a", F.least("a", "m").alias("m"), "salts")


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for every node of an edge; component is the least node that it reaches.

    Each round hangs all larger neighbours of a node on its least neighbour (large star), then
    all smaller ones (small star), until nothing moves. Minima are taken with map-side partial
    aggregation, and the join that hands them out deals a hub's rows to several tasks. Every
    round is written to the shared folder, so that lineage stays short. Nulls and loops are left
    out; no edge gives an empty result.
    """
    now = materialize(
        edges.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).where("a is not null and b is not null and a <> b").distinct(), "cc"
    )
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both, _pull(both)).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # every row of large has b < a, as the small star needs
        low = _pull(large)
        small = _with_least(large, low).select(F.col("b").alias("x"), "m").where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b"))
        after = materialize(small.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "cc")
        mark = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        discard(now)
        now = after
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
