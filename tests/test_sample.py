"""The mergeable sample."""

from pyspark.sql import functions as F

from skeinlake.operators import metrics


def ids(df):
    return sorted(r.id for r in df.collect())


def test_sample_is_the_same_for_any_partitions_and_merges(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 < 2, "hot").otherwise((F.col("id") % 7).cast("string")).alias("k"))
    whole = metrics.sample(rows, ["k"], "id", 50, "s")
    assert ids(whole) == ids(metrics.sample(rows.repartition(9), ["k"], "id", 50, "s")) == ids(metrics.sample(rows.coalesce(1), ["k"], "id", 50, "s"))
    parts = [metrics.sample(rows.where(c), ["k"], "id", 50, "s") for c in ("id < 1000", "id >= 1000")]
    assert ids(metrics.sample(parts[0].unionByName(parts[1]), ["k"], "id", 50, "s")) == ids(whole)
    counts = {r.k: r["count"] for r in whole.groupBy("k").count().collect()}
    assert set(counts.values()) == {50} and len(counts) == 8
    assert ids(metrics.sample(rows, ["k"], "id", 50, "t")) != ids(whole)
    held = [r.id for r in whole.where("k = 'hot'").collect()]
    assert 800 < sum(held) / len(held) < 2200


def test_bound_is_below_the_shuffle(spark):
    plan = metrics.sample(spark.range(100).withColumn("k", F.col("id") % 3), ["k"], "id", 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_edges(spark):
    rows = spark.createDataFrame([(None, 1), (None, 2), (3, None), (3, 4), (3, 5)], "id long, k long")
    assert metrics.sample(rows, ["k"], "id", 10).count() == 5
    assert metrics.sample(rows.limit(0), ["k"], "id", 10).count() == 0
    assert metrics.sample(rows, [], "id", 2).count() == 2
