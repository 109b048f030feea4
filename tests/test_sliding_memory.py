"""The sliding SimHash memory, in batch and as a stream, against a deque."""

import random
from collections import deque

import pytest

from skeinlake.operators import dedupe
from skeinlake.streaming import memory


def brute(rows, distance, size):
    """rows (key, seq, hash) in order."""
    held, out = {}, []
    for key, seq, h in rows:
        past = held.setdefault(key, deque(maxlen=size))
        out.append((key, seq, h is not None and any(o is not None and (o ^ h).bit_count() <= distance for o in past)))
        past.append(h)
    return sorted(out)


def unsigned(h):
    return None if h is None else h & (2**64 - 1)


def made(n, seed):
    draw = random.Random(seed)
    base = [draw.getrandbits(64) - 2**63 for _ in range(n // 3)] + [-1, 0]
    rows = []
    for i in range(n):
        h = base[0] if draw.random() < 0.2 else draw.choice(base)
        for _ in range(draw.choice([0, 0, 1, 3, 4])):
            h = unsigned(h) ^ (1 << draw.randrange(64))
            h = h - 2**64 if h >= 2**63 else h
        rows.append((f"c{draw.choice([0, 0, 0, 1])}", i, None if draw.random() < 0.02 else h))
    return rows


@pytest.mark.parametrize("size", [5, 40, 1000])
@pytest.mark.parametrize("distance", [0, 3])
def test_batch(spark, size, distance):
    rows = made(400, size)
    df = spark.createDataFrame(rows, "crawl string, n long, h long")
    whole = brute([(0, n, unsigned(h)) for _, n, h in rows], distance, size)
    assert sorted((0, r.seq, r.duplicate) for r in dedupe.sliding_duplicates(df, "n", "h", distance, size).collect()) == whole
    by_crawl = brute([(c, n, unsigned(h)) for c, n, h in rows], distance, size)
    assert sorted((r.crawl, r.seq, r.duplicate) for r in dedupe.sliding_duplicates(df, "n", "h", distance, size, ["crawl"]).collect()) == by_crawl


def test_duplicates_are_remembered_too(spark):
    """The third copy is near the second alone, which was a duplicate itself."""
    rows = [(0, 7), (1, 7), (2, 7)]
    df = spark.createDataFrame(rows, "n long, h long")
    assert [r.duplicate for r in dedupe.sliding_duplicates(df, "n", "h", 3, 1).orderBy("seq").collect()] == [False, True, True]


def test_stream_agrees_with_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(memory, "PIECE", 16)
    rows = made(300, 9)
    before = {k: spark.conf.get(k, None) for k in memory.STORE}
    for k, v in memory.STORE.items():
        spark.conf.set(k, v)
    try:
        for i in range(0, 300, 100):  # each part by a query that starts anew from the checkpoint
            spark.createDataFrame(rows[i : i + 100], "crawl string, n long, h long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = memory.sliding_duplicates(spark.readStream.schema("crawl string, n long, h long").parquet(f"{tmp_path}/in"), "crawl", "n", "h", 3, 40)
            stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    got = sorted((r.crawl, r.seq, r.duplicate) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == brute([(c, n, unsigned(h)) for c, n, h in rows], 3, 40)
    batch = dedupe.sliding_duplicates(spark.createDataFrame(rows, "crawl string, n long, h long"), "n", "h", 3, 40, ["crawl"])
    assert got == sorted((r.crawl, r.seq, r.duplicate) for r in batch.collect())


def test_numbers_of_many_rows(spark):
    """More rows than Spark samples for its ranges, and columns that the counts don't need."""
    from pyspark.sql import functions as F

    from skeinlake.operators.store import number

    rows = spark.range(40_000).select((F.xxhash64("id") % 100_000).alias("k"), F.col("id").cast("string").alias("pad"), F.lit("x").alias("more"))
    got = number(rows, "k", 10).select("id", "k").orderBy("id").collect()
    assert [r.id for r in got] == list(range(11, 40_011))
    assert [r.k for r in got] == sorted(r.k for r in got)


def test_blocks_cut_across_batches_and_candidates(spark, monkeypatch):
    """Null keys, few rows at a time and few pairs at a time give the same marks."""
    import pyarrow as pa

    monkeypatch.setattr(dedupe, "TOGETHER", 3)
    monkeypatch.setattr(dedupe, "PAIRS", 2)
    rows = sorted(((None if c == "c1" else c), n, h) for c, n, h in made(120, 4) if c == "c0") + [("d", 500 + i, 7) for i in range(9)]
    size, dealt = 8, []
    for i, (c, n, h) in enumerate(rows):
        dealt.append((c, n, h, i, i // size, True))
        if h is not None:
            dealt.append((c, n, h, i, i // size + 1, False))
    dealt.sort(key=lambda r: (r[4], r[3]))
    names = ["_k0", "_seq", "_h", "_place", "_block", "_own"]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in dealt[i : i + 7]], pa.schema(list(zip(names, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)))) for i in range(0, len(dealt), 7)]
    got = [tuple(r.values()) for b in dedupe._mark_blocks(iter(batches), 1, 3, size) for r in b.to_pylist()]
    assert sorted(got) == brute([(c, n, unsigned(h)) for c, n, h in rows], 3, size)


def test_rows_are_dealt_once_to_two_blocks(spark):
    """What is shuffled beside the numbering are two copies of a row, not one for each pair of bands."""
    df = spark.createDataFrame(made(50, 1), "crawl string, n long, h long")
    plan = dedupe.sliding_duplicates(df, "n", "h", 3, 16, ["crawl"])._jdf.queryExecution().optimizedPlan().toString()
    assert "band" not in plan and plan.count("Generate explode") == 1
