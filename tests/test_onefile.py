import os

import pytest
from pyspark.sql import functions as F
from skeinlake.sources import onefile


def _rows(spark, n):
    """Lines of different lengths in different alphabets, in no order."""
    k = F.col("id")
    text = F.concat(F.lit("zeile "), (k * 7919 % 1009).cast("string"), F.when(k % 3 == 0, "é漢😀").otherwise(""), F.expr("repeat('x', cast(id % 40 as int))"))
    return spark.range(n).select(((k * 31) % n).alias("seq"), F.when(k % 17 != 0, text).alias("text"), F.lit(1).alias("at"))


def _expected(rows):
    return "".join((r["text"] or "") + "\n" for r in sorted(rows.collect(), key=lambda r: r["seq"])).encode()


def test_lines_stand_in_order_whatever_the_partitions(spark, tmp_path):
    rows = _rows(spark, 4001).cache()
    want = _expected(rows)
    for n in (1, 3, 50):
        path = f"{tmp_path}/{n}/report.txt"
        assert onefile.write(rows.repartition(n), ["seq"], "text", path) == len(want)
        with open(path, "rb") as f:
            assert f.read() == want
        assert os.listdir(f"{tmp_path}/{n}") == ["report.txt"] and os.stat(path).st_mode & 0o777 == 0o600


def test_one_huge_line_equal_keys_and_no_rows(spark, tmp_path):
    rows = spark.createDataFrame([(1, "b" * 3_000_000), (0, "a"), (1, "c"), (None, "first")], "seq long, text string")
    path = f"file://{tmp_path}/a%20b.txt"
    onefile.write(rows, ["seq", "text"], "text", path, end="\r\n")
    with open(f"{tmp_path}/a b.txt", "rb") as f:
        assert f.read() == b"first\r\na\r\n" + b"b" * 3_000_000 + b"\r\nc\r\n"
    assert onefile.write(rows.limit(0), ["seq"], "text", f"{tmp_path}/a b.txt") == 0
    assert os.path.getsize(f"{tmp_path}/a b.txt") == 0
    with pytest.raises(ValueError):
        onefile.write(rows, ["seq"], "text", "s3a://bucket/x")


def test_a_failed_job_leaves_what_was_there(spark, tmp_path):
    path = f"{tmp_path}/log.jsonl"
    onefile.write(_rows(spark, 10), ["seq"], "text", path)
    with open(path, "rb") as f:
        old = f.read()
    broken = _rows(spark, 2000).withColumn("text", F.when(F.col("seq") == 1500, F.raise_error(F.lit("broken"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="broken"):
        onefile.write(broken, ["seq"], "text", path)
    with open(path, "rb") as f:
        assert f.read() == old
    assert os.listdir(tmp_path) == ["log.jsonl"]


def test_abort_of_the_writer_and_bytes_that_are_missing(spark, tmp_path):
    spark.dataSource.register(onefile.OneFile)
    path, part = f"{tmp_path}/x.txt", f"{tmp_path}/.x.part"
    lines = spark.range(1000).repartition(4).select((F.col("id") * 2).alias("at"), F.lit("y\n").alias("text"))

    def save(rows, size):
        open(part, "wb").close()
        rows.write.format("skeinlake-onefile").mode("append").option("path", path).option("part", part).option("size", size).save()

    with pytest.raises(Exception, match="of 2001 bytes"):
        save(lines, 2001)
    assert os.listdir(tmp_path) == []
    with pytest.raises(Exception, match="late"):
        save(lines.withColumn("text", F.when(F.col("at") == 998, F.raise_error(F.lit("late"))).otherwise(F.col("text"))), 2000)
    assert os.listdir(tmp_path) == []
    # a task that comes after the abort makes no file
    with pytest.raises(FileNotFoundError):
        onefile.OneFileWriter({"path": path, "part": part, "size": "2"}).write(iter([]))
    save(lines, 2000)
    with open(path, "rb") as f:
        assert f.read() == b"y\n" * 1000
    # rows that a task writes a second time change nothing
    again = onefile.OneFileWriter({"path": path, "part": path, "size": "2000"})
    import pyarrow as pa

    again.write(iter([pa.RecordBatch.from_pydict({"at": pa.array([4, 6, 0], pa.int64()), "text": ["y\n", "y\n", "y\n"]})]))
    with open(path, "rb") as f:
        assert f.read() == b"y\n" * 1000
