"""A log's tail through appends, truncation, renames and restarts."""

import os

import pytest

from skeinlake.sources import tail


@pytest.fixture
def log(tmp_path):
    return str(tmp_path / "log" / "events.jsonl")


class Run:
    """Starts the same query anew for each look, on one checkpoint."""

    def __init__(self, spark, log, folder, **options):
        os.makedirs(os.path.dirname(log), exist_ok=True)
        self.spark, self.log, self.folder, self.options = spark, log, folder, options

    def look(self):
        q = tail.tail(self.spark, self.log, **self.options).writeStream.format("parquet").option("path", f"{self.folder}/out").option("checkpointLocation", f"{self.folder}/state").trigger(once=True).start()
        q.awaitTermination()
        return sorted(r.value for r in self.spark.read.schema("value string").parquet(f"{self.folder}/out").collect())


def append(path, text):
    with open(path, "a") as f:
        f.write(text)


def lines(lo, hi):
    return [f"{i:05d} " + "é" * (i % 40) for i in range(lo, hi)]


def joined(held):
    return "".join(x + "\n" for x in held)


def test_appends_renames_and_truncation_across_restarts(spark, log, tmp_path):
    run = Run(spark, log, tmp_path, chunkBytes="300")
    append(log, joined(lines(0, 200)) + "cut")
    assert run.look() == lines(0, 200)
    append(log, " off\n" + joined(lines(200, 230)))
    wanted = sorted([*lines(0, 230), "cut off"])
    assert run.look() == wanted
    # rotated twice between two looks, with lines that nobody has read in each
    append(log, joined(lines(230, 250)))
    os.rename(log, log + ".1")
    append(log, joined(lines(250, 260)))
    os.utime(log + ".1", ns=(1, 10**18))
    os.rename(log + ".1", log + ".2")
    os.rename(log, log + ".1")
    append(log, joined(lines(260, 300)) + "open")
    wanted = sorted([*wanted, *lines(230, 300)])
    assert run.look() == wanted
    # truncated in place and written anew
    with open(log, "w") as f:
        f.write(joined(["new 1", "new 2"]))
    wanted = sorted([*wanted, "new 1", "new 2"])
    assert run.look() == wanted
    assert run.look() == wanted


def test_a_batch_that_failed_is_read_again_after_a_rename(spark, log, tmp_path):
    """The batch is planned, its writer fails, the log is rotated, and the restarted query has each line once."""
    run = Run(spark, log, tmp_path)
    append(log, joined(lines(0, 50)))

    def fail(batch, n):
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        tail.tail(spark, log).writeStream.foreachBatch(fail).option("checkpointLocation", f"{tmp_path}/each").trigger(once=True).start().awaitTermination()
    os.rename(log, log + ".1")
    append(log, joined(lines(50, 60)))
    got = []
    for _ in range(2):
        tail.tail(spark, log).writeStream.foreachBatch(lambda batch, n: got.extend((n, r.value) for r in batch.collect())).option("checkpointLocation", f"{tmp_path}/each").trigger(once=True).start().awaitTermination()
    assert sorted(v for _, v in got) == lines(0, 60)
    assert {n for n, v in got if v in lines(0, 50)} == {0}


def test_reader_without_spark(log):
    os.makedirs(os.path.dirname(log))
    reader = tail.TailReader({"path": log, "chunkBytes": "7"})
    held = lambda a, b: sorted(v for p in reader.partitions(a, b) for batch in reader.read(p) for v in batch.column(0).to_pylist())
    first = reader.initialOffset()
    assert reader.latestOffset() == first and held(first, first) == []
    append(log, "a\n\nbb\r\n" + "c" * 50 + "\n" + "x")
    one = reader.latestOffset()
    assert held(first, one) == ["", "a", "bb", "c" * 50]
    with open(log, "r+") as f:  # as long as before, with another start
        f.write("z\n\nyy\r\n")
    two = reader.latestOffset()
    assert held(one, two) == ["", "c" * 50, "yy", "z"]
    append(log, "more\n")
    three = reader.latestOffset()
    os.remove(log)
    with pytest.raises(ValueError, match="failOnDataLoss"):
        reader.partitions(two, three)
    lenient = tail.TailReader({"path": log, "failOnDataLoss": "false"})
    append(log, "after\n")
    four = lenient.latestOffset()
    if four["inode"] != three["inode"]:
        assert [v for p in lenient.partitions(three, four) for b in lenient.read(p) for v in b.column(0).to_pylist()] == ["after"]
