import os

import pytest
from pyspark.sql import functions as F
from skeinlake.operators.migrations import MIGRATIONS, Migration, MigrationError, migrate
from skeinlake.operators.store import Store


def _findings(spark):
    return spark.sql("SELECT 1L AS scan_id, concat('f', id % 3) AS fp, id AS ordinal, timestamp_seconds(id * 60) AS seen_at, 'LOW' AS severity, CASE WHEN id = 2 THEN 'x' END AS evidence FROM range(7)")


def test_steps_are_applied_once_and_in_order(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/db")
    assert migrate(store, MIGRATIONS[:1]) == 1
    assert store.read("findings").count() == 0 and store.read("history") is None
    store.write("findings", store.read("findings").unionByName(_findings(spark), allowMissingColumns=True))
    assert migrate(store, tuple(reversed(MIGRATIONS))) == 2
    assert migrate(store) == 0
    assert list(store.applied()) == ["001", "003", "004"] or sorted(store.applied()) == ["001", "003", "004"]
    rows = store.read("findings").orderBy("ordinal").collect()
    assert len(rows) == 7 and {(r["stage"], r["confidence_score"], r["evidence_metadata"], r["source"]) for r in rows} == {("POSSIBLE", 0, "{}", "")} and rows[2]["evidence"] == "x"
    assert {r["fp"]: r["occurrences"] for r in store.read("history").collect()} == {"f0": 3, "f1": 2, "f2": 2}
    # the store goes on from there
    store.write("findings", store.read("findings").where("ordinal < 3"))
    assert store.read("findings").count() == 3 and store.problems()["orphans"] == 3


def test_a_failed_step_leaves_all_tables_as_they_were(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/db")
    store.write("findings", _findings(spark))
    store.write("scans", spark.sql("SELECT 1L AS id"))

    def bad(s):
        # the first table is written whole, the second fails while it is written
        return {"scans": s.read("scans").withColumn("risk", F.lit(0.0)), "findings": s.read("findings").withColumn("n", F.when(F.col("ordinal") == 5, F.raise_error(F.lit("broken")).cast("int")).otherwise(1))}

    good = Migration("001", lambda s: {"scans": s.read("scans").withColumn("status", F.lit("done"))})
    with pytest.raises(MigrationError, match="002.*broken"):
        migrate(store, (good, Migration("002", bad)))
    assert sorted(store.applied()) == ["001"]
    assert store.read("scans").columns == ["id", "status"] and store.read("findings").columns == _findings(spark).columns
    assert any(v.endswith(".002") for v in os.listdir(f"{tmp_path}/db/scans"))
    # a write in between, and a mended step that leaves scans alone: nothing of the first attempt comes back
    store.write("scans", store.read("scans"))
    assert migrate(store, (good, Migration("002", lambda s: {"findings": s.read("findings").withColumn("n", F.lit(1))}))) == 1
    assert store.read("scans").columns == ["id", "status"] and store.read("findings").where("n = 1").count() == 7
    assert not any(v.endswith(".002") for v in os.listdir(f"{tmp_path}/db/scans"))


def test_steps_only_add(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/db")
    store.write("findings", _findings(spark))
    for change in (lambda rows: rows.drop("severity"), lambda rows: rows.withColumn("ordinal", F.col("ordinal").cast("string"))):
        with pytest.raises(MigrationError, match="columns of findings"):
            migrate(store, (Migration("001", lambda s, c=change: {"findings": c(s.read("findings"))}),))
    with pytest.raises(MigrationError, match="may not write"):
        migrate(store, (Migration("001", lambda s: {"schema_migrations": _findings(spark)}),))
    with pytest.raises(MigrationError, match="two migrations"):
        migrate(store, (Migration("1", lambda s: {}), Migration("001", lambda s: {})))
    assert store.applied() == {} and migrate(store, (Migration("001", lambda s: {}),)) == 1 and migrate(store, (Migration("001", lambda s: {}),)) == 0


def test_a_lost_job_is_written_over(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/db")
    store.write("scans", spark.sql("SELECT 1L AS id"))
    store.write("scans", spark.sql("SELECT 2L AS id"))
    os.unlink(f"{tmp_path}/db/scans/v00000002/_SUCCESS")
    assert [r["id"] for r in store.read("scans").collect()] == [1]
    store.write("scans", spark.sql("SELECT 3L AS id"))
    assert [r["id"] for r in store.read("scans").collect()] == [3]
