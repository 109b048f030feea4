"""The queries of passive rules against their twins, where bodies disclose something."""

import duckdb

from skeinlake.plans import catalogue

BODIES = [
    "password=cc8dd0fb120df60f0f", "Token : 'abcdefgh'", "token: short", "<TITLE>Index of /</title><a href='../'>../</a>", "<title>index of</title>", "x sourceMappingURL=a\nb.map", "//# sourcemappingurl=a b.map", "DEBUG = 1", "stack trace",
    "<title>phpinfo()</title> PHP Version 8 Loaded Configuration File", "at 10.0.0.1.", "at 10.0.0.256", "at 192.168.1.1", "at 172.15.0.1", "v1.10.0.0.1", "10.1.1.1.2 then 172.31.9.9", "10.0.0.1\n", "é" * 100_000 + "stack trace", "", None, "src='http://a/'",
]


def test_queries_equal_their_twins(spark, tmp_path):
    rows = [(i, ("https" if i % 2 else "http") + f"://h/{i}", b) for i, b in enumerate(BODIES)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    total = 0
    for name in ("rul_01_passive", "rul_01_passive_bodies"):
        got = {r["id"]: r["n"] for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()}
        assert got == dict(con.execute(catalogue.ORACLE_SQL[name]).fetchall())
        total += len(got)
    assert total >= 11
