"""Pages and forms of a stream of captures: each batch once, whatever is lost and comes again."""

import glob
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from skeinlake.streaming import extraction

PAGES = "url string, html string, found string, n long"
ROWS = "schema_version string, url string, n long, n_forms int, found struct<urls:array<string>>"


def page(i):
    forms = "".join(f'<form action="/go/{i}/{j}" method="post"><input name="csrf_token" value="x"><input name="q{j}"></form>' for j in range(i % 3))
    return (f"https://h.example/{i}", f'<a href="/p/{i}">x</a>{forms}', "clash", i)


def feed(spark, folder, rows):
    spark.createDataFrame(rows, PAGES).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def run(spark, folder, checkpoint="state", **options):
    stream = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    extraction.write(stream, f"{folder}/out", f"{folder}/{checkpoint}", **options).trigger(availableNow=True).start().awaitTermination()


def files(folder):
    return {p: hashlib.sha256(open(p, "rb").read()).hexdigest() for p in sorted(glob.glob(f"{folder}/out/*/*/*/part-*"))}


def check(spark, folder, rows):
    pages = extraction.read(spark, f"{folder}/out", "pages", ROWS).collect()
    assert sorted((r.schema_version, r.url, r.n, r.n_forms) for r in pages) == sorted(("1.0", u, i, i % 3) for u, _, _, i in rows)
    assert all(r.found.urls == [f"https://h.example/p/{r.n}"] for r in pages)
    forms = extraction.read(spark, f"{folder}/out", "forms", extraction.FORMS).collect()
    wanted = [("1.0", u, j, f"https://h.example/go/{i}/{j}", "POST", ["csrf_token", f"q{j}"], ["csrf_token"]) for u, _, _, i in rows for j in range(i % 3)]
    assert sorted((r.schema_version, r.url, r.place, r.form.action, r.form.method, [f.name for f in r.form.fields], r.form.csrf_fields) for r in forms) == sorted(wanted)


@pytest.fixture
def written(spark, tmp_path):
    rows = [page(i) for i in range(12)]
    for at in (0, 5):
        feed(spark, tmp_path, rows[at : at + 5])
    run(spark, tmp_path)
    return tmp_path, rows


def last_commit(folder):
    return max(glob.glob(f"{folder}/state/commits/[0-9]*"), key=lambda p: int(os.path.basename(p)))


def forget_commit(folder):
    """As if the query had ended after its outputs and before its own commit."""
    name = last_commit(folder)
    os.remove(name)
    crc = os.path.join(os.path.dirname(name), f".{os.path.basename(name)}.crc")
    if os.path.exists(crc):
        os.remove(crc)


def test_replay_leaves_files(spark, written):
    folder, rows = written
    before = files(folder)
    forget_commit(folder)
    run(spark, folder)
    assert files(folder) == before
    feed(spark, folder, rows[10:])
    run(spark, folder)
    check(spark, folder, rows)


def test_replay_writes_the_output_that_was_lost(spark, written):
    """The job of the second output was lost halfway: its folder has rows, but isn't marked."""
    folder, rows = written
    pages = {p: h for p, h in files(folder).items() if "/pages/" in p}
    [mark] = glob.glob(f"{folder}/out/forms/run=*/batch=1/_SUCCESS")
    os.remove(mark)
    assert extraction.read(spark, f"{folder}/out", "forms", extraction.FORMS).where(F.col("url").endswith("/8")).count() == 0
    forget_commit(folder)
    run(spark, folder)
    assert {p: h for p, h in files(folder).items() if "/pages/" in p} == pages
    check(spark, folder, rows[:10])


def test_append_and_truncate(spark, written):
    folder, rows = written
    run(spark, folder, "second")
    check(spark, folder, rows[:10] * 2)
    run(spark, folder, "third", truncate=True)
    check(spark, folder, rows[:10])


def test_nulls_and_no_pages(spark, tmp_path):
    assert extraction.read(spark, f"{tmp_path}/out", "forms", extraction.FORMS).count() == 0
    feed(spark, tmp_path, [(None, "<form></form>", None, None), ("https://h.example/", None, None, 1), ("https://h.example/e", "", None, 2)])
    run(spark, tmp_path)
    got = extraction.read(spark, f"{tmp_path}/out", "pages", ROWS).collect()
    assert sorted((r.url or "", r.n_forms) for r in got) == [("", 1), ("https://h.example/", 0), ("https://h.example/e", 0)]
    [form] = extraction.read(spark, f"{tmp_path}/out", "forms", extraction.FORMS).collect()
    assert (form.url, form.place, form.form.method) == (None, 0, "GET")
