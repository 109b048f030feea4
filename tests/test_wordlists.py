"""Word lists: order, duplicates, ids, and what a lost or repeated import leaves."""

import glob
import hashlib
import os
import random

import pytest

from skeinlake.operators import wordlists
from skeinlake.operators.store import Store

KNOWN = ("names", "passwords")
TEXT = "﻿admin\r\n root \n\nadmin\n\r\nRoot\n root\nÿ\x85ü ü\nlone\rpair\x0bnext\n\tx\nadmin"


def wanted(text):
    return list(dict.fromkeys(v for v in text.removeprefix("\ufeff").splitlines() if v))


def tree(values, chunk):
    lines = values
    while True:
        lines = [hashlib.sha256(("\n".join(lines[i : i + chunk]) + "\n").encode()).hexdigest() for i in range(0, len(lines), chunk)]
        if len(lines) == 1:
            return lines[0]


def held(rows):
    return [r.value for r in rows.orderBy("ordinal").collect()]


def test_file(spark, tmp_path):
    source = tmp_path / "my list.txt"
    source.write_bytes(TEXT.encode())
    store = Store(spark, f"{tmp_path}/lists")
    found = wordlists.add_file(store, str(source), "custom:Extra", KNOWN)
    sha = hashlib.sha256(("\n".join(wanted(TEXT)) + "\n").encode()).hexdigest()
    assert found == {"id": f"custom_extra_{sha[:16]}", "category": "custom:extra", "label": "my_list.txt", "sha256": sha, "entries": len(wanted(TEXT)), "path": f"custom_extra/{sha}"}
    rows = wordlists.read(store, found["id"])
    assert held(rows) == wanted(TEXT)
    assert sorted(r.ordinal for r in rows.collect()) == list(range(len(wanted(TEXT))))
    before = {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{tmp_path}/lists/custom_extra/*/part-*")}
    assert wordlists.add_file(store, str(source), "custom:Extra", KNOWN) == found
    assert {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{tmp_path}/lists/custom_extra/*/part-*")} == before
    assert store.read("wordlists").count() == 1


def test_any_partitioning(spark):
    draw = random.Random(1)
    values = ["hot" if draw.random() < 0.3 else f"w{draw.randrange(900)}" for _ in range(3000)]
    unique = list(dict.fromkeys(values))
    rows = [(i, v) for i, v in enumerate(values)]
    draw.shuffle(rows)
    made = spark.createDataFrame(rows, "line long, value string")
    for n in (1, 7):
        got = wordlists.entries(made.repartition(n), ["line"])
        assert held(got) == unique
        for chunk in (4, 50, 5000):
            assert wordlists.digest(got.repartition(n + 1), chunk) == tree(unique, chunk)


def test_refused(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/lists")
    lines = spark.createDataFrame([(1, "a"), (2, "b"), (3, ""), (4, None), (5, "\r")], "line long, value string")
    for kept, category, most in ((lines.where("line > 2"), "names", None), (lines, "other", None), (lines, "names", 1)):
        with pytest.raises(wordlists.WordlistError):
            wordlists.add(store, kept, ["line"], category, "x", KNOWN, most)
    (tmp_path / "bad").write_bytes(b"ok\n\xff\xfe\n")
    with pytest.raises(wordlists.WordlistError):
        wordlists.add_file(store, str(tmp_path / "bad"), "names", KNOWN)
    assert store.read("wordlists") is None
    with pytest.raises(wordlists.WordlistError):
        wordlists.read(store, "names_0")


def test_lost_and_altered(spark, tmp_path):
    """A list that a lost job left unmarked is written anew; one that was altered is not given out."""
    store = Store(spark, f"{tmp_path}/lists")
    lines = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "line long, value string")
    found = wordlists.add(store, lines, ["line"], "names", "x", KNOWN, 2)
    folder = f"{tmp_path}/lists/{found['path']}"
    os.remove(f"{folder}/_SUCCESS")
    for p in glob.glob(f"{folder}/part-*"):
        os.remove(p)
    assert wordlists.add(store, lines, ["line"], "names", "x", KNOWN) == found
    assert held(wordlists.read(store, found["id"])) == ["a", "b"]
    spark.createDataFrame([(0, "a"), (1, "c")], "ordinal long, value string").write.mode("overwrite").parquet(folder)
    with pytest.raises(wordlists.WordlistError):
        wordlists.read(store, found["id"])
