import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_against_their_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [" ".join(re.findall(r"\w+", r["text"].lower())) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns = docs.columns
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "PII", "best-fit packing"]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), "stage")
        if name == "best-fit packing":
            assert {r["doc_id"] for r in docs.collect()} == set(before)
            break
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(after) <= set(before)
        gone = set(before) - set(after)
        if name == "quality classifier":
            assert all(labels.get(i) != 1 for i in gone)
            assert sum(labels.get(i) == 0 for i in after) <= 2
        if name == "n-gram Jaccard join":
            assert len(set(after.values())) == len(after) or len({" ".join(re.split(r"[\x20\x09-\x0D]+", (t or "").lower())) for t in after.values() if t}) == sum(bool(t) for t in after.values())
        if name == "benchmark decontamination":
            holds = {i for i, t in before.items() if any(f" {x} " in f" {' '.join(re.findall(chr(92) + 'w+', (t or '').lower()))} " for x in items)}
            assert holds == gone
        if name == "PII":
            assert not gone and not any(re.search(r"@mail\d", t or "") for t in after.values())
        before = after
