import random
import re
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from skeinlake.llm import components, ngram_join, packing
from skeinlake.llm.components import connected_components

DOCS = "doc_id long, text string, extra string, set_id string"


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def brute_components(rows, n, num, den):
    def shingles(text):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
        return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                o = len(sets[i] & sets[j])
                if den * o >= num * (len(sets[i]) + len(sets[j]) - o):
                    parent[max(root(i), root(j))] = min(root(i), root(j))
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def near_copies(seed, n_docs=120, words=80):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    originals = [[r.choice(vocabulary) for _ in range(r.randint(1, words))] for _ in range(n_docs // 6)]
    passage = [r.choice(vocabulary) for _ in range(30)]
    rows = []
    for i in range(n_docs):
        own = list(r.choice(originals))
        for _ in range(r.randint(0, max(1, len(own) // 12))):
            own[r.randrange(len(own))] = r.choice(vocabulary)
        if r.random() < 0.3:
            own += passage
        rows.append((i * 3 + 1, " ".join(own)))
    return rows


@pytest.mark.parametrize("seed, n, num, den, block", [(1, 4, 85, 100, 4_000_000), (2, 5, 8, 10, 4_000_000), (3, 4, 85, 100, 150), (4, 3, 5, 10, 400)])
def test_components_equal_brute_force(spark, seed, n, num, den, block):
    rows = near_copies(seed)
    got = ngram_join.join(frame(spark, rows).repartition(5), n, (num, den), block_grams=block).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows, n, num, den)


def test_join_edge_cases(spark):
    rows = [(5, None, "x", "y"), (6, "", None, None), (7, " \t\n", "x", "y"), (8, "One two", "x", "y"), (2, "one TWO", "x", "y"), (9, "one two three", "x", "y"), (None, "one two", "x", "y"), (2, "one two", "x", "y"),
            (11, "É a b c d", "x", "y"), (12, "é a b c d", "x", "y"), (13, "x y z q " * 5000, "x", "y"), (14, "x y z q " * 4000, "x", "y")]
    got = ngram_join.join(frame(spark, rows, DOCS), 4, (85, 100)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute_components([r[:2] for r in rows], 4, 85, 100)
    assert ngram_join.join(frame(spark, [], DOCS)).count() == 0


def test_keep_first_keeps_columns_and_one_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(4, text, "a", "b"), (3, text, "c", "d"), (3, text, "c", "d"), (9, text + " more", "a", "b"), (None, text, "n", "n"), (8, "other words stand here today", None, None)]
    kept = ngram_join.keep_first(frame(spark, rows, DOCS))
    assert kept.columns == ["doc_id", "text", "extra", "set_id"]
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [3, 8, None]


def test_keep_first_keeps_different_texts_of_one_id(spark):
    text, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(1, text), (1, other), (1, other), (2, other + " end"), (3, text), (4, None), (4, ""), (5, " "), (None, other)]
    kept = ngram_join.keep_first(frame(spark, rows))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, text), (1, other), (4, None), (5, " "), (None, other)], key=str) or sorted(map(tuple, kept.collect()), key=str) == sorted([(1, text), (1, other), (4, ""), (5, " "), (None, other)], key=str)


@pytest.mark.parametrize("block_sets", [3, 17])
def test_large_groups_of_few_links_cut_into_blocks(spark, block_sets):
    """Texts that share long passages meet as candidates, though few are similar."""
    rows = near_copies(11, 150, 120)
    got = ngram_join.join(frame(spark, rows).repartition(3), 3, (6, 10), block_sets=block_sets).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows, 3, 6, 10)


@pytest.mark.parametrize("num, den", [(8, 10), (85, 100), (5, 10)])
def test_similar_sets_share_as_many_signatures_as_asked(num, den):
    r = np.random.default_rng(num)
    levels = ngram_join.Levels(num, den)
    for i in range(1500):
        size = int(r.integers(1, 600))
        pool = np.unique(r.integers(0, 1 << 62, 2 * size).astype(np.uint64))
        r.shuffle(pool)
        one = pool[:size]
        differ = (den - num) * 2 * size // (den + num)  # as many as a pair of this size can bear, on either side
        gone = differ if i % 3 == 0 else 0 if i % 3 == 1 else differ // 2
        other = np.r_[one[gone:], pool[size : size + differ - gone]]
        same = len(np.intersect1d(one, other))
        if not same or same * den < num * (size + len(other) - same):
            continue
        one, other = np.sort(one), np.sort(other)
        for a, b in ((one, other), (other, one)):
            there = ngram_join.signatures(b, levels)
            assert any(np.isin(hashes, there).sum() >= need for hashes, need in ngram_join._cuts(a, levels))


@pytest.mark.parametrize("common", [3, 50])
def test_signatures_of_several_sets_across_batches(common):
    import pyarrow as pa

    r = random.Random(2)
    for _ in range(200):
        rows = sorted((r.randrange(5), r.randrange(9), 8) for _ in range(r.randint(0, 40)))
        edges = sorted(r.choices(range(len(rows) + 1), k=4))
        parts = [rows[a:b] for a, b in zip([0, *edges], [*edges, len(rows)], strict=True)]
        schema = pa.schema([("sig", pa.int64()), ("set_id", pa.int64()), ("cut", pa.int32())])
        batches = (pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in p], schema) for p in parts)
        got = [tuple(x.values()) for b in ngram_join._shared(batches, common) for x in b.to_pylist()]
        sets = {sig: len({x[1] for x in rows if x[0] == sig}) for sig, *_ in rows}
        assert set(got) == {(*x, min(sets[x[0]], common)) for x in rows if sets[x[0]] > 1}
        assert common < 50 or len(got) == len(set(got))


@pytest.mark.parametrize("num, den, n", [(8, 10, 3), (85, 100, 2), (5, 10, 3)])
def test_similar_sets_share_a_rare_signature(spark, num, den, n):
    """Also where passages, which the order puts last, are most of the texts."""
    r = random.Random(den)
    passages = [" ".join(f"p{i}x{j}" for j in range(r.randint(20, 90))) for i in range(3)]
    rows = []
    for i, (_, text) in enumerate(near_copies(num, 60, 60)):
        words = (text + " " + r.choice(passages)).split()
        for copy in range(r.randint(1, 4)):
            own = list(words)
            for _ in range(r.randint(0, max(1, len(own) // 12))):
                own[r.randrange(len(own))] = f"e{i}x{copy}"
            rows.append((len(rows), " ".join(own)))
    have = {}
    for x in ngram_join._rare(frame(spark, rows).repartition(3), n, num, den).collect():
        have.setdefault(x["set_id"], set()).add(x["sig"])
    sets = {ngram_join._set_id(s): set(s.tolist()) for s in (ngram_join.grams(t.encode(), n) for _, t in rows)}
    similar = [(a, b) for a in sets for b in sets if a < b and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    assert len(similar) > 20
    assert all(have.get(a, set()) & have.get(b, set()) for a, b in similar)


def test_merge_skip_equals_counting():
    r = random.Random(7)
    for _ in range(200):
        lists = [sorted(r.sample(range(40), r.randint(1, 25))) for _ in range(r.randint(1, 12))]
        for t in range(1, len(lists) + 2):
            counts = {i: sum(i in own for own in lists) for i in range(40)}
            assert list(ngram_join.merge_skip(lists, t)) == [(i, c) for i, c in counts.items() if c >= t]


def test_divide_skip_equals_counting():
    r = np.random.default_rng(5)
    sets = [np.unique(r.integers(0, 90, r.integers(3, 60)).astype(np.uint64)) for _ in range(150)]
    index = ngram_join.Index(sets, 6, 10)
    for q in sets[:60]:
        overlap = [len(np.intersect1d(q, s)) for s in sets]
        want = [i for i, s in enumerate(sets) if 10 * overlap[i] >= 6 * (len(q) + len(s) - overlap[i])]
        assert index.search(q, np.ones(len(sets), bool)).tolist() == want


def test_connected_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 40)] + [(500, 500), (None, 3), (39, 700)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in [*range(1, 40), 700]} == {1} and 500 not in got


def test_least_nodes_are_handed_out_without_a_broadcast(spark):
    """a node's row is exploded to its salts, which Spark does not count when it takes a side for small enough."""
    edges = [(i, i + 1) for i in range(0, 3000, 3)] + [(9000, 5000 + i) for i in range(300)]
    pairs = spark.createDataFrame(edges, "a long, b long")
    found = components._with_least(pairs, components._pull(pairs)).select("a", "b", "m")
    least = {}
    for a, b in edges:
        least[a] = min(a, b, least.get(a, b))
    assert sorted(map(tuple, found.collect())) == sorted((a, b, least[a]) for a, b in edges)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block_sets", [3, 512])
def test_texts_chosen_by_bits_of_their_ids(spark, monkeypatch, block_sets):
    """more places than are broadcast lead to the same components, and few texts of others are shuffled for them."""
    monkeypatch.setattr(ngram_join, "PLACES", 0)
    rows = near_copies(11, 150, 120) + [(None, "a b c d e f g h"), (None, "a b c d e f g x")]
    got = ngram_join.join(frame(spark, rows).repartition(3), 3, (6, 10), block_sets=block_sets).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows, 3, 6, 10)
    docs = spark.range(4000).select(F.col("id").alias("doc_id"))
    members = spark.createDataFrame([(i,) for i in range(0, 4000, 20)], "rep long")
    kept = {x.doc_id for x in ngram_join._of_members(docs, members, 200).collect()}
    assert kept >= set(range(0, 4000, 20)) and len(kept) < 800


def test_fullest_is_optimal():
    r = random.Random(3)
    for _ in range(60):
        lengths = sorted(r.sample(range(1, 60), r.randint(1, 7)), reverse=True)
        counts = [r.randint(0, 3) for _ in lengths]
        room = r.randint(0, 120)
        sums = {0}
        for n, c in zip(lengths, counts, strict=True):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        use = packing.fullest(lengths, counts, room)
        assert sum(n * k for n, k in use) == max(s for s in sums if s <= room)
        assert all(k <= counts[lengths.index(n)] for n, k in use)


def check_packing(rows, capacity):
    by_doc, bins = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return by_doc, bins


def test_pack_round_trip(spark):
    r = random.Random(8)
    texts = [" ".join(r.choice(["the", "It's", "naïve", "über", "x1", "<|endoftext|>", "ΑΣ", "tail.", "mark!!", "日本"]) for _ in range(r.randint(0, 300))) for _ in range(150)]
    rows = [(i, t, "e", "s") for i, t in enumerate(texts)] + [(900, None, "e", "s"), (901, "", "e", "s"), (902, "word " * 20000, "e", "s"), (None, "no id", "e", "s"), (3, texts[3], "e", "s")]
    got = packing.pack(frame(spark, rows, DOCS).repartition(4), with_ids=True).collect()
    by_doc, bins = check_packing(got, packing.CAPACITY)
    tokenizer = packing.load_tokenizer("word_bpe_49k.json")
    for d, t in [(r[0], r[1]) for r in rows]:
        want = np.asarray([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes()
        own = sorted((p for p in by_doc[d]), key=lambda p: p["piece"])
        copies = sum(1 for r in rows if r[0] == d)

        assert b"".join(bytes(p["ids"]) for p in own[::copies]) == want
        assert all(p["ids_crc32"] == zlib.crc32(bytes(p["ids"])) and p["length"] == len(p["ids"]) // 4 and p["start"] == 4096 * p["piece"] for p in own)
    total = sum(r["length"] for r in got)
    assert len(bins) == -(-total // 4096)
    assert packing.pack(frame(spark, [], DOCS)).count() == 0


def test_plan_is_near_the_bound():
    r = random.Random(1)
    histogram = {}
    for _ in range(3000):
        n = min(4096, int(r.lognormvariate(6, 1)) + 1)
        histogram[n] = histogram.get(n, 0) + 1
    plan = packing.plan_bins(histogram)
    used = {}
    for times, combination in plan:
        assert sum(n * k for n, k in combination) <= 4096
        for n, k in combination:
            used[n] = used.get(n, 0) + times * k
    assert used == histogram
    assert sum(t for t, _ in plan) <= -(-sum(n * c for n, c in histogram.items()) // 4096) + 1
