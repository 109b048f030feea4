import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from skeinlake.llm import ann, decontamination, html_text, pii, quality, toxicity, url_filter, warc
from skeinlake.llm.common import materialize

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, id string"


def documents(spark, rows, schema=DOCS):
    full = [(*r, *(None,) * (7 - len(r))) for r in rows]
    return spark.createDataFrame(full, schema)


def prose(r, n=60, vocabulary=300):
    return " ".join(f"wort{r.randrange(vocabulary)}" for _ in range(n))


# quality


def quality_rows(n=240):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        bad = i % 6 == 0
        text = prose(r)
        if bad:
            text = " ".join(w + "%%%" for w in text.split()) if i % 12 else " ".join(w for w in text.split() for _ in range(5))
        rows.append((i, text, "en", f"src{i % 4}", len(text)))
        if i % 2 == 0:
            labels.append((i, int(not bad), 0))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


def test_quality_rejects_junk_and_keeps_the_rest(spark):
    rows, labels = quality_rows()
    docs, labels = documents(spark, rows), spark.createDataFrame(labels, LABELS)
    got = {r["doc_id"]: r for r in quality.score(docs, labels).collect()}
    assert {i for i, r in got.items() if not r["keep"]} == {i for i in range(240) if i % 6 == 0}
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 200
    # the posterior is the classifier's evidence on the section's rate
    one = got[1]
    logit = lambda p: np.log(p / (1 - p))
    assert logit(one["score"]) == pytest.approx(one["llr"] + logit(one["path_rate"]), abs=1e-6)


def test_sparse_sites_shrink_towards_their_parents(spark):
    evidence = [("big", "en", 6.0)] * 300 + [("big", "de", -6.0)] * 300 + [("small", "en", -6.0)] + [(None, None, 6.0)] * 2
    rates = {(r["host"], r["path"]): r for r in quality.site_rates(spark.createDataFrame(evidence, "host string, path string, llr double"), 0.5).collect()}
    assert rates["big", "en"]["path_rate"] > 0.95 and rates["big", "de"]["path_rate"] < 0.05
    assert 0.4 < rates["small", "en"]["host_rate"] < 0.6  # one bad page says little
    assert (None, None) in rates


def test_quality_edge_cases(spark):
    rows, labels = quality_rows(60)
    rows += [(None, None, None, None), (1, "", "en", "src1"), (1, "", "en", "src1"), (900, "wort1 " * 30000, "en", "src0")]
    docs = documents(spark, rows)
    got = quality.score(docs, spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(rows) and all(r["score"] is not None for r in got)
    assert quality.score(docs, spark.createDataFrame([], LABELS)).where("keep").count() == len(rows)
    assert quality.score(documents(spark, []), spark.createDataFrame(labels, LABELS)).count() == 0


# personal data


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


PATTERNS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def brute_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), order, kind, m.end()))
    return sorted(out)


def test_base_spans_equal_brute_force(spark):
    r = random.Random(4)
    bits = ["a@b.c", "a.b@c-d.e.f_g@h.i", "x@y", "@", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.002.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111 4111111111111111", "42", "+1 (555) 010-9999", "+1", "+49 30 1234", "é", "日本", "😀", " ", "-", ".", "+", "12", "word", "\n"]
    texts = ["".join(r.choice(bits) + r.choice(["", " ", ", "]) for _ in range(r.randint(0, 14))) for _ in range(1500)] + [None, "", "1" * 3000, "1 " * 3000, "1." * 3000, "a" * 5000 + "@", "+" + "1-" * 3000]
    found = pii.digest(pii.find(documents(spark, list(enumerate(texts))), support=10**9)).collect()
    for row in found:
        want = brute_spans(texts[row["doc_id"]])
        text = ",".join(f"{k}:{a}:{b}" for a, _, k, b in want)
        assert row["spans"] == text, texts[row["doc_id"]][:200]
        assert row["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        counts = Counter(k for _, _, k, _ in want)
        assert tuple(row[f"n_{k}"] for k, _ in PATTERNS) == tuple(counts[k] for k, _ in PATTERNS)


def test_terms_that_give_an_entity_away_are_found_and_common_ones_stay(spark):
    r = random.Random(6)
    rows = [(i, f"{prose(r, 8)} Zorbania's clerk Melkior wrote from melk@zor.example the {prose(r, 8)}", "en", "s") for i in range(6)]
    rows += [(100 + i, f"the clerk wrote {prose(r, 20)}", "en", "s") for i in range(500)]
    rows += [(700, "Melkior was here", "en", "s"), (701, None), (None, ""), (702, "nobody, the clerk", None, None)]
    docs = documents(spark, rows)
    terms, _ = pii.disclosing_terms(docs.select("doc_id", "text"))
    assert {"melkior", "zorbania's"} <= {t["term"] for t in terms.collect()} and not {"the", "clerk"} & {t["term"] for t in terms.collect()}
    clean = {x["doc_id"]: x["text"] for x in pii.sanitize(docs).collect()}
    assert pii.sanitize(docs).columns == docs.columns
    assert "melk@zor.example" not in clean[0] and "[EMAIL]" in clean[0] and "Zorbania" not in clean[0] and "[TERM] wrote" in clean[0]
    assert clean[702] == "nobody, the clerk" and clean[701] is None and clean[700] == "[TERM] was here"
    assert pii.find(documents(spark, [])).count() == 0


def test_terms_near_entities_seen_once_and_near_common_ones(spark):
    r = random.Random(7)
    rows = [(i, f"the clerk wrote {prose(r, 20)}") for i in range(600)]
    # once; twice; and an entity in a tenth of the documents, near which one name stands always and another only once
    rows += [(1000, "the clerk Melkior wrote from melk@zor.example")] + [(1001 + i, f"the clerk Quendal of {prose(r, 2)} wrote quen@zor.example") for i in range(2)]
    rows += [(2000 + i, f"the clerk {'Hothand' if i < 10 else 'Lonely' if i == 10 else ''} wrote to hot@zor.example {'abcdefghij'[i % 10] * 3}{'klmnopq'[i // 10] * 3}") for i in range(70)]
    # the window cuts a word, whose end is a word elsewhere
    rows += [(3000, f"xxxxxxabcrapist {'the ' * 14} cut@zor.example"), (3001, "rapist clerk")]
    docs = documents(spark, rows)
    terms = {t["term"] for t in pii.disclosing_terms(docs.select("doc_id", "text"))[0].collect()}
    assert {"melkior", "quendal", "hothand"} <= terms and not {"the", "clerk", "wrote", "lonely", "rapist"} & terms
    clean = {x["doc_id"]: x["text"] for x in pii.sanitize(docs).collect()}
    assert clean[1000].startswith("the clerk [TERM] wrote") and clean[2000].startswith("the clerk  wrote") and clean[3001] == "rapist clerk"


# WARC


def test_warc_round_trip(spark):
    long_ = "<p>" + "é x " * 600 + "</p>"
    tricky = "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.0\r\n" * 40
    rows = [(1, "http://a/1", long_), (7, "http://a/7%41\n", long_), (3, None, long_), (4, "http://a/4", "short"), (5, "http://a/5", "short"), (6, "http://a/6", None), (8, "http://a/8", ""), (9, "http://a/9", tricky), (None, "http://a/n", long_), (7, "http://a/7%41\n", long_), (2, "", tricky)]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, kind string, id string").repartition(3)
    got = warc.round_trip(pages, with_payload=True).collect()
    assert len(got) == len(rows)
    for r in got:
        payload = next((h or "").encode() for i, u, h in rows if (i, u) == (r["page_id"], r["url"]))
        assert r["payload_bytes"] == len(payload) and r["payload_digest"] == hashlib.sha1(payload).hexdigest()
        best = max((i for i, _, h in rows if (h or "").encode() == payload and i is not None), default=None) if len(payload) >= 1000 else r["page_id"]
        assert (r["record_type"], r["refers_to_page"]) == (("response", None) if r["page_id"] == best else ("revisit", best))
        assert r["request"]["method"] == "GET" and (r["record_type"] == "revisit" or bytes(r["payload"]) == payload)
    assert warc.round_trip(pages.where("page_id > 1000")).count() == 0


def test_warc_records_are_well_formed():
    one = warc.transaction(5, "http://x/", b"body", None)
    kinds = [f["WARC-Type"] for f, _ in warc.records(one)]
    assert kinds == ["request", "response", "metadata"]
    fields = [f for f, _ in warc.records(one)]
    assert fields[0]["WARC-Concurrent-To"] == fields[1]["WARC-Record-ID"] == fields[2]["WARC-Concurrent-To"]


# toxicity


def toxic_rows():
    r = random.Random(9)
    rows, labels = [], []
    for i in range(900):
        words = prose(r, 40).split()
        toxic = i % 5 == 0
        for _ in range(3 if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(["blarg", "fnordish", "fnordly", "kwix"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_held_out_accuracy(spark):
    rows, labels = toxic_rows()
    train = spark.createDataFrame([l for l in labels if l[0] % 3], LABELS)
    got = {r["doc_id"]: r for r in toxicity.score(documents(spark, rows), train).collect()}
    held = [i for i in range(900) if i % 3 == 0]
    assert np.mean([got[i]["predicted"] == int(i % 5 == 0) for i in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[0]["evidence"][0]["cosine"] > 0


def test_toxicity_edge_cases(spark):
    rows, labels = toxic_rows()
    odd = [(None, None), (1, ""), (1, ""), (2000, "blarg " * 50000), (2001, "Blarg! KWIX")]
    got = toxicity.score(documents(spark, rows[:300] + odd), spark.createDataFrame(labels[:300], LABELS)).collect()
    assert len(got) == 305 and all(r["score"] is not None for r in got)
    assert all(r["predicted"] == 1 for r in got if r["doc_id"] in (2000, 2001))
    assert {r["predicted"] for r in toxicity.score(documents(spark, odd), spark.createDataFrame([], LABELS)).collect()} == {0}
    assert toxicity.score(documents(spark, []), spark.createDataFrame(labels, LABELS)).count() == 0


def test_terms_above_the_base_rate_are_evidence(spark):
    # "hint" is toxic in 24 of 120 documents, against a rate of 0.05: no proof, but far beyond chance
    rows = [(i, f"{'hint' if i < 120 else 'none'} plain words") for i in range(1000)]
    labels = spark.createDataFrame([(i, 1, int(i < 24 or 500 <= i < 526)) for i in range(1000)], LABELS)
    docs = documents(spark, rows)
    assert (toxicity.fit(docs, labels).weight > 0).all()
    got = {r["doc_id"]: r for r in toxicity.score(docs, labels).collect()}
    assert got[100]["score"] > got[900]["score"] and got[100]["evidence"] and got[900]["evidence"]


def test_block_max_search_is_exact():
    r = np.random.default_rng(1)
    vectors = []
    for _ in range(700):
        terms = np.sort(r.choice(40, r.integers(1, 6), replace=False))
        w = r.random(len(terms)) + 0.1
        vectors.append((terms, w / np.sqrt((w * w).sum())))
    dense = np.zeros((700, 40))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    index = toxicity.BlockMaxIndex(vectors, 40, 32)
    asked = list(range(0, 700, 13))
    for i, (near, cosines) in zip(asked, index.search([vectors[i] for i in asked], 15, asked), strict=True):
        all_ = dense @ dense[i]
        all_[i] = 0
        want = [j for j in np.lexsort((np.arange(700), -all_.round(6))) if all_[j] > 0][:15]
        assert len(near) == len(want) and np.allclose(cosines, all_[want], atol=1e-6)


def test_toxicity_cuts_texts_once(spark):
    """Scores come from the terms that frequencies were counted from, not from the texts again."""
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.score(docs, labels)
    assert not set(found.inputFiles()) & set(docs.inputFiles())
    assert found.count() == docs.count()
    r = np.random.default_rng(3)
    for n in (0, 1, 2, 700):
        terms, counts = np.sort(r.choice(2**31 - 1, n, replace=False)), r.integers(1, 2**31 - 1, n)
        back = toxicity.unpack(n, toxicity.pack(terms, counts))
        assert np.array_equal(back[0], terms) and np.array_equal(back[1], counts)


def test_toxicity_index_is_not_made_on_the_driver(spark):
    rows, labels = toxic_rows()
    model = toxicity.fit(documents(spark, rows), spark.createDataFrame(labels, LABELS))
    assert "index" not in vars(model) and all(isinstance(x, bytes) for x in model.packed)
    assert len(model.steps) > 2 and (np.diff(model.values) >= 0).all()
    assert "index" not in model.__getstate__()


def test_toxicity_words_are_those_of_the_pattern():
    for text in ("", "a_b-C9\x1cd\x1fe\x85f", "".join(map(chr, range(128))) * 2, "".join(map(chr, range(0x2200))), "\u212aelvin", "\u0130x"):
        assert toxicity.words(text) == re.findall(r"\w+", text.lower())
    known = toxicity.Terms(np.sort(np.array([toxicity._hash(w) for w in ("a", "b", "c")], np.uint64)))
    sizes, terms, counts = known.count([["a", "x", "a", "b"], [], ["x"], ["c", "a"]])
    assert sizes.tolist() == [2, 0, 0, 2] and len(terms) == 4 and sorted(counts.tolist()) == [1, 1, 1, 2]


def test_toxicity_query_equals_brute_force(spark):
    """The cosines of op6's evidence against dense TF-IDF vectors of whole texts, over all examples."""
    from skeinlake.llm import queries

    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    train = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["toxic"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["doc_id"] in docs}
    counts = {i: Counter(re.findall(r"\w+", t.lower())) for i, t in docs.items()}
    rate = sum(train.values()) / len(train)
    weight = {}
    for word in {w for i in train for w in counts[i]}:
        n, t = sum(word in counts[i] for i in train), sum(word in counts[i] for i in train if train[i])
        idf = math.log((len(docs) + 1) / (sum(word in c for c in counts.values()) + 1)) + 1e-3
        weight[word] = idf * (abs(math.log((t + 2 * rate) / (n - t + 2 * (1 - rate))) - math.log(rate / (1 - rate))) + 1e-3)

    def unit(c):
        v = {w: (1 + math.log(k)) * weight[w] for w, k in c.items() if w in weight}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {w: x / norm for w, x in v.items()}

    vectors = {i: unit(c) for i, c in counts.items()}
    got = queries.op6_toxicity(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got[::3]:
        q = vectors[r["doc_id"]]
        cosines = {j: sum(x * vectors[j].get(w, 0.0) for w, x in q.items()) for j in train}
        want = sorted((c for c in cosines.values() if c > 1e-9), reverse=True)[:15]
        assert np.allclose([e["cosine"] for e in r["evidence"]], want, atol=1e-5)
        assert all(abs(cosines[e["doc_id"]] - e["cosine"]) < 1e-5 and e["toxic"] == train[e["doc_id"]] for e in r["evidence"])


# decontamination


def brute_alignment(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment_equals_the_table():
    r = np.random.default_rng(3)
    for _ in range(60):
        a, b = r.integers(1, 6, r.integers(1, 25)), r.integers(1, 6, r.integers(1, 40))
        assert decontamination.local_alignment(a, b)[0] == brute_alignment(a, b)


def test_copies_edited_copies_and_clean_documents(spark):
    r = random.Random(12)
    items = [prose(r, 30, 500) for _ in range(12)]
    rows = []
    for i in range(120):
        words = prose(r, 50, 500).split()
        if i % 3 == 0:
            copy = items[i % 12].split()
            for _ in range(i % 4):
                copy[r.randrange(len(copy))] = "changed"
            if i % 2:
                copy.insert(7, "extra")
            words[20:20] = copy
        rows.append((i, " ".join(words).capitalize()))
    # an item that everything quotes, and clean odd rows
    rows += [(1000 + i, items[0] + " tail") for i in range(150)] + [(2000, None), (2001, ""), (None, "clean"), (2002, prose(r, 40000, 500))]
    bench = spark.createDataFrame([*((i, t, "x") for i, t in enumerate(items)), (50, None, "x"), (None, items[0], "x"), (51, "too short", "x"), (0, items[0], "y")], "item_id long, text string, _hits string")
    docs = documents(spark, rows)
    got = {x["doc_id"]: x for x in decontamination.flag(docs, bench).collect()}
    want = {i for i in range(120) if i % 3 == 0} | {1000 + i for i in range(150)}
    assert {i for i, x in got.items() if x["contaminated"]} == want
    assert all(got[i]["item_id"] == i % 12 for i in range(0, 120, 3))
    x, text = got[0], dict((d, t) for d, t in rows)[0]
    assert text[x["start"] : x["end"]].lower() == items[0]
    kept = decontamination.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(rows) - len(want)
    assert decontamination.flag(docs, bench.where("item_id = 51")).where("contaminated").count() == 0
    assert decontamination.flag(documents(spark, []), bench).count() == 0


@pytest.mark.parametrize("n", [2, 3, 1000])
def test_edited_copies_are_found_however_many_there_are(spark, n):
    r = random.Random(8)
    item, other = [f"item{i}" for i in range(20)], [f"other{i}" for i in range(20)]
    edited = lambda x: " ".join("changed" if i % 5 == 4 else w for i, w in enumerate(x))
    rows = [(i, f"{prose(r, 10)} {edited(item)} {prose(r, 10)}") for i in range(n)]
    # a verbatim leak beside copies of an edited version, in some documents together
    rows += [(2000 + i, f"{edited(other)} {prose(r, 40)}") for i in range(5)] + [(3000, f"{prose(r, 5)} {' '.join(other)}"), (3001, f"{' '.join(other)} {prose(r, 60)} {edited(other)}")]
    rows += [(4000, f"{prose(r, 20)} {' '.join(item[:4])} {prose(r, 20)}"), (4001, prose(r, 30))]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(other))], "item_id long, text string")
    got = {x["doc_id"]: x for x in decontamination.flag(documents(spark, rows), bench).collect()}
    assert {i for i, x in got.items() if x["contaminated"]} == {*range(n), *range(2000, 2005), 3000, 3001}
    assert got[0]["score"] == 0.725 and got[2000]["item_id"] == 2 and got[3001]["score"] == 1


def test_blocks_of_the_benchmark_add_up(spark, monkeypatch):
    r = random.Random(5)
    items = [prose(r, 20, 400) for _ in range(20)]
    docs = documents(spark, [(i, f"{prose(r, 10, 400)} {items[i % 20]} {prose(r, 10, 400)}") for i in range(40)])
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    whole = sorted(map(str, decontamination.flag(docs, bench).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 600)
    assert len(decontamination.blocks(docs, bench)) > 2
    assert {x["doc_id"] for x in decontamination.flag(docs, bench).where("contaminated").collect()} == set(range(40)) and len(whole) == 40


# nearest neighbours


def test_search_recall_order_and_edge_cases(spark):
    r = np.random.default_rng(11)
    x = r.normal(size=(1500, 16)) + r.normal(size=(10, 16))[r.integers(0, 10, 1500)]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    odd = [(1500, None, 1), (1520, [0.0] * 16, 1), (1540, [float("nan")] * 16, 1), (1560, [1.0] * 7, 1), (None, x[0].tolist(), 1), (1580, [None] + [1.0] * 15, 1), (1600, [float("inf")] + [1.0] * 15, 1), (40, x[40].tolist(), 1)]
    data = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, rank int").repartition(3)
    got = {}
    for q in ann.search(data, rerank=200, row_block=400, query_block=30).collect():
        got.setdefault(q["query_id"], []).append((q["rank"], q["vec_id"], q["score"]))
    assert set(got) == set(range(0, 1500, 20))
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and all(f[1] != q for f in found)
        assert all(abs(f[2] - x[f[1]] @ x[q]) < 1e-9 for f in found) and [f[2] for f in found] == sorted((f[2] for f in found), reverse=True)
        best = np.argsort(-np.where(np.arange(1500) == q, -np.inf, x @ x[q]), kind="stable")[:20]
        hits += len({f[1] for f in found} & set(best.tolist()))
    assert hits / (20 * len(got)) >= 0.9
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ann.search(few).orderBy("rank").collect()] == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]
    assert ann.search(few.where("vec_id > 9")).count() == 0


def test_beam_search_beats_greedy_encoding():
    r = np.random.default_rng(2)
    x = r.normal(size=(600, 12))
    books = ann.fit(x, books=4, k=16)
    error = lambda beam: ((x - books.decode(books.encode(x, beam))) ** 2).sum()
    assert error(8) < error(1)


# HTML


ARTICLE = "<article><h1>Head &amp; more</h1><p>One  two<br>three <b>four</b></p><p><b>Open<p>Next &lt;tag&gt;&copy;</p><ul><li>a<li>b</ul><div class='ad-box'>buy</div><section id='comments'><p>reader</p></section></article>"
EXPECTED = "Head & more\nOne two three four\nOpen\nNext <tag>©\na\nb"


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p><article>';</script></head><body><nav><ul><li><a href='/x'>menu</a></li></ul></nav><header>top</header><!-- <p>no</p> --><div class='cookie-notice'>c</div>{body}<aside>side</aside><form><p>f</p></form><footer>foot</footer></body></html>"


def test_articles_without_what_is_around_them(spark):
    rows = [(1, "http://a/1", page(ARTICLE)), (2, "http://a/2", page(ARTICLE)), (3, None, None), (4, "x", ""), (5, "http://b/", "plain text"), (6, "http://b/", page(ARTICLE)[:-90]), (1, "http://a/1", page(ARTICLE)), (7, "http://c/", "<article>" + "<p>w</p>" * 30000)]
    data = spark.createDataFrame([(*r, "z", "z") for r in rows], "page_id long, url string, html string, text string, host string")
    got = [tuple(r) for r in html_text.extract(data).collect()]
    assert sorted(got, key=str) == sorted(((i, u, t, len(t)) for (i, u, _), t in zip(rows, [EXPECTED, EXPECTED, "", "", "plain text", EXPECTED, EXPECTED, "\n".join("w" * 30000)], strict=True)), key=str)
    assert html_text.extract(data.where("page_id > 99")).count() == 0


def test_style_tree_finds_what_a_site_repeats(spark):
    r = random.Random(3)
    rows = [(i, f"http://site/{i}", f"<body><div class='xa'><p>Everywhere the same words</p></div><div class='xb'><p>{html.escape(prose(r, 12))}</p></div></body>") for i in range(40)]
    data = spark.createDataFrame(rows, "page_id long, url string, html string")
    tree = {t["path"]: t for t in html_text.style_tree(data).collect()}
    assert tree["body>div.xa>p"]["importance"] < 0.01 and tree["body>div.xb>p"]["importance"] > 0.9
    for t in html_text.extract(data).collect():
        assert "Everywhere" not in t["text"] and t["text"].startswith("wort")


def test_marks_of_what_a_page_has_are_no_noise():
    wrapped = "<body class='has-sidebar comments-open'><div class='with-sidebar no-ads nav-open'><article><header class='entry-header'><h1>Title</h1></header><p title=\"x>one</p><p>two</p><div class='share-bar'>s</div></article></div><div class='sidebar-left'>w</div></body>"
    assert html_text.page_text(wrapped) == "Title\none\ntwo"
    assert html_text.page_text("<div class=sidebar><article><p>x</p></article></div><section class=comments><article class=comment>c</article></section>") == "x"


def test_the_tree_decides_in_main_elements_too(spark):
    r = random.Random(4)
    shared = prose(r, 15)
    rows = [(i, f"http://site/{i}", f"<body><article><h1>{prose(r, 4)}</h1><p>{shared}</p><p>{prose(r, 12)}</p><div class='xk'>Read on in our shop</div></article></body>") for i in range(30)]
    rows += [(100 + i, "http://copies/", "<article><div class='q'>one and the same</div></article>") for i in range(30)]
    got = {t["page_id"]: t["text"] for t in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("shop" not in got[i] and shared in got[i] and len(got[i].split("\n")) == 3 for i in range(30))
    assert {got[100 + i] for i in range(30)} == {"one and the same"}


# URLs


def test_rules_hosts_and_paths(spark):
    cases = {
        "https://example.com/en/1?x": ("example.com", "/en/1", "example.com/en/", "block"), "http://www.EXAMPLE.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"), "http://a.www.example.com/en/x": ("a.www.example.com", "/en/x", "www.example.com/en/", "allow"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"), "http://x.net/es/?": ("x.net", "/es/", "net/es/", "block"), "http://x.net/esp": ("x.net", "/esp", None, "allow"), "http://com": ("com", "", None, "allow"), "http://com/": ("com", "/", "com/", "allow"),
        "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "http://x.org?a=://b.net/es/": ("x.org", "", None, "allow"), "": ("", "", None, "allow"),
    }
    data = spark.createDataFrame([(i, u, None, "q") for i, u in enumerate(cases)], "page_id long, url string, html string, host string")
    for r in url_filter.judge(data).collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == list(cases.values())[r["page_id"]]
    assert url_filter.judge(data.where("page_id > 99")).count() == 0


def test_blocks_spread_over_links_unless_allowed(spark):
    link = lambda to: f'<head><link href="{to}" rel="canonical"></head>'
    rows = [
        (1, "http://a.org/1#x", link("http://b.org/1")), (2, "http://b.org/1", '<meta http-equiv="refresh" content="0; url=http://c.net/es/9">'), (3, "http://c.net/es/9", ""), (4, "http://d.org/1", link("http://e.net/fr/1")), (5, "http://e.net/fr/1", link("http://f.com/")),
        (6, "http://g.org/", link("/self")), (7, "http://h.org/", None), (8, "http://z.org/", ""),
    ]
    data = spark.createDataFrame(rows, "page_id long, url string, html string")
    redirects = spark.createDataFrame([("http://h.org/", "http://a.org/1"), (None, "x")], "source string, target string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(data, redirects=redirects).collect()}
    assert got == {1: (None, "block"), 2: (None, "block"), 3: ("net/es/", "block"), 4: (None, "allow"), 5: ("net/fr/", "block"), 6: (None, "allow"), 7: (None, "block"), 8: (None, "allow")}


def test_links_in_all_common_forms(spark):
    base = "http://a.org/b/c?q"
    canonical = lambda x: f"<LINK rel=canonical href={x}>"
    refresh = lambda x: f'<meta http-equiv="refresh" content="{x}">'
    cases = {
        canonical("page2.html"): ["http://a.org/b/page2.html"], canonical('"../x"'): ["http://a.org/x"], canonical("'?id=1'"): ["http://a.org/b/c?id=1"], canonical("./"): ["http://a.org/b/"], canonical("'../../../g/./h/..'"): ["http://a.org/g/"],
        canonical("//n.net/x"): ["http://n.net/x"], canonical("/r?s=/../t"): ["http://a.org/r?s=/../t"], canonical("'#top'"): [], canonical("mailto:x@y"): [], canonical('"http://n.net/?a=1&amp;b=2&#x2f;&#51;&copy=4"'): ["http://n.net/?a=1&b=2/3&copy=4"],
        '<link href=" http://n.net/o\'k " rel="alternate Canonical"><link rel="canonical" href="/two"><link rel="next" href="/no">': ["http://n.net/o'k", "http://a.org/two"],
        refresh("0; url='http://x.net/'"): ["http://x.net/"], refresh("0;URL=next"): ["http://a.org/b/next"], refresh("5, url=/a?b&amp;c") + refresh("0; url=&quot;/d&quot;"): ["http://a.org/a?b&c", "http://a.org/d"], refresh("30"): [], "<meta http-equiv='refresh' content='0; url=\"/in\"'>": ["http://a.org/in"],
        '<link title="a > b" rel="canonical" href="/gt">': ["http://a.org/gt"], '<link data-href="/no" rel="canonical" href="/yes">': ["http://a.org/yes"],
    }
    pages = spark.createDataFrame([(i, f"{base}&{i}#f", h.replace("?q", "")) for i, h in enumerate(cases)], "page_id long, url string, html string")
    got = {}
    for x in url_filter.page_links(pages).collect():
        got.setdefault(int(x["source"].split("&")[1]), []).append(x["target"])
    for i, (h, want) in enumerate(cases.items()):
        assert sorted(got.get(i, [])) == sorted(want), h
    alias = spark.createDataFrame([(1, "http://a.org/es/1", refresh("0; url='http://c.net/es/9?a&amp;b'")), (2, "http://c.net/es/9?a&b", ""), (3, "http://a.org/es/x", canonical("1"))], "page_id long, url string, html string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge(alias).collect()} == {1: "block", 2: "block", 3: "block"}


def test_stages_leave_columns_of_clashing_names_alone(spark):
    from skeinlake.llm import ngram_join

    r = random.Random(1)
    clash = ["spans", "removed", "_hits", "_q_llr", "_q_words", "_gone", "set_id", "item_id", "_terms", "quality", "host", "at", "_kept0"]
    schema = "doc_id long, " + ", ".join(f"{c} string" for c in clash) + ", text string, lang string, source string"
    docs = spark.createDataFrame([(i, *(f"{c}{i}" for c in clash), prose(r) + " a@b.example", "en", "s") for i in range(30)], schema)
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(30)], LABELS)
    bench = spark.createDataFrame([(1, prose(r, 20))], "item_id long, text string")
    for out in (quality.keep_good(docs, labels, threshold=0.0), ngram_join.keep_first(docs), decontamination.drop_contaminated(docs, bench), pii.sanitize(docs)):
        assert out.columns == docs.columns
        rows = out.collect()
        assert len(rows) == 30 and all(x[c] == f"{c}{x['doc_id']}" for x in rows for c in clash)
    assert "[EMAIL]" in rows[0]["text"]


def test_materialize_reads_back(spark):
    df = materialize(spark.range(5), "t")
    assert df.count() == 5


def test_short_benchmark_items_must_stand_unaltered(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon"), (2, "one two three")], "item_id long, text string")
    docs = documents(spark, [(1, "so Alpha beta, gamma delta epsilon then"), (2, "alpha beta gamma delta zeta"), (3, "one two three"), (4, None)])
    assert {r["doc_id"]: r["contaminated"] for r in decontamination.flag(docs, items).collect()} == {1: True, 2: False, 3: False, 4: False}


def test_a_document_alone_in_its_section_has_its_sites_rate(spark):
    rows = [(i, "Good words stand here in a line of text. " * 3 if i % 3 else "!! bad %% && ## !! bad ** $$ !!" * 3, "x", "host") for i in range(60)] + [(100, "Good words stand here in a line of text.", "only", "host")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)], LABELS)
    got = {r["doc_id"]: r for r in quality.score(documents(spark, rows), labels).collect()}
    assert abs(got[100]["path_rate"] - got[100]["host_rate"]) < 1e-9
    assert all(got[i]["keep"] == (i % 3 > 0) for i in range(60))


def test_toxicity_examples_beyond_the_characters_are_passed_over_one_by_one(spark):
    from skeinlake.llm import toxicity

    sizes = {i: 900 if i == 5 else 90 + i for i in range(12)}
    docs = spark.createDataFrame([(i, "a" * n) for i, n in sizes.items()], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in sizes], "doc_id long, toxic int")
    whole = {r["id"] for r in toxicity._examples(docs, labels, "toxic", 12, 10_000).collect()}
    assert whole == set(sizes)
    kept = {r["id"] for r in toxicity._examples(docs, labels, "toxic", 12, 800).collect()}
    # the long text doesn't fit, whenever its turn comes, and what comes after it still does
    assert 5 not in kept and len(kept) in (7, 8) and sum(sizes[i] for i in kept) <= 800
