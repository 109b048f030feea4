"""Cross-tokenizer alignment against byte offsets of whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from skeinlake.llm import alignment, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def brute():
    a_of = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_of.encode_special_tokens = True
    b_of = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    unprintable = [b for b in range(256) if b not in printable]
    to_byte = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(unprintable)}

    def tokens(text):
        a = a_of.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(to_byte[c] for c in t)) for i, t in zip(a.ids, a.tokens)]
        b = []
        for i in b_of.encode(text):
            p = b_of.id_to_piece(i)
            b.append((i, bytes.fromhex(p[3:5]) if b_of.is_byte(i) else p.replace("▁", " ").encode()))
        raw = (" " + text).encode()
        same = text and b"".join(t for _, t in a) == raw == b"".join(t for _, t in b)
        return (a, b) if same else ([], [])

    def spans(side):
        at = 0
        for i, t in side:
            yield i, at, at + len(t)
            at += len(t)

    def whole(texts):
        per, counts = [], Counter()
        for text in texts:
            a, b = tokens(text or "")
            a, b = list(spans(a)), list(spans(b))
            ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
            groups, last = [], 0
            for e in ends:
                groups.append(",".join(str(i) for i, s, t in a if last <= s and t <= e) + "|" + ",".join(str(i) for i, s, t in b if last <= s and t <= e))
                last = e
            links, j = [], 0
            for i, s, t in a:
                while j < len(b) and b[j][2] <= s:
                    j += 1
                k = j
                while k < len(b) and b[k][1] < t:
                    links.append((i, b[k][0]))
                    k += 1
            counts.update(links)
            per.append((len(a), len(b), groups, links))
        most = {}
        for (_, b_id), n in counts.items():
            most[b_id] = max(most.get(b_id, 0), n)
        return [(na, nb, len(g), len(ls), sum(counts[x] == most[x[1]] for x in ls), sum(counts[x] for x in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for na, nb, g, ls in per]

    return whole


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_query_against_offsets(spark, brute):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()[:60]
    short = [r for r in rows if len(r.text or "") < 6000]
    docs = spark.createDataFrame([(r.doc_id, r.text) for r in short], "doc_id long, text string")
    spark_rows = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in run(docs, spark).collect()}
    assert spark_rows == dict(zip([r.doc_id for r in short], brute([r.text for r in short])))


def run(docs, spark, **limits):
    """The query's own steps on these documents."""
    class Session:
        def __getattr__(self, name):
            return getattr(spark, name)

    original = queries.table
    score = alignment.score
    queries.table = lambda *_: docs
    alignment.score = lambda found: score(found, **limits)
    try:
        return queries.op11_alignment(spark, "")
    finally:
        queries.table, alignment.score = original, score


TEXTS = [None, "", " ", "a", "a  b\n\n c", "it's  \n the end ", "</s> <|endoftext|> <unk> <0x41>", "a▁b", "漢字 仮名" * 300, "ünïcödé 🙂 naïve", "the the the", "the the the", "\x00\x1c \x85 x", "tab\tx 　y", "x" * 3000, "a\nb c", "\n", " \n", "\na", "a\n b", "a\n\nb ", "a \n"]


@pytest.mark.parametrize("common", [1, 7, 1000])
def test_edges_whatever_counts_as_common(spark, brute, monkeypatch, common):
    monkeypatch.setattr(alignment, "REMEMBERED", 4)
    alignment.MEMORIES["pairs"]()
    docs = spark.createDataFrame([(i // 2, t, "clash", 1) for i, t in enumerate(TEXTS)] + [(None, "no id", "clash", 2)], "doc_id long, text string, links string, row int")
    got = sorted(tuple(r[c] for c in COLUMNS) for r in run(docs, spark, common=common).collect())
    assert got == sorted(brute([*TEXTS, "no id"]))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert run(docs, spark).collect() == []


def test_transitions_may_be_forgotten(monkeypatch):
    a, b = [b"ab", b"c", b"a"], [b"a", b"bc", b"abc"]
    walk = alignment.Transducer(a, b)
    first = walk.align([0, 1, 2], [0, 1, 0])
    assert first == ([(2, 2), (3, 3)], [(0, 0), (0, 1), (1, 1), (2, 0)])
    monkeypatch.setattr(alignment, "TRANSITIONS", 0)
    assert walk.align([0, 1, 2], [0, 1, 0]) == first
    with pytest.raises(ValueError):
        walk.align([1], [0])


@pytest.mark.parametrize(("together", "long", "transitions"), [(1, 1000, 300_000), (1, 6, 300_000), (20, 1000, 0)])
def test_chunks_walk_together_as_alone(monkeypatch, together, long, transitions):
    monkeypatch.setattr(alignment, "TOGETHER", together)
    monkeypatch.setattr(alignment, "LONG", long)
    monkeypatch.setattr(alignment, "TRANSITIONS", transitions)
    draw = random.Random(7)
    a, b = ([bytes([x]) for x in b"xyz"] + [bytes(draw.choices(b"xyz", k=n)) for n in (2, 2, 3, 3, 4, 5)] for _ in "ab")
    walk = alignment.Transducer(a, b)

    def split(raw, tokens):
        at, out = 0, []
        while at < len(raw):
            out.append(draw.choice([i for i, t in enumerate(tokens) if raw.startswith(t, at)]))
            at += len(tokens[out[-1]])
        return out

    for _ in range(3):
        raws = [bytes(draw.choices(b"xyz", k=draw.choice([0, 1, 5, 12, 40]))) for _ in range(300)]
        sides = [[split(r, tokens) for r in raws] for tokens in (a, b)]
        flat = [(np.array([x for row in s for x in row], np.int32), np.cumsum([len(row) for row in s])) for s in sides]
        side, token, closes, other = walk.align_all(*flat[0], *flat[1])
        at = 0
        for x, y in zip(*sides):
            to = at + len(x) + len(y)
            n_b = np.cumsum(side[at:to])
            shut = closes[at:to]
            ends = [(i + 1 - int(n_b[i]), int(n_b[i])) for i in np.flatnonzero(shut)]
            links = [(t, o) if s == 0 else (o, t) for s, t, o in zip(side[at:to].tolist(), token[at:to].tolist(), other[at:to].tolist()) if o >= 0]
            assert (ends, links) == walk.align(x, y)
            at = to


def test_edges_where_chunks_walk_together(brute, monkeypatch):
    monkeypatch.setattr(alignment, "TOGETHER", 1)
    monkeypatch.setattr(alignment, "CHUNKS", 5)
    pair = alignment.Pair("byte_bpe_50k.json", "piece_bpe_32k.model")
    for text in [*TEXTS, "no id"]:
        keys = pair.keys(text)
        found = [dict(pair.of(keys))[k] for k in keys]
        broken = alignment.BROKEN in found
        groups = [] if broken else [g for _, g, _ in found]
        n_a, _, n_groups, n_links, _, _, digest = brute([text])[0]
        assert (0 if broken else sum(n for n, _, _ in found)) == n_a
        assert sum(g.count(b"|") for g in groups) == n_groups and (hashlib.sha256(b";".join(groups)).hexdigest() if groups else "") == digest
        assert (0 if broken else sum(len(links) // 8 for _, _, links in found)) == n_links


def test_memory_looks_up_only_what_is_asked_for():
    """A batch costs what it asks for, not what is remembered."""
    from skeinlake.llm.byte_bpe import Memory

    class Watched(Memory):
        def keys(self):
            raise AssertionError("all that is remembered was walked")

    known = Watched(1000)
    for asked in ({"a", "b"}, {"b", "c"}, {"a", "d" * 100}):
        worked = []
        long = known.learn(asked, lambda new: (worked.extend(new), [(w, w) for w in new])[1])
        assert all(known[w] == w for w in asked) and long == [w for w in worked if len(w) > 64]
        known.forget(long)
    assert set(known) == {"a", "b", "c"} and worked == ["d" * 100]


def test_plain_chunks_are_cut_as_by_the_pattern():
    from skeinlake.llm.alignment import remembered_pair

    pair = remembered_pair("byte_bpe_50k.json", "piece_bpe_32k.model")
    for text in (" ", " abc", " s", " It's", " ab1", " été", "abc", "\nabc", " a b", " " + "x" * 300, " abc,", "  abc"):
        ids, ends = pair.tokens([text])
        words = dict(pair.a.ranks.encode(set(pair.a.cut(text))))
        assert ids.astype("<i4").tobytes() == b"".join(words[w] for w in pair.a.cut(text)) and ends.tolist() == [len(ids)]
