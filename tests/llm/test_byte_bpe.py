"""Byte-level BPE against the tiktoken library, and back to bytes."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from skeinlake.llm import byte_bpe, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", params=["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def both(request):
    table = byte_bpe.remembered_encoder(request.param).ranks
    return table, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table.ids, special_tokens={})


def test_words_of_every_width_equal_the_library(both):
    table, library = both
    draw = random.Random(3)
    alphabets = ("ab", "a", "etaoinshrdlu", "éüßあ漢字", "0123456789", "\n\t ", "  ", "🙂👩‍💻")
    words = sorted({"".join(draw.choice(a) for _ in range(n)) for n in (1, 2, 3, 4, 5, 8, 9, 31, 64, 127, 128, 129, 700) for a in alphabets for _ in range(8)})
    got = dict(table.encode(words))
    assert {w: np.frombuffer(got[w], "<i4").tolist() for w in words} == {w: library._encode_single_piece(w) for w in words}


def joined(table, cells, length):
    ids, sizes = table.join_rows(cells, np.array([length]))
    return ids[0, : sizes[0]].tolist()


def test_long_rows_and_matrices_agree(both):
    table, _ = both
    draw = random.Random(5)
    for _ in range(200):
        raw = bytes(draw.choice(b"aabcde the") for _ in range(draw.randrange(1, 120)))
        row = table.bytes[np.frombuffer(raw, np.uint8)]
        cells = np.zeros((1, 128), np.int32)
        cells[0, : len(raw)] = row
        assert table.join_long(row.copy()).tolist() == joined(table, cells, len(raw))


def test_a_rank_file_whose_joined_token_starts_a_lower_pair():
    """Joining bc (rank 9) makes a, bc a pair of rank 8, which goes before the next bc."""
    plain = [bytes([b]) for b in range(256)]
    tokens = [*plain, b"abc", b"bc", b"xa"]
    table = byte_bpe.Ranks.of_file(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens))
    library = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=table.ids, special_tokens={})
    assert table.early == {table.ids[b"bc"]}
    for text in ("bcbcabcbc" * 40, "abcxabcbc" * 40, "xabcabc", "bcbcbc"):
        row = table.bytes[np.frombuffer(text.encode(), np.uint8)]
        assert table.join_long(row).tolist() == library.encode_ordinary(text)


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 5)
    byte_bpe.MEMORIES["ranks"]()
    texts = [None, "", " ", "it's  the\n\n end \t", "<|endoftext|>", "漢字" * 4000, "the the", "the the", "\x00\x85 ", "x" * 5000, "\n a", " \n\nb", "a\n\n b\tc d ", "\n", "a\nb", "a \nb", "\u3000 x", "a\x85 b"]
    rows = [(i, t, "extra", 1) for i, t in enumerate(texts)] + [(None, "no id", "extra", 2), (3, "same id", "extra", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int")
    table = byte_bpe.remembered_encoder("byte_bpe_50k.tiktoken").ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table.ids, special_tokens={})
    got = sorted((r.doc_id is None, r.doc_id, r.ids, bytes(r.decoded)) for r in byte_bpe.decode(byte_bpe.encode(docs)).collect() if r.doc_id is not None)
    assert got == sorted((False, i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t, _, _ in rows if i is not None)
    assert byte_bpe.encode(docs.where("doc_id is null")).count() == 1
    assert byte_bpe.decode(byte_bpe.encode(docs.limit(0))).count() == 0
    assert byte_bpe.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")).collect()[0].decoded is None


def test_query_against_the_library(spark):
    table = byte_bpe.remembered_encoder("byte_bpe_50k.tiktoken").ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table.ids, special_tokens={})
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op12_byte_bpe(spark, SF).collect()}
    wanted = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        text = r.text or ""
        ids = library.encode_ordinary(text)
        wanted[r.doc_id] = len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()
    assert got == wanted
