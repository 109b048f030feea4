"""Alignment of two tokenizers over the same texts, and how often their ids are linked in the corpus."""

from __future__ import annotations

import gc
import json
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from .byte_bpe import NONE, RAW, Encoder, Memory, Pairs, Ranks, chunk
from .common import MEMORIES, discard, materialize, tidy

#: Transitions that a worker remembers; the memory is emptied when it is full.
TRANSITIONS = 300_000
#: Chunks of more tokens of both sides walk alone, and others as long as so many walk together.
LONG, TOGETHER = 128, 64
#: Chunks, and words of A, in each of the two generations of a worker's memories. Most chunks are a word, so words are asked for only where their chunk is new.
REMEMBERED, REMEMBERED_WORDS = 240_000, 40_000
#: What stands for a chunk whose tokens don't give its bytes back; no text has as many tokens.
BROKEN = (-(1 << 40), b"", b"")
#: Keys that begin so, the empty one too, aren't a blank and a word.
ODD = ("", RAW, "\n")
#: New chunks that are aligned together.
CHUNKS = 1 << 14
#: Characters of texts that are aligned together, and bytes of groups in a batch that leaves.
CHARS = 1_000_000
#: An id pair that holds at least one in so many of all links is common: by arithmetic there are no more such pairs than this.
COMMON = 100_000


class Transducer:
    """Walks two token sequences over the same bytes.

    A state says which side leads and the bytes of its last token that the other side hasn't reached yet (the dangling
    suffix). The next token comes from the side behind; the state after it depends on the suffix and that token
    alone, so it is remembered by both. Where no suffix dangles, a group closes.
    """

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]):
        self.bytes = a_bytes, b_bytes
        self.forget()

    def forget(self) -> None:
        self.states: dict[tuple[int, bytes], int] = {(0, b""): 0}
        self.suffixes: list[tuple[int, bytes]] = [(0, b"")]
        self.next: tuple[dict[int, int], dict[int, int]] = {}, {}
        none = np.empty(0, np.int32)
        self.table, self.entered = Pairs(none, none, none, 1 << 12), 0
        self.behind = np.zeros(1024, np.int8)  # the side of the next token by state, as far as `sides` goes
        self.sides = 1

    def step(self, state: int, side: int, token: int) -> int:
        """The state after side's token; ValueError where its bytes aren't those of the suffix."""
        lead, suffix = self.suffixes[state]
        own = self.bytes[side][token]
        if not suffix:
            after = side, own
        elif len(own) < len(suffix):
            after = lead, suffix[len(own) :]
        else:
            after = side, own[len(suffix) :]
        if not (own.startswith(suffix) or suffix.startswith(own)):
            raise ValueError("the tokens' bytes differ")
        if not after[1]:
            after = 0, b""
        found = self.states.get(after)
        if found is None:
            found = self.states[after] = len(self.suffixes)
            self.suffixes.append(after)
        self.next[side][state << 20 | token] = found
        return found

    def after(self, state: np.ndarray, side: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The states of step() for many at once; what isn't remembered is worked out once for all that need it."""
        left = state << 1 | side
        out = self.table.find(left, token)
        new = np.flatnonzero(out == NONE)
        if len(new):
            keys, place = np.unique(left[new].astype(np.int64) << 20 | token[new], return_inverse=True)
            found = np.array([self.step(k >> 21, k >> 20 & 1, k & 0xF_FFFF) for k in keys.tolist()], np.int32)
            if 2 * (self.entered + len(keys)) > len(self.table.keys):
                self.table = self.table.larger(4 * (self.entered + len(keys)))
            self.table.enter((keys >> 20).astype(np.int32), (keys & 0xF_FFFF).astype(np.int32), found)
            self.entered += len(keys)
            out[new] = found[place]
            if len(self.suffixes) > len(self.behind):
                self.behind = np.concatenate([self.behind, np.zeros(max(len(self.behind), len(self.suffixes)), np.int8)])
            self.behind[self.sides : len(self.suffixes)] = [1 - lead for lead, _ in self.suffixes[self.sides :]]
            self.sides = len(self.suffixes)
        return out

    def align_all(self, a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """align() of many chunks, whose tokens stand in turn in a and b: for each step of each chunk in turn (side, token, whether a group closes
        behind it, the token of the other side that it is linked with or -1).

        Chunks walk together, a token each in a round; a chunk's n-th step has a place of its own, so that no order has to be restored.
        """
        n_a, n_b = np.diff(a_ends, prepend=0), np.diff(b_ends, prepend=0)
        total = n_a + n_b
        side, token, closes, other = np.zeros(len(a) + len(b), np.int8), np.zeros(len(a) + len(b), np.int32), np.zeros(len(a) + len(b), bool), np.full(len(a) + len(b), -1, np.int32)
        first = np.cumsum(total) - total
        alone = total > LONG
        live = np.flatnonzero((total > 0) & ~alone)
        # full tables are emptied between walks, never in one
        if self.entered + len(self.next[0]) + len(self.next[1]) > TRANSITIONS:
            self.forget()
        i, j, at, left = (a_ends - n_a)[live], (b_ends - n_b)[live], first[live], total[live]
        state = np.zeros(len(live), np.int32)
        a_or_0, b_or_0 = (np.concatenate([x, np.zeros(1, np.int32)]) for x in (a, b))
        while len(live) >= TOGETHER:
            own = self.behind[state]
            is_b = own == 1
            next_a, next_b = a_or_0[i], b_or_0[j]
            now = np.where(is_b, next_b, next_a)
            before = np.where(is_b, a_or_0[i - 1], b_or_0[j - 1])
            side[at], token[at] = own, now
            other[at] = np.where(state == 0, -1, before)
            state = self.after(state, own, now)
            shut = state == 0
            closes[at] = shut
            i, j, at, left = i + ~is_b, j + is_b, at + 1, left - 1
            if not left.all():
                stays = left > 0
                live, i, j, at, left, state = live[stays], i[stays], j[stays], at[stays], left[stays], state[stays]
        for row in chain(live.tolist(), np.flatnonzero(alone).tolist()):
            x, y = a[a_ends[row] - n_a[row] : a_ends[row]].tolist(), b[b_ends[row] - n_b[row] : b_ends[row]].tolist()
            for step, (own, now, shut, with_) in enumerate(self.walk(x, y), int(first[row])):
                side[step], token[step], closes[step], other[step] = own, now, shut, with_
        return side, token, closes, other

    def align(self, a: list[int], b: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """Where groups end, as counts of tokens of both sides so far, and all links (a id, b id) in order."""
        if len(self.next[0]) + len(self.next[1]) > TRANSITIONS:
            self.forget()
        ends, links, i, j = [], [], 0, 0
        for side, token, closes, other in self.walk(a, b):
            i, j = i + (side == 0), j + (side == 1)
            if other >= 0:
                links.append((token, other) if side == 0 else (other, token))
            if closes:
                ends.append((i, j))
        return ends, links

    def walk(self, a: list[int], b: list[int]) -> Iterator[tuple[int, int, bool, int]]:
        """The steps of one chunk, as align_all() gives them."""
        state, i, j = 0, 0, 0
        (after_a, after_b), suffixes = (x.get for x in self.next), self.suffixes
        all_a, all_b = len(a), len(b)
        while state or i < all_a or j < all_b:
            if not state or suffixes[state][0]:  # nothing dangles, or B leads: A's turn
                token = a[i]
                i += 1
                other = b[j - 1] if state else -1
                after = after_a(state << 20 | token)
                state = self.step(state, 0, token) if after is None else after
                yield 0, token, not state, other
            else:
                token = b[j]
                j += 1
                after = after_b(state << 20 | token)
                state = self.step(state, 1, token) if after is None else after
                yield 1, token, not state, a[i - 1]


class Pair:
    """Both vocabularies of a pair, and the chunks of text met so far. A is a byte-level BPE file of tokenizers, B a model of sentencepiece."""

    def __init__(self, a: str, b: str):
        import sentencepiece

        import public_tokenizers

        with open(a if "/" in a else public_tokenizers.path(a)) as state:
            self.a = Encoder(Ranks.of_tokenizer(json.load(state)), entries=REMEMBERED_WORDS)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b if "/" in b else public_tokenizers.path(b))
        tokens = self.a.ranks.tokens
        self.width = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.width)]
        if any("\n" in p or "▁" in p.strip("▁") for p in pieces):
            raise ValueError("a piece joins what stands on both sides of a blank or line feed")
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.transducer = Transducer([tokens.get(i, b"") for i in range(max(tokens) + 1)], b_bytes)
        self.blank = self.b.piece_to_id("▁")
        #: Ids as decimals with what may follow them in groups, padded with zero bytes: A's with a comma, with a bar, B's with a comma, with a semicolon.
        names = [f"{i}{mark}".encode() for n, marks in ((max(tokens) + 1, ",|"), (self.width, ",;")) for mark in marks for i in range(n)]
        self.names = np.array(names).view(np.uint8).reshape(len(names), -1)
        self.sizes = np.array([len(x) for x in names], np.int64)
        self.lengths = tuple(np.array([len(t) for t in side], np.int64) for side in self.transducer.bytes)
        self.known = Memory(REMEMBERED)

    def keys(self, text: str | None) -> list[str]:
        return [k for k in self.a.keys(" " + text) if k != RAW] if text else []

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A's ids of all chunks in turn, and where each chunk's end."""
        # a blank and ASCII letters are one match of the pattern
        cut = [[t] if t[:1] == " " and (bare := t[1:]).isascii() and bare.isalpha() else self.a.cut(t) for t in texts]
        words = list(chain.from_iterable(cut))
        long = self.a.words.learn(set(words), self.a.ranks.encode)
        rows = list(map(self.a.words.__getitem__, words))
        self.a.words.forget(long)
        sizes = np.cumsum(np.fromiter(chain((0,), map(len, rows)), np.int64, len(rows) + 1)) // 4
        return np.frombuffer(b"".join(rows), "<i4"), sizes[np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))]

    def pieces(self, keys: list[str], texts: list[str], odd: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """B's ids of all chunks in turn, and where each chunk's end. B puts a blank before all that it gets, which stands for the chunk's own or goes again."""
        bare = keys.copy()
        for i in odd:
            bare[i] = texts[i][texts[i][:1] == " " :]
        found = self.b.encode(bare, num_threads=1)
        for i in odd:
            if texts[i][:1] != " ":
                del found[i][0]
            elif len(texts[i]) == 1:
                found[i] = [self.blank]
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        return np.fromiter(chain.from_iterable(found), np.int32, int(ends[-1])), ends

    def same(self, raw: list[bytes], ids: tuple[np.ndarray, np.ndarray], ends: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Of which chunks the tokens of both sides give the bytes back."""
        whole, sizes = b"".join(raw), np.fromiter(map(len, raw), np.int64, len(raw))
        good = np.ones(len(raw), bool)
        for tokens, lengths, own, own_ends in zip(self.transducer.bytes, self.lengths, ids, ends, strict=True):
            given = np.diff(np.concatenate([[0], np.cumsum(lengths[own])])[own_ends], prepend=0)
            if (given == sizes).all() and b"".join(map(tokens.__getitem__, own.tolist())) == whole:
                continue
            for i, (lo, hi) in enumerate(zip([0, *own_ends[:-1].tolist()], own_ends.tolist(), strict=True)):
                good[i] &= b"".join(map(tokens.__getitem__, own[lo:hi].tolist())) == raw[i]
        return good

    def of(self, keys: list[str]) -> Iterator[tuple[str, tuple[int, bytes, bytes]]]:
        """Each chunk with (A's tokens, groups, links); BROKEN where the bytes of the tokens aren't the chunk's."""
        return chain.from_iterable(self._of(keys[at : at + CHUNKS]) for at in range(0, len(keys), CHUNKS))

    def _of(self, keys: list[str]) -> Iterator[tuple[str, tuple[int, bytes, bytes]]]:
        texts = [" " + k for k in keys]
        odd = [i for i, k in enumerate(keys) if k[:1] in ODD]
        for i in odd:
            texts[i] = chunk(keys[i])
        a, a_ends = self.tokens(texts)
        b, b_ends = self.pieces(keys, texts, odd)
        good = self.same([t.encode() for t in texts], (a, b), (a_ends, b_ends))
        broken = [k for k, fine in zip(keys, good.tolist(), strict=True) if not fine]
        if broken:
            keys = [k for k, fine in zip(keys, good.tolist(), strict=True) if fine]
            n_a, n_b = np.diff(a_ends, prepend=0), np.diff(b_ends, prepend=0)
            a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
            a_ends, b_ends = np.cumsum(n_a[good]), np.cumsum(n_b[good])
        side, token, closes, other = self.transducer.align_all(a, a_ends, b, b_ends)
        linked = np.flatnonzero(other >= 0)
        x, y, of_b = token[linked].astype(np.int64), other[linked].astype(np.int64), side[linked] == 1
        links = np.where(of_b, y * self.width + x, x * self.width + y).tobytes()
        step_ends = a_ends + b_ends
        link_ends = 8 * np.searchsorted(linked, step_ends)
        # in a group A's tokens come first, then B's
        shut = np.flatnonzero(closes)
        size = np.diff(shut, prepend=-1)
        start = np.repeat(shut + 1 - size, size)
        b_before = np.cumsum(side) - side
        b_in = b_before - b_before[start]
        b_all = np.repeat(b_before[shut] + side[shut] - b_before[shut + 1 - size], size)
        step = np.arange(len(side))
        is_b = side == 1
        place = np.where(is_b, np.repeat(shut + 1, size) - b_all + b_in, step - b_in)
        of = np.empty(len(side), np.int64)
        last = np.where(is_b, b_in == b_all - 1, place == np.repeat(shut, size) - b_all)
        of[place] = token + np.where(is_b, 2 * len(self.lengths[0]) + last * self.width, last * len(self.lengths[0]))
        cells = self.names[of]
        groups = cells[cells > 0].tobytes()
        group_ends = np.concatenate([[0], np.cumsum(self.sizes[of])])[step_ends]
        ends, marks = group_ends.tolist(), link_ends.tolist()
        own_groups = [groups[lo : hi - 1] for lo, hi in zip([0, *ends], ends)]  # without the last semicolon
        own_links = [links[lo:hi] for lo, hi in zip([0, *marks], marks)]
        return chain(((k, BROKEN) for k in broken), zip(keys, zip(np.diff(a_ends, prepend=0).tolist(), own_groups, own_links, strict=True), strict=True))


#: Kept between the tasks of a worker.
_KEPT: dict[tuple[str, str], Pair] = {}
MEMORIES["pairs"] = _KEPT.clear


def remembered_pair(a: str, b: str) -> Pair:
    if (a, b) not in _KEPT:
        _KEPT[a, b] = Pair(a, b)
    return _KEPT[a, b]


def align(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> DataFrame:
    """(doc_id, n_a, groups, links) of each text, with a space before it.

    groups: `a1,a2|b1;a3|b2,b3`, the ids of A and B between neighbouring places where tokens of both end; links: an element
    for each pair of tokens that share a byte, as A's id times B's vocabulary size plus B's id. Texts are split before runs of
    spaces, which both tokenizers do as well; the alignment of a chunk is remembered. No text is cut, whatever its length.

    Null or empty text, and a text whose tokens don't give its bytes back: no tokens, groups '' and no links. Null doc_id
    stays null. Empty table: no rows. Repeated rows and ids: each row for itself. Other columns are ignored.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = remembered_pair(a, b)

        def flush(held: list[tuple[int | None, list[str]]]) -> pa.RecordBatch:
            gc.disable()  # nothing here goes in circles: the collector would only walk all that is remembered, again and again
            try:
                long = pair.known.learn(set(chain.from_iterable(map(itemgetter(1), held))), pair.of)
            finally:
                gc.enable()
            look = pair.known.__getitem__
            counts, groups, links = [], [], []
            for _, keys in held:
                found = list(map(look, keys))
                n = sum(map(itemgetter(0), found))
                if n < 0:
                    n, found = 0, []
                counts.append(n)
                groups.append(b";".join(map(itemgetter(1), found)))
                links.append(b"".join(map(itemgetter(2), found)))
            pair.known.forget(long)
            ends = np.cumsum([0, *(len(x) // 8 for x in links)])
            keys = pa.array(np.frombuffer(b"".join(links), "<i8"))
            text = pa.array(groups, pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([pa.array([i for i, _ in held], pa.int64()), pa.array(counts, pa.int64()), text, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), keys)], names=["doc_id", "n_a", "groups", "links"])

        held, chars = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                held.append((doc_id, pair.keys(text)))
                chars += len(text or "")
                if chars >= CHARS:
                    yield flush(held)
                    held, chars = [], 0
        if held:
            yield flush(held)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run, "pairs"), "doc_id long, n_a long, groups string, links array<long>")


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, n) of a column links: how many links of the whole corpus hold each pair.

    Tasks count their own batches first, so a pair that many documents hold reaches the shuffle once for each batch.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, n = np.unique(batch.column(0).flatten().to_numpy(zero_copy_only=False), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.int64()), pa.array(n, pa.int64())], names=["pair", "n"])

    return links.select("links").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def score(aligned: DataFrame, b: str = "piece_bpe_32k.model", common: int = COMMON) -> DataFrame:
    """aligned (with a column links) and n_links, n_best, count_sum: by how often the whole corpus holds each link's pair.

    n_best: links whose pair is the commonest of its B id, ties included; count_sum: the pairs' counts, over the links. Pairs that
    hold one in `common` of all links, of which there can be no more than `common`, go to every task; so the others, each
    with a small share of the links, meet their counts by a shuffle that has no hot key.

    Rows without links get zeros. Repeated rows: each for itself. Empty table: no rows.
    """
    spark = aligned.sparkSession
    ship(spark)
    width = vocabulary_size(b)
    rows = materialize(aligned.withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = materialize(pair_counts(rows), "pairs")
    highest = counts.groupBy((F.col("pair") % width).alias("b_id")).agg(F.max("n").alias("most"))  # a row for each id of B at most
    told = materialize(counts.withColumn("b_id", F.col("pair") % width).join(highest, "b_id").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "told")
    total = told.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * common >= total
    sent = told.where(often).orderBy("pair").toPandas()
    table = spark.sparkContext.broadcast((sent["pair"].to_numpy(np.int64), sent["n"].to_numpy(np.int64), sent["best"].to_numpy(bool)))
    kept = [c for c in aligned.columns if c != "links"]
    schema = "row long, pair long, times long, n_links long, n_best long, count_sum long"

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = table.value
        for batch in batches:
            ends = np.concatenate([[0], np.cumsum(batch.column("links").value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            links = batch.column("links").flatten().to_numpy(zero_copy_only=False)
            at = np.searchsorted(pairs, links)
            hit = at < len(pairs)
            hit[hit] = pairs[at[hit]] == links[hit]
            sums = np.zeros((2, len(links) + 1), np.int64)
            sums[0, 1:][hit] = best[at[hit]]
            sums[1, 1:][hit] = n[at[hit]]
            sums = sums.cumsum(1)
            row = batch.column("row").to_numpy()
            rest = ~hit
            other = np.repeat(np.arange(len(row)), np.diff(ends))[rest]
            order = np.lexsort((links[rest], other))
            o, p = other[order], links[rest][order]
            first = np.ones(len(o), bool)
            first[1:] = (o[1:] != o[:-1]) | (p[1:] != p[:-1])
            starts = np.flatnonzero(first)
            times = np.diff(starts, append=len(o))
            zero = np.zeros(len(starts), np.int64)
            own = [row, -1 - row, np.zeros(len(row), np.int64), np.diff(ends), np.diff(sums[0][ends]), np.diff(sums[1][ends])]
            parts = [row[o[starts]], p[starts], times, zero, zero, zero]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(own, parts, strict=True)], names=["row", "pair", "times", "n_links", "n_best", "count_sum"])

    looked = rows.select("row", "links").mapInArrow(tidy(look, "pairs"), schema)
    others = told.where(~often)
    summed = (
        looked.join(others, "pair", "left").groupBy("row")
        .agg(F.sum("n_links").alias("n_links"), F.sum(F.col("n_best") + F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("count_sum") + F.coalesce(F.col("times") * F.col("n"), F.lit(0))).alias("count_sum"))
    )
    out = materialize(rows.drop("links").join(summed, "row").select(*kept, "n_links", "n_best", "count_sum"), "scored")
    table.unpersist()
    discard(rows, counts, told)
    return out


def vocabulary_size(b: str) -> int:
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=b if "/" in b else public_tokenizers.path(b)).get_piece_size()
