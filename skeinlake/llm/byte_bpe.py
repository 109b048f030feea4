"""Byte-level BPE: texts to ids by rank files, and ids back to bytes."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable, Iterator
from itertools import filterfalse, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from .common import MEMORIES, tidy
from .packing import _byte_letters

#: Rank of a pair that no token joins.
NONE = np.iinfo(np.int32).max
#: Matrices hold rows of up to so many bytes, padded to the next of these widths; longer rows stand alone.
WIDTHS = (4, 8, 16, 32, 64, 128)
#: Cells of a matrix.
CELLS = 1 << 20
#: Entries of each of the two generations of a worker's memory; longer texts than LONG are forgotten at once.
REMEMBERED, LONG = 250_000, 64
#: Stands before a chunk that has no blank of its own; no text can hold it.
RAW = "\ud800"
#: Characters of texts whose new words are encoded together, and ids in a batch that leaves.
CHARS, IDS = 2_000_000, 1_000_000


class Memory(dict):
    """What has been worked out for short strings. When it is full, what wasn't asked for since it was full before goes."""

    def __init__(self, entries: int | None = None):
        super().__init__()
        self.before: dict = {}
        self.entries = REMEMBERED if entries is None else entries

    def learn(self, asked: set[str], work: Callable[[list[str]], Iterable[tuple[str, object]]]) -> list[str]:
        """Has all that is asked for afterwards; the long strings among it, which forget() should get once they are used."""
        # what is asked for is looked up; taking a view of keys from a set would walk all that is remembered
        new = set(filterfalse(self.__contains__, asked))
        again = set(filter(self.before.__contains__, new))
        self.update((w, self.before[w]) for w in again)
        new -= again
        if len(self) + len(new) > self.entries:
            self.before = dict(self)
            self.clear()
            self.update((w, self.before[w]) for w in asked - new)
        self.update(work(list(new)))
        return [w for w in new if len(w) > LONG]

    def forget(self, words: list[str]) -> None:
        for w in words:
            del self[w]


def chunks(text: str, odd: Callable[[str], object], split: Callable[[str], list[str]]) -> list[str]:
    """text in pieces that begin with a blank or line feed after something else than white space, as keys: without the blank.

    Byte-level patterns and vocabularies of pieces with leading blanks both part a text at these places.
    """
    if odd(text):
        return [RAW + c for c in split(text)]
    parts = text.replace("\n", " \n").split(" ")
    parts[0] = RAW + parts[0]
    return parts


def chunk(key: str) -> str:
    return key[1:] if key[:1] == RAW else key if key[:1] == "\n" else " " + key


class Pairs:
    """A hash table of open addresses from two neighbouring ids to the id that joins them."""

    FREE = np.uint64(0xFFFF_FFFF_FFFF_FFFF)

    def __init__(self, left: np.ndarray, right: np.ndarray, joined: np.ndarray, room: int = 0):
        bits = max(4, int(max(len(left) * 2, room) + 1).bit_length())
        self.mask, self.shift = np.uint64((1 << bits) - 1), np.uint64(64 - bits)
        self.keys = np.full(1 << bits, self.FREE)
        self.values = np.full(1 << bits, NONE, np.int32)
        self.enter(left, right, joined)

    def enter(self, left: np.ndarray, right: np.ndarray, joined: np.ndarray) -> None:
        keys = self._key(left, right)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[slot[todo]] == self.FREE
            self.keys[slot[todo[free]]] = keys[todo[free]]  # of several for one slot the last stays
            placed = self.keys[slot[todo]] == keys[todo]
            self.values[slot[todo[placed]]] = joined[todo[placed]]
            todo = todo[~placed]
            slot[todo] = slot[todo] + np.uint64(1) & self.mask

    def larger(self, room: int) -> Pairs:
        """The same pairs with room for more."""
        used = self.keys != self.FREE
        keys = self.keys[used]
        return Pairs((keys >> np.uint64(32)).astype(np.int32), (keys & np.uint64(0xFFFF_FFFF)).astype(np.int32), self.values[used], room)

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return keys * np.uint64(0x9E37_79B9_7F4A_7C15) >> self.shift

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The joined ids, NONE where there is none."""
        keys = self._key(left, right)
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], NONE)
        todo = np.flatnonzero((found != keys) & (found != self.FREE))
        while len(todo):
            slot[todo] = slot[todo] + np.uint64(1) & self.mask
            found = self.keys[slot[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (found != self.FREE)]
        return out


class Ranks:
    """Tokens by their bytes, and the pairs that make them; a pair's rank is the id of what it makes.

    merges: the only pairs that join, (left id, right id, id); without, all whose bytes are a token, which whole words
    are looked up for as well.
    """

    def __init__(self, ids: dict[bytes, int], merges: list[tuple[int, int, int]] | None = None):
        self.ids = ids
        self.tokens = {rank: token for token, rank in ids.items()}
        self.bytes = np.array([ids[bytes([b])] for b in range(256)], np.int32)
        self.words = ids if merges is None else {}
        if merges is None:
            merges = [(ids[t[:i]], ids[t[i:]], rank) for t, rank in ids.items() for i in range(1, len(t)) if t[:i] in ids and t[i:] in ids]
        left, right, joined = np.array(merges or [(0, 0, NONE)], np.int32).T
        self.pairs = Pairs(left, right, joined)
        #: Ids that are part of a token of lower rank: joining one may bring a pair that goes before its equals.
        long = np.array([len(self.tokens.get(i, b"")) > 1 for i in range(max(self.tokens) + 1)])
        self.early = {int(x) for part in (left, right) for x in part[(part > joined) & long[part]]}

    @classmethod
    def of_file(cls, lines: Iterable[bytes]) -> Ranks:
        return cls({base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())})

    @classmethod
    def of_tokenizer(cls, state: dict) -> Ranks:
        """Of the JSON of a byte-level BPE tokenizer, whose special tokens are left out."""
        model, letters = state["model"], {letter: b for b, letter in _byte_letters().items()}
        raw = lambda token: bytes(map(letters.__getitem__, token))
        special = {t["content"] for t in state["added_tokens"]}
        ids = {raw(token): i for token, i in model["vocab"].items() if token not in special}
        pairs = [tuple(map(raw, m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        merges = [(ids[left], ids[right], ids[left + right]) for left, right in pairs]
        if any(before[2] >= after[2] for before, after in pairwise(merges)):
            raise ValueError("the merges' order isn't that of their ids")
        return cls(ids, merges)

    def join_long(self, row: np.ndarray) -> np.ndarray:
        """One row of any length. Equal pairs are joined in one round, left to right, but where a joined id may start a pair of lower rank."""
        ranks = self.pairs.find(row[:-1], row[1:])
        while len(ranks) and (least := int(ranks.min())) != NONE:
            at = np.flatnonzero(ranks == least)
            if least in self.early:
                at = at[:1]
            else:  # in a run of neighbours every second one
                starts = np.flatnonzero(np.diff(at, prepend=-2) != 1)
                at = at[(np.arange(len(at)) - np.repeat(starts, np.diff(starts, append=len(at)))) % 2 == 0]
            row[at] = least
            stays = np.ones(len(row), bool)
            stays[at + 1] = False
            row = row[stays]
            at -= np.arange(len(at))
            ranks = ranks[stays[1:]] if len(row) > 1 else ranks[:0]
            again = np.unique(np.concatenate([at - 1, at]))
            again = again[(again >= 0) & (again < len(row) - 1)]
            ranks[again] = self.pairs.find(row[again], row[again + 1])
        return row

    def join_rows(self, cells: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the rows of a padded matrix, and how many. Each round joins the leftmost pair of least rank in every row; rows without one leave."""
        done, sizes = np.zeros_like(cells), lengths.copy()
        name, columns = np.arange(len(cells)), np.arange(cells.shape[1])
        ranks = np.full(cells.shape, NONE, np.int32)
        row, column = np.nonzero(columns[None, :] < lengths[:, None] - 1)
        ranks[row, column] = self.pairs.find(cells[row, column], cells[row, column + 1])
        while len(cells):
            at = ranks.argmin(1)
            least = ranks[np.arange(len(cells)), at]
            over = least == NONE
            if over.any():
                done[name[over], : cells.shape[1]] = cells[over]
                sizes[name[over]] = lengths[over]
                keep = ~over
                if not keep.any():
                    break
                widest = int(lengths[keep].max())
                cells, ranks, columns = cells[keep, :widest], ranks[keep, :widest], columns[:widest]
                lengths, name, at, least = lengths[keep], name[keep], at[keep], least[keep]
            rows = np.arange(len(cells))
            cells[rows, at] = least
            moved = np.minimum(columns[None, :] + (columns[None, :] > at[:, None]), len(columns) - 1)
            cells = np.take_along_axis(cells, moved, 1)
            ranks = np.take_along_axis(ranks, moved, 1)
            lengths = lengths - 1
            ranks[rows, lengths - 1] = NONE
            for put in (at - 1, at):
                i = np.flatnonzero((put >= 0) & (put < lengths - 1))
                ranks[i, put[i]] = self.pairs.find(cells[i, put[i]], cells[i, put[i] + 1])
        return done, sizes

    def encode(self, words: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """Each word with its ids, as little-endian 32-bit bytes."""
        buckets: dict[int, list[tuple[str, bytes]]] = {w: [] for w in WIDTHS}
        bucket = [buckets[next(w for w in WIDTHS if w >= n)] for n in range(WIDTHS[-1] + 1)]
        for word in words:
            raw = word.encode()
            if raw in self.words:
                yield word, self.words[raw].to_bytes(4, "little")
            elif len(raw) > WIDTHS[-1]:
                yield word, self.join_long(self.bytes[np.frombuffer(raw, np.uint8)]).astype("<i4").tobytes()
            else:
                bucket[len(raw)].append((word, raw))
        for width, members in buckets.items():
            for i in range(0, len(members), CELLS // width):
                part = members[i : i + CELLS // width]
                lengths = np.array([len(raw) for _, raw in part])
                cells = self.bytes[np.frombuffer(b"".join([raw.ljust(width, b"\0") for _, raw in part]), np.uint8)].reshape(len(part), width)
                ids, sizes = self.join_rows(cells, lengths)
                flat, step = ids.astype("<i4").tobytes(), 4 * width
                for at, ((word, _), size) in enumerate(zip(part, (4 * sizes).tolist(), strict=True)):
                    yield word, flat[at * step : at * step + size]


class Encoder:
    """A vocabulary, the pattern that cuts texts, and the chunks and words met so far."""

    def __init__(self, ranks: Ranks, pattern: str | None = None, entries: int | None = None):
        import public_tokenizers
        import regex

        self.ranks = ranks
        self.words, self.chunks = Memory(entries), Memory(entries)
        self.cut = regex.compile(public_tokenizers.PATTERN if pattern is None else pattern).findall
        # a pattern of one's own may join what the public one parts, so its texts aren't split before
        self.odd = regex.compile(r"\s[ \n]").search if pattern is None else lambda text: True
        self.split = regex.compile(r"(?<=\S)(?=[ \n])").split if pattern is None else lambda text: [text]

    def keys(self, text: str) -> list[str]:
        return chunks(text, self.odd, self.split) if text else []

    def of(self, keys: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each chunk with its ids: those of its words."""
        cut = [(k, self.cut(chunk(k))) for k in keys]
        long = self.words.learn({w for _, words in cut for w in words}, self.ranks.encode)
        look = self.words.__getitem__
        for k, words in cut:
            yield k, look(words[0]) if len(words) == 1 else b"".join(map(look, words))
        self.words.forget(long)


#: Kept between the tasks of a worker.
_KEPT: dict[tuple[str, str | None], Encoder] = {}
MEMORIES["ranks"] = _KEPT.clear


def remembered_encoder(name_or_path: str, pattern: str | None = None) -> Encoder:
    """A rank file by its path, or by its name among the installed public vocabularies, and what was met so far."""
    found = _KEPT.get((name_or_path, pattern))
    if found is None:
        path = name_or_path
        if "/" not in path:
            import public_tokenizers

            path = public_tokenizers.path(path)
        with open(path, "rb") as lines:
            found = _KEPT[name_or_path, pattern] = Encoder(Ranks.of_file(lines), pattern)
    return found


def encode(docs: DataFrame, ranks: str = "byte_bpe_50k.tiktoken", pattern: str | None = None) -> DataFrame:
    """(doc_id, ids) of every text: each match of pattern by itself, no special tokens.

    New words of a batch are encoded together, in padded matrices by length; words met before come from a
    bounded memory. A text is never cut, whatever its length; a match of over 128 bytes is a row of its own.

    Null text: as empty, no ids. Null doc_id stays null. Empty table: no rows. Repeated rows and ids: each row
    for itself. Ties between pairs go to the leftmost. Other columns, whatever their names, are ignored.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = remembered_encoder(ranks, pattern)

        def flush(held: list[tuple[int | None, list[str]]]) -> pa.RecordBatch:
            long = encoder.chunks.learn({k for _, keys in held for k in keys}, encoder.of)
            look = encoder.chunks.__getitem__
            rows = [b"".join(map(look, keys)) for _, keys in held]
            encoder.chunks.forget(long)
            ids = pa.array(np.frombuffer(b"".join(rows), "<i4"))
            ends = np.cumsum([0, *(len(r) // 4 for r in rows)])
            return pa.RecordBatch.from_arrays([pa.array([i for i, _ in held], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)], names=["doc_id", "ids"])

        held, chars = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                held.append((doc_id, encoder.keys(text)))
                chars += len(text)
                if chars >= CHARS:
                    yield flush(held)
                    held, chars = [], 0
        if held:
            yield flush(held)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run, "ranks"), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """encoded (doc_id, ids) with the bytes that the ids stand for, as decoded.

    Null ids: null. An id that the rank file lacks is an error. Rows stay as they are, repeated ones too.
    """
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = remembered_encoder(ranks).ranks.tokens.__getitem__
        for whole in batches:
            ends = np.cumsum([0, *whole.column(1).value_lengths().fill_null(0).to_pylist()])
            at = 0
            while at < whole.num_rows:  # some rows at a time, one at least
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + IDS)))
                batch = whole.slice(at, min(to, whole.num_rows) - at)
                at += batch.num_rows
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).tolist()
                first, texts = 0, []
                for n in batch.column(1).value_lengths().to_pylist():
                    texts.append(None if n is None else b"".join(map(tokens, flat[first : first + n])))
                    first += n or 0
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(tidy(run, "ranks"), "doc_id long, ids array<int>, decoded binary")
