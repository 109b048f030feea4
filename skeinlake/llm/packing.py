"""Best-fit packing of tokenised documents by minimum bin slack."""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import ship
from .common import MEMORIES, materialize, tidy

CAPACITY = 4096
#: Runs, and words in them, that a worker remembers with their ids; a memory is emptied when it is full.
REMEMBERED = 300_000
#: Marks that the tokenizer keeps together after a word, apart from it.
MARKS = ".,;:!?%*&$#"


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Ids(dict):
    """Ids of a run of non-blank characters, as little-endian 32-bit bytes.

    The tokenizer drops white space and never joins what stands on both sides of it, so the ids
    of a text are those of its runs in turn. A run of letters with marks after them goes to
    the vocabulary's merges at once, without the normaliser, which would leave it as it is but for its case; all
    other runs take the whole way.
    """

    letters = _byte_letters()

    def __init__(self, tokenizer):
        super().__init__({"": b""})
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.words: dict[str, bytes] = {}
        state = json.loads(tokenizer.to_str())
        kinds = [n["type"] for n in (state.get("normalizer") or {}).get("normalizers", [])]
        self.direct = kinds == ["NFC", "Replace", "Lowercase"] and state["model"].get("end_of_word_suffix") == "</w>"

    def word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            if len(self.words) >= REMEMBERED:
                self.words.clear()
            tokens = self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))
            found = self.words[word] = np.array([t.id for t in tokens], dtype="<u4").tobytes()
        return found

    def __missing__(self, run: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
            self[""] = b""
        head = run.rstrip(MARKS)
        small = head.lower()
        if self.direct and len(run) <= 64 and small.isalpha() and head.isalpha() and "\u03a3" not in head and (small.isascii() or unicodedata.is_normalized("NFC", small)):
            ids = self.word(small) + (self.word(run[len(head) :]) if len(head) < len(run) else b"")
        else:
            ids = np.asarray(self.tokenizer.encode(run, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(run) <= 64:
            self[run] = ids
        return ids


#: Kept between the tasks of a worker.
_KEPT: dict[str, _Ids] = {}
MEMORIES["ids"] = _KEPT.clear


def remembered_ids(name_or_path: str) -> _Ids:
    if name_or_path not in _KEPT:
        _KEPT[name_or_path] = _Ids(load_tokenizer(name_or_path))
    return _KEPT[name_or_path]


def load_tokenizer(name_or_path: str):
    """A tokenizer file by its path, or by its name among the installed public vocabularies."""
    from tokenizers import Tokenizer

    if "/" not in name_or_path:
        import public_tokenizers

        name_or_path = public_tokenizers.path(name_or_path)
    return Tokenizer.from_file(name_or_path)


def text_ids(text: str, ids: _Ids) -> bytes:
    """All ids of a text. Only blanks, tabs, line feeds and carriage returns part it, so other white space reaches the tokenizer."""
    return b"".join(map(ids.__getitem__, text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))


def pieces(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of each document, cut only where it is longer than capacity.

    A null text counts as empty and gives the end id alone. A null doc_id stays null.
    """

    ship(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = remembered_ids(tokenizer)
        end = np.asarray([end_id], dtype="<u4").tobytes()
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                whole = text_ids(text.as_py() or "", ids) + end
                for piece, at in enumerate(range(0, len(whole), 4 * capacity)):
                    part = whole[at : at + 4 * capacity]
                    for column, value in zip(out, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), part), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)][: 6 if with_ids else 5], names=list(names[: 6 if with_ids else 5]))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(cut, "ids"), schema)


def fullest(lengths: list[int], counts: list[int], room: int) -> list[tuple[int, int]]:
    """(length, how many) of the combination that fills room best: subset sums in the bits of one integer.

    lengths fall. After each copy the reachable sums are kept, so the way back is read off.
    """
    reach, mask, trail = 1, (1 << room + 1) - 1, []
    for length, count in zip(lengths, counts, strict=True):
        for _ in range(min(count, room // length) if length <= room else 0):
            after = (reach | reach << length) & mask
            if after == reach:
                break
            trail.append((length, reach))
            reach = after
        if reach >> room:
            break
    left, chosen = reach.bit_length() - 1, {}
    for length, before in reversed(trail):
        if not before >> left & 1:
            chosen[length] = chosen.get(length, 0) + 1
            left -= length
    return list(chosen.items())


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(repeats, [(length, how many)]) until every piece of the histogram has a bin.

    Minimum bin slack with a fixed seed: the longest piece that is left opens the bin, the fullest
    combination of the others is removed with it. The same combination is taken as often as the
    counts allow, so the work depends on the capacity and not on the number of pieces.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    out = []
    while left:
        lengths = sorted(left, reverse=True)
        seed = lengths[0]
        counts = [left[n] - (n == seed) for n in lengths]
        use = dict(fullest(lengths, counts, capacity - seed)) if capacity > seed else {}
        use[seed] = use.get(seed, 0) + 1
        times = min(left[n] // k for n, k in use.items())
        out.append((times, sorted(use.items(), reverse=True)))
        for n, k in use.items():
            left[n] -= times * k
            if not left[n]:
                del left[n]
    return out


def _slots(plan: list[tuple[int, list[tuple[int, int]]]], capacity: int) -> dict[int, np.ndarray]:
    """By length: rows (first rank, copies in a bin, first bin, offset of the first copy), ranks rising."""
    used = [0] * (capacity + 1)
    rows: dict[int, list] = {}
    first = 0
    for times, combination in plan:
        offset = 0
        for length, copies in combination:
            rows.setdefault(length, []).append((used[length], copies, first, offset))
            used[length] += times * copies
            offset += length * copies
        first += times
    return {n: np.asarray(r, dtype=np.int64) for n, r in rows.items()}


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Packs all documents into sequences of at most capacity tokens; one row per piece.

    Pieces are cut and counted by length; the histogram has at most capacity rows, whatever the
    corpus, and is all that the driver sees. It plans the bins; each piece then finds its own by its
    rank among the pieces of its length. Ranks come from counts by length and salt, so that
    a length that a third of all pieces share is spread over all salts.

    Null text: empty, a piece of the end id alone. Empty table: no rows. Repeated rows and doc_ids:
    each row is packed. Other columns are ignored. Which of several pieces of one length
    takes which place follows their doc_id, piece and checksum.
    """
    cut = materialize(pieces(docs, tokenizer, end_id, capacity, with_ids), "pieces")
    salts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    by_salt = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialize(by_salt.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "bases")
    histogram = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = _slots(plan_bins(histogram, capacity), capacity)

    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(bases.drop("n"), ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("base")).select(*cut.columns, "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                s = slots[int(n)]
                own = s[np.searchsorted(s[:, 0], rank[at], side="right") - 1]
                nth = rank[at] - own[:, 0]
                sequence[at] = own[:, 2] + nth // own[:, 1]
                offset[at] = own[:, 3] + nth % own[:, 1] * n
            kept = [c for i, c in enumerate(batch.columns) if batch.schema.names[i] != "rank"]
            names = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "") + ", sequence_id long, offset long"
    return ranked.mapInArrow(tidy(place, "ids"), schema)
