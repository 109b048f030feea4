"""Benchmark decontamination: n-gram seeds, the rare ones on their own and the common ones behind an exact bound, then Smith-Waterman alignment."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from .common import shield, tidy
from pyspark.sql import types as T

#: Characters of benchmark text that one pass over the documents looks for; a larger benchmark takes several passes.
BLOCK_CHARS = 16 << 20
SEED_WORDS = 4
#: Items of fewer words than a seed can't be told from chance and are not looked for;
LEAST_WORDS = SEED_WORDS
#: those of fewer words than this count only where all of their words stand in their order.
SHORT_WORDS = 8
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of an item's own score that an alignment reaches at least.
THRESHOLD = 0.5

_WORD = re.compile(r"\w+")
HIT = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def local_alignment(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """(score, end in passage) of the best Smith-Waterman alignment, row by row; the running maximum spreads gaps along a row."""
    n = len(passage)
    slope = np.arange(n + 1) * -GAP
    row = np.zeros(n + 1, np.int64)
    best, end = 0, 0
    for w in item:
        fresh = np.maximum(row + GAP, 0)
        fresh[1:] = np.maximum(fresh[1:], row[:-1] + np.where(passage == w, MATCH, MISMATCH))
        row = np.maximum.accumulate(fresh + slope) - slope
        top = int(row.max())
        if top > best:
            best, end = top, int(row.argmax())
    return best, end


@dataclass
class Items:
    """A block of benchmark items: their words as numbers, and the sorted codes of their seeds."""

    ids: list[int]
    texts: list[np.ndarray]
    vocabulary: dict[str, int]
    codes: np.ndarray  # sorted; one for each seed occurrence
    owner: np.ndarray
    place: np.ndarray
    rare: np.ndarray  # whether the seed is rare for its item, see marked()

    @classmethod
    def of(cls, ids: list[int], texts: list[str]) -> Items:
        vocabulary: dict[str, int] = {}
        held, kept = [], []
        for i, t in zip(ids, texts, strict=True):
            own = words(t or "")
            if i is not None and len(own) >= LEAST_WORDS:
                kept.append(i)
                held.append(np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in own], np.uint64))
        each = [seed_codes(x) for x in held]
        codes = np.concatenate(each) if each else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(held)), [len(c) for c in each]) if each else np.empty(0, np.int64)
        place = np.concatenate([np.arange(len(c)) for c in each]) if each else np.empty(0, np.int64)
        order = np.argsort(codes, kind="stable")
        return cls(kept, held, vocabulary, codes[order], owner[order], place[order], np.ones(len(codes), bool))

    def numbers(self, text: str) -> np.ndarray:
        own = words(text)
        return np.fromiter(map(self.vocabulary.get, own, repeat(0)), np.uint64, len(own))

    def marked(self, frequency: dict[int, int]) -> Items:
        """With rare set for the seeds at most twice as frequent in the corpus as the median seed of the item that occurs at all.

        The measure is the item's own, so that an item that has leaked everywhere has rare seeds. No seed goes: at the common ones, find() asks
        for enough words of the item before it aligns.
        """
        df = np.array([frequency.get(int(c), 0) for c in self.codes.view(np.int64)], np.int64)
        limit = np.zeros(len(self.ids))
        seen = df > 0
        order = np.argsort(self.owner[seen], kind="stable")
        own, first = np.unique(self.owner[seen][order], return_index=True)
        for i, part in zip(own, np.split(df[seen][order], first[1:]), strict=False):
            limit[i] = 2 * float(np.median(part))
        return Items(self.ids, self.texts, self.vocabulary, self.codes, self.owner, self.place, df <= limit[self.owner])


def seed_codes(numbers: np.ndarray) -> np.ndarray:
    """A 64-bit code for each run of SEED_WORDS numbers; 0 where one of them is no word of the block."""
    if len(numbers) < SEED_WORDS:
        return np.empty(0, np.uint64)
    n = len(numbers) - SEED_WORDS + 1
    code, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for i in range(SEED_WORDS):
        part = numbers[i : i + n]
        known &= part > 0
        code = (code ^ part) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
    return np.where(known, code | np.uint64(1), np.uint64(0))


def _seeds_in(items: Items, text: str, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, places of known seeds) of a text."""
    numbers = items.numbers(text)
    codes = seed_codes(numbers)
    at = np.flatnonzero(codes)
    if len(at):
        p = np.minimum(np.searchsorted(distinct, codes[at]), len(distinct) - 1)
        at = at[distinct[p] == codes[at]]
    return numbers, at


def _enough(there: np.ndarray, threshold: float) -> bool:
    """Whether an item's words that are there could make an alignment that counts: each adds MATCH at most, so no such alignment is lost."""
    return np.count_nonzero(there) >= threshold * len(there)


def find(items: Items, text: str, distinct: np.ndarray, threshold: float = THRESHOLD) -> list[dict]:
    """The items that a text holds copies of, with the best alignment's score and its place in code points."""
    if not len(distinct):
        return []
    numbers, at = _seeds_in(items, text, distinct)
    if not len(at):
        return []
    codes = seed_codes(numbers)[at]
    lo, sizes = np.searchsorted(items.codes, codes, "left"), np.searchsorted(items.codes, codes, "right")
    sizes -= lo
    k = np.arange(sizes.sum()) + np.repeat(lo - (np.cumsum(sizes) - sizes), sizes)
    owner, begins, rare = items.owner[k], np.repeat(at, sizes) - items.place[k], items.rare[k]
    order = np.lexsort((begins, owner))
    owner, begins, rare = owner[order], begins[order], rare[order]
    own, first = np.unique(owner, return_index=True)
    present = np.zeros(len(items.vocabulary) + 1, bool)
    present[numbers] = True
    out, spans = [], None
    for i, f, t in zip(own.tolist(), first, [*first[1:], len(owner)], strict=True):
        item = items.texts[i]
        m = len(item)
        needed = 1.0 if m < SHORT_WORDS else threshold
        if not rare[f:t].any() and not _enough(present[item], needed):
            continue
        best = (0, 0, 0)
        edges = [f, *(np.flatnonzero(np.diff(begins[f:t]) > m) + f + 1), t]
        for x, y in pairwise(edges):
            lo, hi = max(0, int(begins[x]) - m // 2), min(len(numbers), int(begins[y - 1]) + m + m // 2 + 1)
            if not rare[x:y].any() and not _enough(np.isin(item, numbers[lo:hi]), needed):
                continue
            score, end = local_alignment(item, numbers[lo:hi])
            if score > best[0]:
                best = (score, lo, lo + end)
        if best[0] >= needed * MATCH * m:
            back, length = local_alignment(item[::-1], numbers[best[1] : best[2]][::-1])
            spans = spans or [w.span() for w in _WORD.finditer(text.lower())]
            first = best[2] - length if back == best[0] else best[1]
            out.append({"item_id": items.ids[i], "score": best[0] / (MATCH * m), "start": min(spans[first][0], len(text)), "end": min(spans[best[2] - 1][1], len(text))})
    return sorted(out, key=lambda h: (-h["score"], h["item_id"]))


def blocks(docs: DataFrame, benchmark: DataFrame) -> list[Items]:
    """The benchmark in blocks of about BLOCK_CHARS characters, each with its seeds and which of them are rare by their document frequency in all docs."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("t")).where("item_id is not null and t is not null").distinct()
    total = rows.agg(F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("c")).first()["c"]
    k = max(1, math.ceil(total / BLOCK_CHARS))
    out = []
    for b in range(k):
        own = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(k)) == b).orderBy("item_id", "t").collect()  # bounded by BLOCK_CHARS
        items = Items.of([r["item_id"] for r in own], [r["t"] for r in own])
        if not items.ids:
            continue
        distinct = np.unique(items.codes)

        def count(batches: Iterator[pa.RecordBatch], items=items, distinct=distinct) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                for text in batch.column(0):
                    text = text.as_py()
                    if text:
                        numbers, at = _seeds_in(items, text, distinct)
                        if len(at):
                            found.append(np.unique(seed_codes(numbers)[at]))
                codes, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.uint64), np.empty(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(n, pa.int64())], names=["code", "n"])

        df = docs.select("text").mapInArrow(tidy(count), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
        out.append(items.marked({r["code"]: r["n"] for r in df.collect()}))  # a row for each seed of the block at most
    return out


def with_hits(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, name: str = "_hits") -> DataFrame:
    """docs with a column of the benchmark items that each text holds: item_id, score, start and end, best first.

    A document never leaves its row: the block's items go to the documents, with their bounded size, and no document is shuffled.

    Null or empty text: no hits. Long texts are searched whole. Null item_id or text, and items of fewer than LEAST_WORDS words, are not looked for; those of fewer than SHORT_WORDS must be there unaltered;
    repeated items count once. Empty benchmark: no hits anywhere. Other columns stay as they are.
    """
    ship(docs.sparkSession)
    out = docs.withColumn(name, F.array().cast(HIT))
    where = docs.columns.index("text")
    for items in blocks(docs, benchmark):
        distinct = np.unique(items.codes)

        def search(batches: Iterator[pa.RecordBatch], items=items, distinct=distinct) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                before = batch.column(batch.num_columns - 1)
                hits = [(old.as_py() or []) + find(items, text.as_py() or "", distinct, threshold) for old, text in zip(before, batch.column(where), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([sorted(h, key=lambda x: (-x["score"], x["item_id"])) for h in hits], before.type)], schema=batch.schema)

        out = out.mapInArrow(tidy(search), out.schema)
    return out


def flag(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, contaminated, item_id, score, start, end, items) of each row of docs: whether it holds a benchmark item, the best one, and all of them. See with_hits()."""
    found = with_hits(docs.select("doc_id", "text"), benchmark, threshold)
    best = F.try_element_at("_hits", F.lit(1))
    return found.select("doc_id", (F.size("_hits") > 0).alias("contaminated"), best["item_id"].alias("item_id"), F.coalesce(best["score"], F.lit(0.0)).alias("score"), best["start"].alias("start"), best["end"].alias("end"), F.transform("_hits", lambda h: h["item_id"]).alias("items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all of their columns, that hold no benchmark item. See with_hits()."""
    own, restore = shield(docs, ("text",))
    return restore(with_hits(own, benchmark, threshold).where(F.size("_hits") == 0))
