"""Self-join of documents on the Jaccard similarity of their word n-grams, and its components."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import ship
from .common import MEMORIES, broadcast_if_small, discard, materialize, shield, tidy
from .components import SALTS, connected_components

#: Words that a worker remembers with their hashes; the memory is emptied when it is full.
REMEMBERED = 100_000
#: Bytes of text whose sets a task holds at once.
PIECE_BYTES = 2_000_000
#: n-grams (8 MB) and sets that one block of the search holds; larger groups are cut.
BLOCK_GRAMS = 1_000_000
BLOCK_SETS = 512
#: Sets from which on a signature's list is dealt to several tasks, and beyond which they aren't counted further.
HOT, COMMON = 1000, 50_000
#: Places of sets in blocks (about 175 bytes each, 17 MB) up to which they are broadcast to the texts.
PLACES = 100_000
#: Bits for each place in the table by which texts are chosen beyond that, and the most bits in all (words of 64: about 11 MB).
BITS, MOST_BITS = 16, 1 << 24
#: Cost factor of a long list against a short one in the choice of how many lists are probed.
MU = 0.0085

_U = np.uint64


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_WORDS = _WordHash()
MEMORIES["words"] = _WORDS.clear


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that scatters all bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def grams(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a UTF-8 text; with fewer words, of all of them as one.

    Words are parted by blanks and the characters 9 to 13; A-Z are lower-cased.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, _U)
    h = np.fromiter(map(_WORDS.__getitem__, words), dtype=_U, count=len(words))
    size = min(n, len(h))
    out = np.full(len(h) - size + 1, size, dtype=_U)
    for i in range(size):
        out = _mix(out + h[i : len(h) - size + 1 + i])
    return np.unique(out)


def _pieces(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the texts of a column take PIECE_BYTES, or are one text."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        piece = (np.cumsum(lengths) - lengths) // PIECE_BYTES
        edges = [0, *(np.flatnonzero(piece[1:] != piece[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            yield batch.slice(a, b - a)


def _text_column(batch: pa.RecordBatch, i: int) -> Iterator[bytes]:
    for x in batch.column(i):
        yield x.as_py() or b""


def _set_id(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


def gram_sets(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, set_id) of each row; set_id names the set of n-grams (64 bits of it), null where that is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, 1):
            sets = [grams(t, n) for t in _text_column(batch, 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_set_id(s) if len(s) else None for s in sets], pa.int64())], names=["doc_id", "n_shingles", "set_id"]
            )

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(tidy(run, "words"), "doc_id long, n_shingles long, set_id long")


class Levels:
    """Sizes in intervals such that similar sets lie in the same or in neighbouring ones, with the parts that each level needs."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.ends: list[int] = []
        at = 1
        while at < 1 << 40:
            self.ends.append(max(at, at * den // num))
            at = self.ends[-1] + 1

    def of(self, size: int) -> int:
        return int(np.searchsorted(self.ends, size))

    @cache
    def parts(self, level: int) -> tuple[int, int]:
        """(elements by which similar sets of this level can differ, parts that sets are cut into)."""
        end = self.ends[level]
        differ = 2 * end * (self.den - self.num) // (self.den + self.num)
        parts = differ + 1
        for _ in range(3):
            empty = parts * math.exp(-end * (self.num / self.den) ** 2 / parts)
            parts = differ + 2 + math.ceil(empty + 2 * math.sqrt(empty))
        return differ, parts


_SEEDS = [_U(s) for s in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def signatures(own: np.ndarray, levels: Levels) -> np.ndarray:
    """Hashes of which two similar, different sets share at least one.

    A level cuts sets into more parts, by a hash of the element, than similar sets can have different elements; so at least
    one part is the same in both. Empty parts tell nothing: a set that has so many of them that the argument
    fails goes through the next cut as well, and after the last one gives its least elements, of which similar sets share
    one (prefix filter). Two sets that both fail at a cut thus meet at a later one. Small sets give their least elements at once.
    """
    return np.concatenate([hashes for hashes, _ in _cuts(own, levels)])


def _cuts(own: np.ndarray, levels: Levels) -> list[tuple[np.ndarray, int]]:
    """The signatures by level and cut, each with the number of them that a similar set has.

    Of m parts that are not empty at most differ can be unlike a similar set's, so m - differ are the same. A set that fails at
    a cut may still meet one there that doesn't, by one part at least.
    """
    out = []
    size = len(own)
    k = levels.of(size)
    mixed = _mix(own ^ _U(0x5851F42D4C957F2D))
    least = size - -(-levels.num * size // levels.den) + 1
    for level in (k, k + 1):
        differ, parts = levels.parts(level)
        tag = _U(level * 8)
        done = False
        if levels.ends[level] >= 24:
            for i, seed in enumerate(_SEEDS):
                part = ((_mix(own ^ seed) >> _U(32)) * _U(parts)) >> _U(32)
                order = np.argsort(part, kind="stable")
                part = part[order]
                starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                sums = np.add.reduceat(mixed[order], starts)
                out.append((_mix(sums ^ _mix(part[starts] * _U(64) + tag * _U(1 << 32) + _U(i))), max(1, len(starts) - differ)))
                if len(starts) > differ:
                    done = True
                    break
        if not done:
            out.append((_mix(np.sort(mixed)[:least] + tag + _U(7)), 1))
    return out


def _postings(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(sig, set_id, cut) of the signatures of each text's set, once for each set of a batch; cut is 8 * (how many of them a similar set has) + the cut's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = Levels(num, den)
        for batch in _pieces(batches):
            known: dict[int, list[tuple[np.ndarray, int]]] = {}
            for text in _text_column(batch, 0):
                own = grams(text, n)
                if len(own) and (name := _set_id(own)) not in known:
                    known[name] = _cuts(own, levels)
            if not known:
                continue
            flat = [(name, need * 8 + j, hashes) for name, found in known.items() for j, (hashes, need) in enumerate(found)]  # a set has at most eight cuts
            names, cuts, hashes = zip(*flat, strict=True)
            lengths = [len(h) for h in hashes]
            columns = np.concatenate(hashes).view(np.int64), np.repeat(np.array(names, np.int64), lengths), np.repeat(np.array(cuts, np.int32), lengths)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["sig", "set_id", "cut"])

    return docs.select(F.col("text").cast("binary")).mapInArrow(tidy(run, "words"), "sig long, set_id long, cut int")


def _shared(batches: Iterator[pa.RecordBatch], common: int = COMMON) -> Iterator[pa.RecordBatch]:
    """Of rows (sig, set_id, cut) sorted by sig and set_id those whose signature another set has, too, with the number of its sets, at most common.

    Most signatures stand once and go no further. The rows of one signature are held until their number is known, so at most common of them and a batch.
    """
    held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)]
    known = None  # the last signature, if it is known to be common
    for batch in chain(batches, [None]):
        if batch is not None:
            held = [np.concatenate([old, c.to_numpy()]) for old, c in zip(held, batch.columns, strict=True)]
        sig, name, cut = held
        if not len(sig):
            continue
        new = np.r_[True, (sig[1:] != sig[:-1]) | (name[1:] != name[:-1])]
        sig, name, cut = sig[new], name[new], cut[new]
        starts = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        lengths = np.diff(np.r_[starts, len(sig)])
        sets = np.minimum(lengths, common)
        if known is not None and sig[0] == known:
            sets[0] = common
        whole = batch is None or sets[-1] == common
        known = sig[-1] if sets[-1] == common else None
        edge = len(sig) if whole else starts[-1]
        held = [sig[edge:], name[edge:], cut[edge:]]
        sets = np.repeat(sets, lengths)[:edge]
        keep = sets > 1
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (sig[:edge][keep], name[:edge][keep], cut[:edge][keep], sets[keep].astype(np.int32))], names=["sig", "set_id", "cut", "sets"])


def _rare(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(sig, set_id, sets) of which two similar, different sets share a sig at least, sets being the number of sets that have it.

    Similar sets share at least as many signatures of a cut as the larger of their needs. All are put in one order, by the number of
    sets that have them and then by their hash; each set goes without its need - 1 commonest of a cut. The rarest that both have
    is not among those: as many others as that, which both have, come after it. So signatures that lie in a passage
    of many documents seldom lead to a candidate, and a set of which too few signatures stand twice has none.
    """
    listed = _postings(docs, n, num, den).repartition("sig").sortWithinPartitions("sig", "set_id").mapInArrow(tidy(_shared), "sig long, set_id long, cut int, sets int")
    listed = materialize(listed, "listed")
    order = Window.partitionBy("set_id", "cut").orderBy(F.desc("sets"), F.desc("sig"))
    rare = listed.withColumn("at", F.row_number().over(order)).where(F.col("at") >= F.shiftright("cut", 3)).select("sig", "set_id", "sets")
    rare = materialize(rare, "rare")
    discard(listed)
    return rare


def _chain(rare: DataFrame) -> DataFrame:
    """(u, v) of neighbours in the sorted list of each signature, read as a stream; the list of a hot one is dealt to SALTS tasks, and so are its parts' first sets chained."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (None, None, None)
        for batch in batches:
            sig, salt, name = (c.to_numpy() for c in batch.columns)
            if not len(sig):
                continue
            same = np.r_[(sig[0], salt[0]) == last[:2], (sig[1:] == sig[:-1]) & (salt[1:] == salt[:-1])]
            before = np.r_[last[2] if last[2] is not None else 0, name[:-1]]
            keep = same & (before != name)
            last = (sig[-1], salt[-1], name[-1])
            if keep.any():
                pairs = np.unique(np.column_stack([before[keep], name[keep]]), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    salt = F.when(F.col("sets") >= HOT, F.pmod(F.xxhash64("set_id"), F.lit(SALTS))).otherwise(F.lit(-1)).cast("int")
    dealt = rare.select("sig", salt.alias("salt"), "set_id")
    heads = dealt.where("salt >= 0").groupBy("sig", "salt").agg(F.min("set_id").alias("set_id")).select("sig", F.lit(-1).alias("salt"), "set_id")
    return dealt.unionByName(heads).repartition("sig", "salt").sortWithinPartitions("sig", "salt", "set_id").mapInArrow(tidy(run), "u long, v long")


def divide(lengths: np.ndarray, t: int) -> int:
    """How many of the longest lists are probed rather than merged, by DivideSkip's rule for threshold t."""
    return min(t - 1, int(t / (MU * math.log(int(lengths.max()) + 1) + 1)))


def merge_skip(lists: list[list[int]], t: int) -> Iterator[tuple[int, int]]:
    """(id, count) of the ids that at least t of the sorted lists hold, in order.

    A heap holds the head of each list. While the least id has fewer than t heads, the t - 1 least heads are taken off
    and their lists skip, by binary search, to the id that is then on top: none before it can stand in t lists.
    """
    width = len(lists)
    place = [0] * width
    heap = [own[0] * width + i for i, own in enumerate(lists)]
    heapq.heapify(heap)
    while len(heap) >= t:
        top = heap[0] // width
        taken = []
        while heap and heap[0] // width == top:
            taken.append(heapq.heappop(heap) % width)
        if len(taken) >= t:
            yield top, len(taken)
            for i in taken:
                place[i] += 1
        else:
            taken += [heapq.heappop(heap) % width for _ in range(t - 1 - len(taken))]
            edge = heap[0] // width
            for i in taken:
                place[i] = bisect_left(lists[i], edge, place[i])
        for i in taken:
            if place[i] < len(lists[i]):
                heapq.heappush(heap, lists[i][place[i]] * width + i)


class Index:
    """Inverted lists of the elements of a block of sets."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        self.num, self.den = num, den
        self.sizes = np.array([len(s) for s in sets], np.int64)
        elements = np.concatenate(sets)
        order = np.argsort(elements, kind="stable")  # owners stay ascending within an element
        self.owners = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)[order]
        elements = elements[order]
        self.starts = np.flatnonzero(np.r_[True, elements[1:] != elements[:-1]])
        self.keys = elements[self.starts]
        self.ends = np.r_[self.starts[1:], len(elements)]

    def search(self, query: np.ndarray, wanted: np.ndarray | None = None) -> np.ndarray:
        """The sets (among wanted, a flag for each) that are similar to query: T-occurrence search with DivideSkip.

        A similar set has at least T elements of the query. The long lists are set aside; a heap merges the short ones, in which
        it must occur T - (number of long lists) times. What does is looked up in the long lists by binary search,
        and retained if it reaches the overlap that its own size requires.
        """
        m = len(query)
        at = np.searchsorted(self.keys, query)
        at = at[self.keys[np.minimum(at, len(self.keys) - 1)] == query]
        t = -(-self.num * m // self.den)
        if len(at) < t:
            return np.empty(0, np.int64)
        lengths = self.ends[at] - self.starts[at]
        at = at[np.argsort(lengths, kind="stable")]
        n_long = divide(lengths, t)
        cut = len(at) - n_long
        merged = list(merge_skip([self.owners[self.starts[i] : self.ends[i]].tolist() for i in at[:cut]], t - n_long))
        if not merged:
            return np.empty(0, np.int64)
        found, count = np.array(merged, np.int64).T
        # overlap >= num / (num + den) * (sum of the sizes), rounded up
        need = -(-self.num * (m + self.sizes[found]) // (self.num + self.den))
        may = (count + n_long >= need) & (self.sizes[found] * self.den >= self.num * m) & (self.sizes[found] * self.num <= self.den * m)
        if wanted is not None:
            may &= wanted[found]
        found, count, need = found[may], count[may], need[may]
        for done, i in enumerate(at[cut:]):
            if not len(found):
                break
            lst = self.owners[self.starts[i] : self.ends[i]]
            if len(lst) == len(self.sizes):
                count = count + 1
            else:
                p = np.searchsorted(lst, found)
                count = count + (lst[np.minimum(p, len(lst) - 1)] == found)
            if done % 32 == 31:
                may = count + (n_long - done - 1) >= need
                found, count, need = found[may], count[may], need[may]
        return found[count >= need]


class Block:
    """The sets of a block, to which guests of other blocks are compared as they come; then its own are, as far as they aren't connected."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.names: list[int] = []
        self.sets: list[np.ndarray] = []
        self.asked: list[bool] = []
        self.index: Index | None = None

    def add(self, name: int, own: np.ndarray, asked: bool) -> None:
        self.names.append(name)
        self.sets.append(own)
        self.asked.append(asked)

    def _ready(self) -> Index:
        if self.index is None:
            self.index = Index(self.sets, self.num, self.den)
            self.labels = np.arange(len(self.sets))
        return self.index

    def _join(self, name: int, found: np.ndarray) -> list[tuple[int, int]]:
        """Links of a set with one of each class among those found, which become one class."""
        classes, at = np.unique(self.labels[found], return_index=True)
        if len(classes) > 1:
            self.labels[np.isin(self.labels, classes)] = classes[0]
        return [(name, self.names[found[i]]) for i in at]

    def guest(self, name: int, own: np.ndarray) -> list[tuple[int, int]]:
        return self._join(name, self._ready().search(own)) if self.sets else []

    def own_links(self, only_asked: bool) -> list[tuple[int, int]]:
        """Links that connect what similar pairs of the block connect.

        The asked sets are searched. Unless that is all, so is every set outside the largest class, which grows as they are;
        pairs within that are connected already, so nothing is lost.
        """
        if len(self.sets) < 2:
            return []
        index, links, done = self._ready(), [], np.zeros(len(self.sets), bool)

        def ask(i: int) -> None:
            done[i] = True
            found = index.search(self.sets[i], self.labels != self.labels[i])
            links.extend(self._join(self.names[i], np.r_[found, i]) if len(found) else ())

        for i in np.flatnonzero(self.asked):
            ask(i)
        if only_asked:
            return links
        if not done.any():
            ask(0)
        while True:
            values, counts = np.unique(self.labels, return_counts=True)
            rest = np.flatnonzero(~done & (self.labels != values[np.argmax(counts)]))
            if not len(rest):
                return links
            ask(rest[0])


def _of_members(docs: DataFrame, members: DataFrame, rows: int) -> DataFrame:
    """The rows of docs whose doc_id is the rep of one of the members, rows at most, and by chance few others: a hash of the doc_id finds its bit set."""
    size = min(MOST_BITS, 1 << max(6, (BITS * rows - 1).bit_length()))

    def bit(c: str) -> tuple[Column, Column]:
        at = F.pmod(F.xxhash64(c), F.lit(size))
        return F.shiftright(at, 6), at.bitwiseAND(F.lit(63)).cast("int")

    word, place = bit("rep")
    words = members.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place)).alias("bits"))
    word, place = bit("doc_id")
    return docs.join(F.broadcast(words), word == F.col("word")).where(F.getbit("bits", place) == 1).select(*docs.columns)


def _links(docs: DataFrame, members: DataFrame, n: int, num: int, den: int, only_asked: bool = False) -> DataFrame:
    """Verified (u, v) within blocks of members (rep, set_id, component, block, asked, guest).

    A task reads its blocks as a sorted stream: it holds the sets of one block, and of the guests one Arrow batch at a time.
    """
    # a text is hashed once, however many blocks its set visits; places are counted before they are gathered, which bounds what is broadcast
    rows = members.count()
    gathered = members.groupBy("rep", "set_id", "component").agg(F.collect_list(F.struct("block", "asked", "guest")).alias("places"))
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    if rows <= PLACES:
        gathered = F.broadcast(gathered)
    else:
        texts, gathered = _of_members(texts, members, rows), gathered.hint("merge")
    texts = texts.join(gathered, F.col("doc_id").eqNullSafe(F.col("rep"))).select("text", "set_id", "component", "places")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            own = [grams(t, n) for t in _text_column(batch, 0)]
            right = pa.array([bool(len(s)) and _set_id(s) == name for s, name in zip(own, batch.column(1).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([s.tobytes() for s in own], pa.binary()), *batch.columns[1:]], names=["grams", *batch.schema.names[1:]]).filter(right)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, last = None, None, None
        for batch in batches:
            found: list[tuple[int, int]] = []
            for own, name, component, number, asked, guest in zip(batch.column(0), *(c.to_pylist() for c in batch.columns[1:]), strict=True):
                if key != (component, number):
                    if block is not None:
                        found += block.own_links(only_asked)
                    key, block, last = (component, number), Block(num, den), None
                if last == (guest, name):  # a repeated row
                    continue
                last = (guest, name)
                held = np.frombuffer(own.as_buffer(), _U)
                if guest:
                    found += block.guest(name, held)
                else:
                    block.add(name, held.copy(), asked)
            yield _pairs(found)
        if block is not None:
            yield _pairs(block.own_links(only_asked))

    held = texts.mapInArrow(tidy(sets, "words"), "grams binary, set_id long, component long, places array<struct<block:int,asked:boolean,guest:boolean>>")
    held = held.withColumn("p", F.explode("places")).select("grams", "set_id", "component", "p.block", "p.asked", "p.guest")
    return held.repartition("component", "block").sortWithinPartitions("component", "block", "guest", "set_id").mapInArrow(tidy(link, "words"), "u long, v long")


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = zip(*found, strict=True) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _classes(links: DataFrame) -> DataFrame:
    return materialize(connected_components(links), "classes")


def _meetings(rare: DataFrame, state: DataFrame) -> DataFrame:
    """(set_id, block) of the blocks of large groups in which a set outside the group's main class may have a similar one: those where a rare signature of it stands."""
    here = rare.select("sig", F.col("set_id").alias("s")).join(state.select("set_id", "block", (F.col("class") != F.col("main")).alias("outside")), F.col("s") == F.col("set_id")).select("sig", "set_id", "block", "outside")
    here = materialize(here, "here")
    asked = here.where("outside").select("sig", "set_id")
    there = here.join(asked.select("sig").distinct(), "sig", "left_semi").select("sig", "block").distinct()
    met = materialize(asked.join(there, "sig").select("set_id", "block").distinct(), "met")
    discard(here)
    return met


def join(docs: DataFrame, n: int = 5, similarity: tuple[int, int] = (8, 10), block_grams: int = BLOCK_GRAMS, block_sets: int = BLOCK_SETS) -> DataFrame:
    """(doc_id, n_shingles, set_id, class, component_id) of each row of docs (doc_id, text).

    Two documents link when the Jaccard similarity of their sets of word n-grams is at least similarity, a fraction of integers;
    component_id is the least doc_id that links reach.

    1. Every text becomes a set of n-grams; equal sets are one node from here on, however many documents have them.
    2. Sets that share one of their rare signatures (see _rare(): similar ones always do) form candidate groups, found as connected components.
    3. In each group a T-occurrence search over inverted lists finds the similar sets. Only one document of a set is read
       again for it. Groups of more than block_grams n-grams or block_sets sets are cut into blocks by hash; the group's first set
       is searched in all blocks. If a group still isn't one component, the sets outside its largest component are
       searched in those of its blocks that have a rare signature of theirs: pairs within that component are connected already.
    4. The components of the verified links give the classes.

    Null, empty or blank text: n_shingles 0, linked with nothing, component_id its own doc_id. Repeated rows and doc_ids: equal
    texts link; a null doc_id is left out of the minimum. Empty table: no rows. Other columns are ignored.
    Hashes of n-grams and sets have 64 bits.
    """
    ship(docs.sparkSession)
    num, den = similarity
    docs = docs.select("doc_id", "text")
    own = materialize(gram_sets(docs, n), "sets")
    rare = _rare(docs, n, num, den)
    candidates = materialize(_chain(rare).distinct(), "candidates")
    groups = _classes(candidates)
    # grouped before the join, so that a set that many documents have is one row in it
    reps = own.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("size")).join(groups, F.col("set_id") == F.col("node")).drop("node")
    reps = materialize(reps, "reps")
    discard(candidates, groups)
    blocks = F.ceil(F.greatest(F.sum("size") / block_grams, F.count("*") / block_sets)).cast("int")
    sizes = reps.groupBy("component").agg(blocks.alias("blocks"), F.min("set_id").alias("first")).where("blocks > 1").select(F.col("component").alias("g"), "blocks", "first")
    placed = reps.join(broadcast_if_small(sizes), F.col("component") == F.col("g"), "left").drop("g").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = materialize(placed.withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int")), "placed")
    discard(reps)
    cols = ("rep", "set_id", "component", "block", "asked", "guest")
    home = placed.withColumn("asked", F.lit(False)).withColumn("guest", F.lit(False))
    large = placed.where("blocks > 1")
    first = large.where("set_id = first").withColumn("home", F.col("block")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("block <> home")
    links = materialize(_links(docs, home.select(*cols).unionByName(first.withColumn("asked", F.lit(True)).withColumn("guest", F.lit(True)).select(*cols)), n, num, den), "links")
    classes = _classes(links)
    if not large.isEmpty():
        state = large.join(classes, F.col("set_id") == F.col("node"), "left").select(*[large[c] for c in large.columns], F.coalesce(classes["component"], "set_id").alias("class"))
        by_class = state.groupBy(F.col("component").alias("g"), "class").agg(F.count("*").alias("k"))
        main = by_class.groupBy("g").agg(F.max_by("class", F.struct("k", "class")).alias("main"), F.count("*").alias("classes")).where("classes > 1")
        state = materialize(state.join(broadcast_if_small(main), F.col("component") == F.col("g")), "state")
        outside = state.where("class <> main")
        if not outside.isEmpty():
            met = _meetings(rare, state)
            meet = met.select(F.col("set_id").alias("s"), F.col("block").alias("other"))
            guests = outside.join(meet, F.col("set_id") == F.col("s")).where("other <> block").withColumn("block", F.col("other"))
            members = state.withColumn("asked", F.col("class") != F.col("main")).withColumn("guest", F.lit(False)).select(*cols)
            members = materialize(members.unionByName(guests.withColumn("asked", F.lit(True)).withColumn("guest", F.lit(True)).select(*cols)), "members")
            more = materialize(_links(docs, members, n, num, den, only_asked=True), "links")
            discard(members, classes, met)
            classes = _classes(links.unionByName(more))
            discard(more)
        discard(state)
    discard(links, placed, rare)
    return _result(own, classes)


def _result(own: DataFrame, classes: DataFrame) -> DataFrame:
    least = own.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    nodes = least.join(classes, F.col("set_id") == F.col("node"), "left").select(F.col("set_id").alias("s"), "least", F.coalesce("component", "set_id").alias("class"))
    nodes = materialize(nodes, "nodes")
    # a set alone is its class
    by_class = nodes.groupBy("class").agg(F.min("least").alias("component_id"), F.count("*").alias("k")).where("k > 1").select(F.col("class").alias("c"), "component_id")
    found = nodes.join(broadcast_if_small(by_class), F.col("class") == F.col("c"), "left").select("s", "class", F.when(F.col("c").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    ids = materialize(found, "ids")
    discard(classes, nodes)
    return own.join(ids, F.col("set_id") == F.col("s"), "left").select("doc_id", "n_shingles", "set_id", "class", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, n: int = 5, similarity: tuple[int, int] = (8, 10)) -> DataFrame:
    """The rows of docs, with all of their columns, but for those in whose component another comes first.

    Of each component the row with the least doc_id stays, and of rows that repeat it the one with the least set_id. Rows that share
    a doc_id but neither text nor a link are different documents, and all stay; so do rows without a doc_id, and those without words
    (each text of a doc_id).
    """
    own, restore = shield(docs, ("doc_id", "text"))
    joined = materialize(join(docs, n, similarity), "joined")
    found = joined.where("doc_id is not null and set_id is not null")
    order = F.struct("doc_id", "set_id")
    least = found.groupBy("class").agg(F.min(order).alias("least"), F.max(order).alias("most")).where("least <> most").select(F.col("class").alias("c"), "least")
    gone = found.join(broadcast_if_small(least), F.col("class") == F.col("c")).where(order > F.col("least")).select(F.col("doc_id").alias("_id"), F.col("set_id").alias("_set")).distinct()
    gone = materialize(gone, "gone")
    ids = joined.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1")
    if ids.isEmpty():
        # a doc_id names one row, so texts needn't be read again
        discard(joined)
        return restore(own.join(broadcast_if_small(gone), F.col("doc_id") == F.col("_id"), "left_anti"))
    discard(joined)
    named = _with_set(own, n)
    left = named.join(broadcast_if_small(gone), (F.col("doc_id") == F.col("_id")) & (F.col("_set_id") == F.col("_set")), "left_anti")
    single = left.where("doc_id is null")
    return restore(single.unionByName(left.where("doc_id is not null").dropDuplicates(["doc_id", "_set_id"])))


def _with_set(docs: DataFrame, n: int) -> DataFrame:
    """docs with _set_id, the name of each text's set."""
    schema = T.StructType([*docs.schema, T.StructField("_set_id", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = (grams(t, n) for t in _text_column(batch, batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([_set_id(s) if len(s) else None for s in sets], pa.int64())], names=schema.names)

    return docs.select("*", F.col("text").cast("binary").alias("_bytes")).mapInArrow(tidy(run, "words"), schema)
