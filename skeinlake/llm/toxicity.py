"""Toxicity from the nearest labelled examples by exact TF-IDF cosine, over a block-max inverted index."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship
from .common import MEMORIES, discard, materialize, tidy

#: Labelled examples in the index, at most, and their characters together, at most; which ones follows a hash of doc_id.
EXAMPLES, EXAMPLE_CHARS = 20_000, 40_000_000
#: Examples in a block of the index.
BLOCK = 64
#: Terms of more than this share of the examples are held as columns rather than as lists.
COMMON = 0.03
NEIGHBOURS = 15
#: Examples that are scored against the others for calibration, at most.
CALIBRATED = 4000
#: Texts that are scored together.
TOGETHER = 128
#: Words that a worker remembers with their terms; the memory is emptied when it is full.
REMEMBERED = 500_000
#: Words of texts that are counted together.
WORDS = 200_000

_WORD = re.compile(r"\w+")
#: ASCII with a blank for all that isn't of a word.
_BLANKED = "".join(c if _WORD.match(c) else " " for c in map(chr, range(128)))


def words(text: str | None) -> list[str]:
    """The words of a text in lower case."""
    text = (text or "").lower()
    return text.translate(_BLANKED).split() if text.isascii() else _WORD.findall(text)


def _hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


class Terms(dict):
    """The place of a word among the sorted hashes of the vocabulary; -1 where it isn't in it."""

    def __init__(self, vocabulary: np.ndarray):
        super().__init__()
        self.vocabulary = vocabulary

    def learn(self, words: list[str]) -> None:
        hashes = np.fromiter(map(_hash, words), np.uint64, len(words))
        at = np.searchsorted(self.vocabulary, hashes)
        found = np.zeros(len(words), bool)
        inside = np.flatnonzero(at < len(self.vocabulary))
        found[inside] = self.vocabulary[at[inside]] == hashes[inside]
        self.update(zip(words, np.where(found, at, -1).tolist(), strict=True))

    def count(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of texts in words: how many terms each has, as far as the vocabulary has them, and the terms and counts of all in turn."""
        flat = list(chain.from_iterable(texts))
        places = np.fromiter(map(self.get, flat, repeat(-2)), np.int64, len(flat))
        unknown = np.flatnonzero(places == -2)
        if len(unknown):
            asked = [flat[i] for i in unknown.tolist()]
            new = list(set(asked))
            if len(self) + len(new) > REMEMBERED:
                self.clear()
            self.learn(new)
            places[unknown] = np.fromiter(map(self.__getitem__, asked), np.int64, len(asked))
        size = max(1, len(self.vocabulary))
        keys = np.repeat(np.arange(len(texts)) * size, list(map(len, texts))) + places
        keys, counts = np.unique(keys[places >= 0], return_counts=True)
        owner, terms = np.divmod(keys, size)
        return np.bincount(owner, minlength=len(texts)), terms, counts


def vector(terms: np.ndarray, counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The weights (1 + log tf) times the term's own, to length 1."""
    found = (1 + np.log(counts)) * weight[terms]
    norm = np.sqrt((found * found).sum())
    return found / norm if norm else found


def _ranges(lo: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers lo[i] to lo[i] + sizes[i] - 1 of all i in turn."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo - (ends - sizes), sizes)


class BlockMaxIndex:
    """The examples' vectors by term: common terms as columns, the others as inverted lists in blocks of examples with the greatest weight in each."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = BLOCK, step: int = 16, common: float = COMMON):
        self.n, self.block, self.step = len(vectors), block, step
        self.n_blocks = -(-self.n // block)
        owner = np.repeat(np.arange(self.n, dtype=np.int32), [len(t) for t, _ in vectors])
        terms = np.concatenate([t for t, _ in vectors]) if vectors else np.empty(0, np.int64)
        weights = np.concatenate([w for _, w in vectors]).astype(np.float32) if vectors else np.empty(0, np.float32)
        frequency = np.bincount(terms, minlength=n_terms)
        heads = np.flatnonzero(frequency > common * self.n)
        self.head = np.full(n_terms, -1, np.int32)  # a common term's column
        self.head[heads] = np.arange(len(heads))
        own = self.head[terms] >= 0
        self.columns = np.zeros((len(heads), self.n_blocks * block), np.float32)
        self.columns[self.head[terms[own]], owner[own]] = weights[own]
        owner, terms, weights = owner[~own], terms[~own], weights[~own]
        order = np.argsort(terms, kind="stable")  # examples stay in order
        self.owner, self.weights, terms = owner[order], weights[order], terms[order]
        del owner, weights, order
        cell = terms.astype(np.int64) * max(1, self.n_blocks) + self.owner // block
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.empty(0, np.int64)
        self.top = np.maximum.reduceat(self.weights, starts) if len(cell) else np.empty(0, np.float32)
        first = cell[starts]
        self.cell_starts = np.r_[starts, len(cell)].astype(np.int32)  # a cell ends where the next one starts
        self.cell_block = (first % max(1, self.n_blocks)).astype(np.int32)
        self.edges = np.searchsorted(first // max(1, self.n_blocks), np.arange(n_terms + 1))  # a term's cells

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (terms, weights) the (examples, cosines) of the k nearest, exactly, ties to the smaller number; examples without a common term are none."""
        asked = np.zeros((len(queries), len(self.columns)), np.float32)
        for i, (terms, weights) in enumerate(queries):
            own = self.head[terms] >= 0
            asked[i, self.head[terms[own]]] = weights[own]
        dense = (asked @ self.columns).reshape(len(queries), self.n_blocks, self.block)
        highest = dense.max(2) if self.n else np.zeros((len(queries), 0))
        return [self._nearest(t, w, dense[i], highest[i], k, without[i] if without else -1) for i, (t, w) in enumerate(queries)]

    def _nearest(self, terms: np.ndarray, weights: np.ndarray, dense: np.ndarray, highest: np.ndarray, k: int, without: int) -> tuple[np.ndarray, np.ndarray]:
        """The blocks with the greatest upper bounds (what the columns give the best of their examples, and the query's weights times the lists'
        greatest weights there) come first; then, at once, all blocks whose bound reaches the k-th best cosine so far. Only their examples are looked at."""
        if not len(terms) or not self.n:
            return np.empty(0, np.int64), np.empty(0)
        lo = self.edges[terms]
        sizes = self.edges[terms + 1] - lo
        cells = _ranges(lo, sizes)
        weight = np.repeat(weights, sizes)
        at = self.cell_block[cells]
        bound = np.bincount(at, weights=weight * self.top[cells], minlength=self.n_blocks) + highest
        places = np.arange(self.block)

        def whole(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The examples of blocks and their cosines."""
            slot = np.full(self.n_blocks, -1)
            slot[blocks] = np.arange(len(blocks))
            slots = slot[at]
            own = np.flatnonzero(slots >= 0)
            chosen = cells[own]
            start = self.cell_starts[chosen].astype(np.int64)
            size = self.cell_starts[chosen + 1] - start
            p = _ranges(start, size)
            total = dense[blocks].astype(np.float64).ravel()
            if len(p):
                # an example's place among those of the blocks: its own, moved as its block was
                moved = np.repeat((slots[own] - at[own]) * self.block, size) + self.owner[p]
                total += np.bincount(moved, weights=np.repeat(weight[own], size) * self.weights[p], minlength=len(total))
            ids = (blocks[:, None] * self.block + places).ravel()
            if without >= 0:
                total[ids == without] = 0.0
            return ids, total

        def least(total: np.ndarray) -> float:
            return float(np.partition(total, -k)[-k]) if len(total) > k else 0.0

        step = min(self.step, self.n_blocks)
        first = np.argpartition(bound, -step)[-step:]
        ids, total = whole(first)
        # float sums of bounds may round below the cosine
        reach = bound >= least(total) - 1e-5
        reach[first] = False
        if reach.any():
            more, others = whole(np.flatnonzero(reach))
            ids, total = np.concatenate([ids, more]), np.concatenate([total, others])
        found = np.flatnonzero((total > 0) & (total >= least(total)))
        ids, total = ids[found], total[found]
        order = np.lexsort((ids, -total))[:k]
        return ids[order], total[order]


@dataclass
class Model:
    vocabulary: np.ndarray  # sorted hashes of the examples' words; stays where the model was made
    weight: np.ndarray
    sizes: np.ndarray  # terms of each example
    packed: list[bytes]  # pack() of each example's
    ids: np.ndarray
    toxic: np.ndarray
    prior: float  # share of toxic examples among those without words
    steps: np.ndarray  # raw votes
    values: np.ndarray  # and what they mean
    shared: Broadcast | None = None  # the model without the two, once tasks have it

    @cached_property
    def index(self) -> BlockMaxIndex:
        """Made where it is first asked for, and not sent."""
        return BlockMaxIndex([(t.astype(np.int32), w.astype(np.float32)) for t, w in map(self.vector, self.sizes.tolist(), self.packed)], len(self.weight))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "index"} | {"vocabulary": self.vocabulary[:0], "shared": None}

    def vector(self, n: int, packed: bytes) -> tuple[np.ndarray, np.ndarray]:
        terms, counts = unpack(n, packed)
        return terms, vector(terms, counts, self.weight)

    def raw(self, near: np.ndarray, cosines: np.ndarray) -> float:
        """Votes weighted by the cosine's angle distance, with one vote for the prior."""
        weight = 1 / (0.1 + np.arccos(np.clip(cosines, -1, 1)))
        return float((weight @ self.toxic[near] + self.prior) / (weight.sum() + 1))

    def votes(self, sizes: list[int], packed: list[bytes], without: list[int] | None = None) -> Iterator[tuple[float | None, np.ndarray, np.ndarray]]:
        """(raw vote, neighbours, cosines) of each text by its pack(); no vote without neighbours. without: an example for each text that is none for it."""
        for at in range(0, len(sizes), TOGETHER):
            part = slice(at, at + TOGETHER)
            for near, cosines in self.index.search(list(map(self.vector, sizes[part], packed[part])), NEIGHBOURS, without and without[part]):
                yield self.raw(near, cosines) if len(near) else None, near, cosines

    def score(self, raw: float | None) -> float:
        """What a raw vote means."""
        return self.prior if raw is None else float(np.interp(raw, self.steps, self.values)) if len(self.steps) else raw


#: The words that a worker knows, by the broadcast's number.
_TERMS: dict[int, Terms] = {}
MEMORIES["terms"] = _TERMS.clear


def _terms(number: int, vocabulary: np.ndarray) -> Terms:
    if number not in _TERMS:
        _TERMS.clear()
        _TERMS[number] = Terms(vocabulary)
    return _TERMS[number]


def pack(terms: np.ndarray, counts: np.ndarray) -> bytes:
    """A text's terms, as differences, and their counts in few bytes; none without terms."""
    return pa.compress(np.concatenate([np.diff(terms, prepend=0), counts]).astype(np.int32).tobytes(), codec="zstd", asbytes=True) if len(terms) else b""


def unpack(n: int, packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The n terms and counts of pack()."""
    found = np.frombuffer(pa.decompress(packed, 8 * n, codec="zstd", asbytes=True) if n else b"", np.int32).astype(np.int64)
    return np.cumsum(found[:n]), found[n:]


def counted(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(doc_id, n, terms) of each row of docs (doc_id, text): the terms of its whole text that the vocabulary has, and their counts, packed."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    number = shared._jbroadcast.id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _terms(number, shared.value)

        def flush(ids: pa.Array, texts: list[list[str]]) -> pa.RecordBatch:
            sizes, terms, counts = known.count(texts)
            ends = np.cumsum(sizes).tolist()
            packed = [pack(terms[lo:hi], counts[lo:hi]) for lo, hi in zip([0, *ends], ends)]
            return pa.RecordBatch.from_arrays([ids, pa.array(sizes.astype(np.int32)), pa.array(packed, pa.binary())], names=["doc_id", "n", "terms"])

        for batch in batches:
            held, n, start = [], 0, 0
            for row, text in enumerate(batch.column(1)):
                held.append(words(text.as_py()))
                n += len(held[-1])
                if n >= WORDS or row == batch.num_rows - 1:
                    yield flush(batch.column(0).slice(start, len(held)), held)
                    held, n, start = [], 0, row + 1

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run, "terms"), "doc_id long, n int, terms binary")


def _calibrate(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling, a little towards the overall rate, with a slight slope left so that order is kept."""
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []
    for r, v in zip(raw[order], y[order], strict=True):
        pools.append([v, 1.0, r])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            s, n, at = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, (pools[-1][2] * pools[-1][1] + at * n) / (pools[-1][1] + n)]
    rate = float(y.mean())
    steps = np.array([p[2] for p in pools])
    values = np.array([(p[0] + rate) / (p[1] + 1) for p in pools])
    return np.r_[0.0, steps, 1.0], np.clip(0.98 * np.r_[values[0], values, values[-1]] + 0.02 * np.r_[0.0, steps, 1.0], 0, 1)


def relevance(n: np.ndarray, toxic: np.ndarray, examples: int, rate: float) -> np.ndarray:
    """How much a term says about the label: the absolute log odds ratio of the toxic among the n examples that have it to all, shrunken by two examples at the overall rate."""
    return np.abs(np.log((toxic + 2 * rate) / (n - toxic + 2 * (1 - rate))) - np.log(rate / (1 - rate)))


def _examples(docs: DataFrame, labels: DataFrame, label: str, rows: int, chars: int) -> DataFrame:
    """(id, y, text) of at most rows labelled documents with at most chars characters together, in the order of a hash of their id."""
    known = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    known = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(rows)
    own = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("id"))  # at most rows rows on one side
    own = materialize(own.groupBy("id", "y").agg(F.max("text").alias("text")), "examples")
    sizes = own.select("id", F.coalesce(F.length("text"), F.lit(0)).alias("n")).orderBy(F.xxhash64("id"), "id").collect()  # at most rows rows
    if sum(r["n"] for r in sizes) <= chars:
        return own
    kept, room = [], chars
    for r in sizes:
        if r["n"] <= room:
            room -= r["n"]
            kept.append((r["id"],))
    return own.join(F.broadcast(docs.sparkSession.createDataFrame(kept, "id long")), "id", "left_semi").select("id", "y", "text")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", examples: int = EXAMPLES, chars: int = EXAMPLE_CHARS) -> Model:
    """The model of fit_counted() alone."""
    model, rows = fit_counted(docs, labels, label, examples, chars)
    discard(rows)
    return model


def fit_counted(docs: DataFrame, labels: DataFrame, label: str, examples: int, chars: int = EXAMPLE_CHARS) -> tuple[Model, DataFrame]:
    """Chooses examples, counts the words of their texts in all documents, and builds the index. The model, and all documents as counted() by its vocabulary.

    Vectors hold every word of a text. A word weighs its inverse document frequency, over all of docs, times its relevance()
    in the examples (delta TF-IDF): words that say nothing about the label count for little, but none is left out.
    """
    own = _examples(docs, labels, label, examples, chars)
    lists = ["terms", "counts"]

    def example(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, counts = [], []
            for text in batch.column(2):
                terms, n = np.unique(np.array(list(map(_hash, words(text.as_py()))), np.uint64), return_counts=True)
                hashes.append(terms.view(np.int64))
                counts.append(n.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hashes, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32()))], names=["id", "y", *lists])

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, place = np.unique(batch.column(1).flatten().to_numpy(), return_inverse=True)
            toxic = np.repeat(batch.column(0).to_numpy(), batch.column(1).value_lengths().to_numpy())
            columns = [hashes, np.bincount(place, minlength=len(hashes)), np.bincount(place, toxic, len(hashes)).astype(np.int64)]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["term", "n", "toxic"])

    texts = materialize(own.mapInArrow(tidy(example), "id long, y int, terms array<long>, counts array<int>"), "example-terms")
    discard(own)
    n_examples, n_toxic = texts.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    rate = n_toxic / n_examples if n_examples else 0.0
    if not 0 < rate < 1:
        discard(texts)
        none = np.empty(0)
        return Model(np.empty(0, np.uint64), none, np.empty(0, np.int64), [], np.empty(0, np.int64), none, rate, none, none), counted(docs, np.empty(0, np.uint64))
    # a row for each word of the examples: the driver holds numbers of words, never the examples' vectors other than packed
    said = texts.select("y", "terms").mapInArrow(tidy(labelled), "term long, n long, toxic long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).toArrow()
    vocabulary = said["term"].to_numpy().view(np.uint64)
    order = np.argsort(vocabulary)
    vocabulary, n, toxic = vocabulary[order], said["n"].to_numpy()[order].astype(float), said["toxic"].to_numpy()[order].astype(float)
    del said, order
    rows = materialize(counted(docs, vocabulary), "terms")  # a text is cut into words once, for frequencies and for scores
    size = len(vocabulary)

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size + 1, np.int64)
        for batch in batches:
            df[-1] += batch.num_rows
            for n, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                df[unpack(n, packed)[0]] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["i", "n"])

    found = rows.select("n", "terms").mapInArrow(tidy(frequency), "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()  # a row for each word of the examples at most
    df = np.zeros(len(vocabulary) + 1)
    df[found["i"].to_numpy()] = found["n"].to_numpy()
    weight = (np.log((df[-1] + 1) / (df[:-1] + 1)) + 1e-3) * (relevance(n, toxic, n_examples, rate) + 1e-3)
    del found, df, n, toxic
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((vocabulary, weight))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, weight = shared.value
        for batch in batches:
            sizes, packed, heaviest = [], [], []
            for hashes, counts in zip(*(batch.column(x) for x in lists), strict=True):
                terms, n = np.searchsorted(vocabulary, hashes.values.to_numpy().view(np.uint64)), counts.values.to_numpy()
                sizes.append(len(terms))
                packed.append(pack(terms, n))
                heaviest.append(int(terms[np.argmax(vector(terms, n, weight))]) if len(terms) else -1)
            columns = [batch.column("id"), batch.column("y"), pa.array(heaviest, pa.int64()), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "y", "heaviest", "n", "terms"])

    held = texts.mapInArrow(tidy(place), "id long, y int, heaviest long, n long, terms binary").toArrow()  # bounded by examples and chars
    shared.unpersist()
    discard(texts)
    bare = held["y"].to_numpy()[held["n"].to_numpy() == 0]
    prior = float((bare.sum() + 0.5 * rate) / (len(bare) + 0.5))
    # neighbours in the index share their heaviest terms, so that the bounds of blocks differ
    heaviest, ids = held["heaviest"].to_numpy(), held["id"].to_numpy()
    order = np.lexsort((ids, heaviest))
    order = order[heaviest[order] >= 0]
    packed = held["terms"].to_pylist()
    model = Model(vocabulary, weight, held["n"].to_numpy()[order], [packed[i] for i in order.tolist()], ids[order], held["y"].to_numpy()[order].astype(float), prior, np.empty(0), np.empty(0))
    del held, packed
    return _calibrated(spark, model), rows


def _calibrated(spark: SparkSession, model: Model) -> Model:
    """The model with what raw votes mean: some of its examples are scored against the others, in tasks, where the index is made."""
    asked = list(range(0, len(model.ids), max(1, -(-len(model.ids) // CALIBRATED))))
    if not asked:
        return model
    shared = model.shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, sizes, packed = batch.to_pydict().values()
            votes = [shared.value.prior if raw is None else raw for raw, *_ in shared.value.votes(sizes, packed, at)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(votes, pa.float64())], names=["i", "raw"])

    chosen = pa.table({"i": pa.array(asked, pa.int64()), "n": model.sizes[asked], "terms": pa.array([model.packed[i] for i in asked], pa.binary())})
    found = spark.createDataFrame(chosen).mapInArrow(tidy(run), "i long, raw double").toArrow().sort_by("i")  # at most CALIBRATED rows
    model.steps, model.values = _calibrate(found["raw"].to_numpy(), model.toxic[asked])
    return model


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", examples: int = EXAMPLES, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted, evidence) of each row of docs (doc_id, text), from nothing but its text.

    score is the calibrated vote of the nearest labelled examples, evidence their doc_id, label and cosine, nearest first.
    The model is bounded by the examples and their characters, so it can be broadcast to the documents, which are not shuffled.

    A text without any word of an example, empty and null ones included, has no neighbours and gets the share of toxic examples among those without words.
    Without labels of both kinds all get that label's share (0 without any). Repeated labels: toxic if one says so. Repeated rows are scored each.
    Empty table: no rows. Other columns are ignored.
    """
    ship(docs.sparkSession)
    model, rows = fit_counted(docs, labels, label, examples)
    shared = model.shared or docs.sparkSession.sparkContext.broadcast(model)
    steps, values = model.steps, model.values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        model.steps, model.values = steps, values
        evidence = pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())])
        for whole in batches:
            for batch in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                answers = [(model.score(raw), near, cosines) for raw, near, cosines in model.votes(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
                scores = np.array([min(1.0, max(0.0, s)) for s, *_ in answers])
                near = np.concatenate([a[1] for a in answers])
                parts = [pa.array(model.ids[near]), pa.array(model.toxic[near].astype(np.int32)), pa.array(np.concatenate([a[2] for a in answers]))]
                found = pa.ListArray.from_arrays(np.r_[0, np.cumsum([len(a[1]) for a in answers])].astype(np.int32), pa.StructArray.from_arrays(parts, fields=list(evidence)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32)), found], names=["doc_id", "score", "predicted", "evidence"])

    return rows.mapInArrow(tidy(run), "doc_id long, score double, predicted int, evidence array<struct<doc_id:long,toxic:int,cosine:double>>")
