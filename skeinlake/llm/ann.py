"""Approximate nearest neighbours by additive quantisation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import ship
from .common import materialize, tidy

#: Vectors that the codebooks are fitted on, at most; which ones follows a hash of vec_id.
FIT_ROWS = 8192
BOOKS, WORDS, BEAM = 12, 256, 4
#: Rows and queries that a search task holds.
ROW_BLOCK, QUERY_BLOCK = 16_384, 4096
#: Candidates of a block that are scored exactly for each query: one in twenty.
RERANK = 800


@dataclass
class Codebooks:
    """Full-dimensional codebooks whose chosen words add up to the vector."""

    words: np.ndarray  # books, words, dimensions

    def __post_init__(self):
        flat = self.words.reshape(-1, self.words.shape[2])
        self.cross = (flat @ flat.T).astype(np.float32)
        self.norms = np.einsum("ij,ij->i", flat, flat).astype(np.float32)

    def __reduce__(self):
        return Codebooks, (self.words,)  # the products are made again where they are used

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes by beam search: book after book, the beam's best sums by squared error are kept."""
        books, k, d = self.words.shape
        flat = self.words.reshape(-1, d).astype(np.float32)
        out = np.empty((len(x), books), np.uint8 if k <= 256 else np.uint16)
        for at in range(0, len(x), 512):
            part = x[at : at + 512].astype(np.float32)
            n = len(part)
            dots = part @ flat.T
            codes = np.zeros((n, 1, 0), np.int64)
            error = np.zeros((n, 1), np.float32)
            for b in range(books):
                own = slice(b * k, (b + 1) * k)
                total = error[:, :, None] + (self.norms[own] - 2 * dots[:, own])[:, None, :]
                for c in range(b):
                    total = total + 2 * self.cross[codes[:, :, c] + c * k, own]
                flat_total = total.reshape(n, -1)
                keep = min(beam, flat_total.shape[1])
                best = np.argpartition(flat_total, keep - 1, axis=1)[:, :keep]
                error = np.take_along_axis(flat_total, best, 1)
                before, word = best // k, best % k
                codes = np.concatenate([np.take_along_axis(codes, before[:, :, None], 1), word[:, :, None]], 2) if b else word[:, :, None]
            out[at : at + n] = codes[np.arange(n), error.argmin(1)]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.words[b][codes[:, b]] for b in range(len(self.words)))


def fit(x: np.ndarray, books: int = BOOKS, k: int = WORDS, rounds: int = 2, seed: int = 7) -> Codebooks:
    """Residual k-means for a start; then, in turn, beam-search encoding and least squares for all words at once."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    rest, found = x.copy(), []
    for _ in range(books):
        centre = rest[rng.choice(len(rest), k, replace=False)]
        for _ in range(8):
            near = ((centre * centre).sum(1) - 2 * rest @ centre.T).argmin(1)
            count = np.bincount(near, minlength=k)
            sums = np.zeros_like(centre)
            np.add.at(sums, near, rest)
            centre = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], rest[rng.choice(len(rest), k)])
        near = ((centre * centre).sum(1) - 2 * rest @ centre.T).argmin(1)
        rest = rest - centre[near]
        found.append(centre)
    now = Codebooks(np.array(found))
    for _ in range(rounds):
        codes = now.encode(x) + (np.arange(books) * k).astype(np.int64)
        gram = np.zeros((books * k, books * k))
        for b in range(books):
            for c in range(books):
                np.add.at(gram, (codes[:, b], codes[:, c]), 1.0)
        right = np.zeros((books * k, x.shape[1]))
        for b in range(books):
            np.add.at(right, codes[:, b], x)
        old = now.words.reshape(-1, x.shape[1])
        # a little weight on the words as they are, for those that few vectors use
        gram[np.diag_indices_from(gram)] += 0.5
        now = Codebooks(np.linalg.solve(gram, right + 0.5 * old).reshape(books, k, -1))
    return now


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows that take part: no null, zero or non-finite component vector, and of the table's most frequent dimension."""
    x = F.transform(F.col(embedding), lambda c: c.cast("double"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x")).where("vec_id is not null and x is not null and size(x) > 0")
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.where(F.coalesce(finite, F.lit(False)) & F.exists("x", lambda c: c != 0))
    top = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.where(F.size("x") == (top["d"] if top else 0))


def search(
    vectors: DataFrame, every: int = 20, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", rerank: int = RERANK, fit_rows: int = FIT_ROWS, measure: str = "ip", row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row whose vec_id is divisible by every.

    Codebooks are fitted on at most fit_rows rows; every row is encoded and stored with the norm of its code's sum. Rows and queries
    are dealt into blocks; each pair of blocks meets in one task of bounded size. There, lookup tables of the queries' products
    with all words score the codes (measure ip: inner product; l2: twice that less the stored norm), the rerank best
    are scored exactly in double precision on the vectors themselves, and k of them go on. Their merge is a top k over
    k rows from each block.

    Rows that are null, zero, not finite or of another dimension than most take no part. A query is never its own neighbour; with repeated vec_ids every row of that id counts as the query's own,
    rows that repeat an id come once (their best), and fewer candidates than k give fewer rows. Ties go to the smaller vec_id. Empty table: no rows.
    """
    ship(vectors.sparkSession)
    rows = usable(vectors, vec_id, embedding)
    schema = "query_id long, vec_id long, score double"
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit_rows).select("x").toPandas()["x"]
    if not len(sample):
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    books = fit(np.array(sample.tolist(), dtype=np.float64))
    dims = books.words.shape[2]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dims)
            codes = books.encode(x)
            norms = (books.decode(codes) ** 2).sum(1) if len(x) else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in x], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms, pa.float64())], names=["vec_id", "x", "code", "norm"])

    index = materialize(rows.mapInArrow(tidy(encode), "vec_id long, x binary, code binary, norm double"), "index")
    asked = index.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), F.col("x").alias("q")).groupBy("query_id").agg(F.max("q").alias("q"))
    row_blocks = max(1, -(-index.count() // row_block))
    query_blocks = max(1, -(-asked.count() // query_block))
    deal = lambda id_, n: F.pmod(F.xxhash64(id_, F.lit(3)), F.lit(n)).cast("int")
    left = index.withColumn("rb", deal("vec_id", row_blocks)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = asked.withColumn("qb", deal("query_id", query_blocks)).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
    kind = np.uint8 if books.words.shape[1] <= 256 else np.uint16

    def meet(own: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(own) or not len(ask):
            return empty
        own = own.sort_values("vec_id", kind="stable")
        ids = own["vec_id"].to_numpy()
        x = np.frombuffer(b"".join(own["x"]), np.float64).reshape(-1, dims)
        codes = np.frombuffer(b"".join(own["code"]), kind).reshape(len(own), -1).astype(np.int64)
        norms = own["norm"].to_numpy(np.float32)
        by_book = [np.ascontiguousarray(codes[:, b]) for b in range(codes.shape[1])]
        q = np.frombuffer(b"".join(ask["q"]), np.float64).reshape(-1, dims)
        tables = (q @ books.words.reshape(-1, dims).T).astype(np.float32).reshape(len(q), len(books.words), -1)
        out = []
        for query_id, vector, table in zip(ask["query_id"].to_numpy(), q, tables, strict=True):
            score = table[0][by_book[0]]
            for b in range(1, len(by_book)):
                score = score + table[b][by_book[b]]
            if measure == "l2":
                score = 2 * score - norms
            score[ids == query_id] = -np.inf
            keep = np.argpartition(-score, rerank)[:rerank] if len(score) > rerank else np.arange(len(score))
            keep = np.sort(keep[ids[keep] != query_id])
            exact = x[keep] @ vector if measure == "ip" else -((x[keep] - vector) ** 2).sum(1)
            order = np.lexsort((ids[keep], -exact))
            _, first = np.unique(ids[keep][order], return_index=True)
            best = order[np.sort(first)][:k]
            out.append((np.full(len(best), query_id), ids[keep][best], exact[best]))
        return pd.DataFrame({c: np.concatenate(v) for c, v in zip(("query_id", "vec_id", "score"), zip(*out, strict=True), strict=True)})

    found = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInPandas(meet, schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return merged.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
