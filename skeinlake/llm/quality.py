"""Quality classifier: hierarchical empirical Bayes over documents, site sections and sites."""

from __future__ import annotations

import operator
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import ship
from .common import broadcast_if_small, materialize, shield, tidy

#: Labelled documents that the document classifier is fitted on, at most; which ones follows a hash of doc_id.
FIT_ROWS = 20_000


#: What is counted in a text, and whether it is held against the words or the characters.
COUNTED = {"odd": "chars", "upper": "chars", "digits": "chars", "bang": "words", "bar": "words", "again": "words"}
ODD = "%*&$#@^~=<>[]{}\\/_+`"
_UPPER, _DIGIT = re.compile("[A-ZÄÖÜÁÉÍÓÚÀÈÙÂÊÎÔÛÇÑ]"), re.compile("[0-9]")


def measure(text: str | None) -> tuple[int, ...]:
    """Words, characters, odd marks, capitals, digits, doubled exclamation marks, lone bars, words that repeat the one before."""
    text = text or ""
    words = text.split()
    return (
        len(words), len(text), sum(map(text.count, ODD)), len(_UPPER.findall(text)), len(_DIGIT.findall(text)), text.count("!!"), words.count("|"), sum(map(operator.eq, words, words[1:])),
    )


def with_counts(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs (all) with _q_words, _q_chars and a _q_ column for each entry of COUNTED."""
    ship(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    names = ["_q_words", "_q_chars", *[f"_q_{n}" for n in COUNTED]]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(n, T.LongType()) for n in names])
    places, at = [docs.columns.index(c) for c in keep], docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [measure(x.as_py()) for x in batch.column(at)]
            own = [pa.array(c, pa.int64()) for c in (zip(*counts, strict=True) if counts else [[]] * len(names))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in places), *own], names=[*keep, *names])

    return docs.mapInArrow(tidy(run), schema)


def features() -> dict[str, Column]:
    """Shares of a text, from with_counts(), that depend neither on its topic nor on its language; all 0 where there are no words."""
    return {n: F.when(F.col(f"_q_{of}") > 0, F.col(f"_q_{n}") / F.col(f"_q_{of}")).otherwise(0.0) for n, of in COUNTED.items()}


@dataclass
class Fit:
    """Logistic regression on standardised features; llr() takes the classes' share out again."""

    names: list[str]
    weights: np.ndarray
    bias: float
    mean: np.ndarray
    scale: np.ndarray
    rate: float

    def llr(self) -> Column:
        """Log likelihood ratio good : bad from the columns of with_counts(), within +-20; 0 for a text without words."""
        found = features()
        total = F.lit(float(self.bias - np.log(self.rate / (1 - self.rate))))
        for n, w, m, s in zip(self.names, self.weights, self.mean, self.scale, strict=True):
            total = total + F.lit(float(w)) * (found[n] - F.lit(float(m))) / F.lit(float(s))
        return F.when(F.col("_q_words") > 0, F.greatest(F.lit(-20.0), F.least(F.lit(20.0), total))).otherwise(0.0)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS) -> Fit:
    """Newton steps for a ridge logistic regression on at most rows labelled documents."""
    names = list(features())
    known = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("double").alias("y")).where("id is not null and y in (0, 1)")
    known = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(rows)
    found = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("id"))  # at most rows rows
    data = np.array([list(r) for r in with_counts(found).select("y", *[c.alias(n) for n, c in features().items()]).collect()], dtype=float)
    if len(data) == 0 or len(set(data[:, 0])) < 2:
        return Fit(names, np.zeros(len(names)), 0.0, np.zeros(len(names)), np.ones(len(names)), 0.5)
    y, x = data[:, 0], data[:, 1:]
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = z.T * (p * (1 - p)) @ z + np.diag([1e-6] + [1.0] * len(names))
        step = np.linalg.solve(h, z.T @ (y - p) - np.r_[0.0, w[1:]])
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return Fit(names, w[1:], float(w[0]), mean, scale, float(np.clip(y.mean(), 0.01, 0.99)))


def _strength(groups: DataFrame, parent: Column) -> float:
    """Size of the Beta prior by the method of moments: how far the rates of groups lie from the parents' beyond chance."""
    r = groups.select((F.col("good") / F.col("n")).alias("rate"), "n", parent.alias("mu")).agg(
        F.sum(F.col("n") * F.pow(F.col("rate") - F.col("mu"), 2)).alias("spread"), F.sum(F.col("mu") * (1 - F.col("mu"))).alias("chance"),
        F.sum(F.col("n") * F.col("mu") * (1 - F.col("mu"))).alias("all"), F.sum("n").alias("n"), F.count("*").alias("k"),
    ).first()
    if not r["k"] or not r["n"]:
        return 10.0
    between = (r["spread"] - r["chance"]) / r["n"]
    within = r["all"] / r["n"]
    return float(np.clip(within / between - 1, 2.0, 1e4)) if between > 0 and within > 0 else 1e4


def site_rates(evidence: DataFrame, rate: float) -> DataFrame:
    """(host, path, host_rate, path_rate, weight) from (host, path, llr): path posteriors shrunk to their host's, hosts' to the whole corpus's.

    One grouped aggregation over the documents with partial sums before the shuffle; the rest works on its result.
    """
    good = 1 / (1 + F.exp(-(F.col("llr") + F.lit(float(np.log(rate / (1 - rate)))))))
    paths = materialize(evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(good).alias("good")), "sites")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    all_ = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    mu = float((all_["good"] + rate) / (all_["n"] + 1)) if all_["n"] else rate
    k = _strength(hosts, F.lit(mu))
    hosts = hosts.withColumn("host_rate", (F.col("good") + k * mu) / (F.col("n") + k)).select(F.col("host").alias("h"), "host_rate")
    both = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    k = _strength(both, F.col("host_rate"))
    weight = F.col("n") + F.lit(k)
    return materialize(both.select("host", "path", "host_rate", ((F.col("good") + k * F.col("host_rate")) / weight).alias("path_rate"), weight.alias("weight")), "rates")


def _others(rate: float) -> Column:
    """The section's posterior from all documents but the row's own, whose evidence would count twice otherwise."""
    own = 1 / (1 + F.exp(-(F.col("_q_llr") + F.lit(float(np.log(rate / (1 - rate)))))))
    return (F.col("_q_path_rate") * F.col("_q_weight") - own) / (F.col("_q_weight") - 1)


def _posterior() -> Column:
    p = F.least(F.greatest("_q_path_rate", F.lit(1e-6)), F.lit(1 - 1e-6))
    return 1 / (1 + F.exp(-(F.col("_q_llr") + F.log(p / (1 - p)))))


def _with_scores(docs: DataFrame, labels: DataFrame, host: str, path: str, text: str, with_text: bool) -> DataFrame:
    model = fit(docs.select("doc_id", F.col(text).alias("text")), labels)
    keep = [c for c in docs.columns if with_text or c != text]
    own = with_counts(docs, text, keep).select(*keep, model.llr().alias("_q_llr"))
    own = materialize(own, "evidence")  # so that the texts are read once
    rates = site_rates(own.select(F.col(host).alias("host"), F.col(path).alias("path"), F.col("_q_llr").alias("llr")), model.rate)
    rates = broadcast_if_small(rates.select(*[F.col(c).alias(f"_q_{c}") for c in rates.columns]))
    joined = own.join(rates, F.col(host).eqNullSafe(F.col("_q_host")) & F.col(path).eqNullSafe(F.col("_q_path")))
    return joined.withColumn("_q_path_rate", _others(model.rate)).withColumn("_q_score", _posterior())


def score(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, llr, host_rate, path_rate, score, keep) of each row of docs.

    llr is the document classifier's evidence, host_rate and path_rate the posteriors of the site and, from its other documents, of its section,
    score the posterior probability that the document is good, keep whether that reaches threshold.

    Null or empty text: no evidence (llr 0), so the section's rate decides. Null host or path: a site of its own. Repeated rows
    count and are scored each. Without labels of both kinds there is no evidence and all is kept.
    Empty table: no rows. Other columns are ignored.
    """
    slim = docs.select("doc_id", host, path, text)
    return _with_scores(slim, labels, host, path, text, False).select(
        "doc_id", F.col("_q_llr").alias("llr"), F.col("_q_host_rate").alias("host_rate"), F.col("_q_path_rate").alias("path_rate"), F.col("_q_score").alias("score"), (F.col("_q_score") >= threshold).alias("keep")
    )


def keep_good(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all of their columns, that score() keeps."""
    own, restore = shield(docs, ("doc_id", host, path, text))
    return restore(_with_scores(own, labels, host, path, text, True).where(F.col("_q_score") >= threshold))
