"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashed words, word pairs, and pairs with
one word skipped, each in one of ``2**BITS`` coordinates.  FTRL-proximal keeps
``z`` and ``n`` for every coordinate, so each has its own learning rate, and
its L1 term leaves most weights at exactly zero; the result is a short list of
(coordinate, weight), small enough to ship to every task.

How it scales: the learner sees at most ``MAX_TRAIN`` labelled documents (those
with the smallest hash of doc_id), already reduced to coordinates in the tasks,
of which the first in that order are taken whose ``MAX_COORDINATES`` fit, and passes over them in one process, as the method is sequential.  Scoring is
one map over the documents with the model in the closure: no shuffle, whole
texts, memory bounded by one Arrow batch and the weight table (4 MB).

Defined results: a null or wordless text has no features and gets the bias's
score; rows with a null doc_id or label are never learned from; if no labelled
row is left, or all carry one label, the model is its bias (0.5 without rows,
else a smoothed share of label 1); a doc_id with several labels counts with the
largest.  Repeated rows score alike.  Extra columns are carried through; an
existing ``score`` column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import checkpointed, scratch, table, texts_table
from .words import ngram_hashes, word_hashes

BITS = 20
MAX_TRAIN = 12_000
#: Coordinates that the learner holds, 4 bytes each.
MAX_COORDINATES = 40_000_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 2.0, 1.0, 8.0, 0.0
THRESHOLD = 0.5
FOLDS = 5


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Distinct coordinates of a text, ascending."""
    w = word_hashes(text)
    salt = np.uint64(0x51ED270B9F1A2C35)
    skips = ngram_hashes(np.stack([w[:-2], w[2:]], 1).ravel(), 2)[::2] ^ salt if len(w) > 2 else w[:0]
    every = np.concatenate([w, ngram_hashes(w, 2), skips])
    return np.unique((every >> np.uint64(64 - bits)).astype(np.int32))


@dataclass
class Model:
    """Sparse weights; ``index`` ascends."""

    bias: float = 0.0
    index: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    bits: int = BITS

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << self.bits, np.float32)
        w[self.index] = self.weight
        return w


def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> Model:
    """FTRL-proximal over binary features, in the order of ``rows``."""
    ones = float(labels.sum())
    if not len(rows) or ones in (0.0, float(len(rows))):
        p = (ones + 0.5) / (len(rows) + 1)
        return Model(float(np.log(p / (1 - p))), bits=bits)
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = 0.0
    for _ in range(epochs):
        for x, y in zip(rows, labels, strict=True):
            zx, nx = z[x], n[x]
            root = np.sqrt(nx)
            w = np.where(np.abs(zx) <= l1, 0.0, -(zx - np.sign(zx) * l1) / ((beta + root) / alpha + l2))
            wb = -zb / ((beta + nb**0.5) / alpha)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + wb, -30, 30))) - y
            g2 = g * g
            z[x] = zx + g - (np.sqrt(nx + g2) - root) / alpha * w
            n[x] = nx + g2
            zb += g - ((nb + g2) ** 0.5 - nb**0.5) / alpha * wb
            nb += g2
    kept = np.flatnonzero(np.abs(z) > l1)
    weight = -(z[kept] - np.sign(z[kept]) * l1) / ((beta + np.sqrt(n[kept])) / alpha + l2)
    return Model(-zb / ((beta + nb**0.5) / alpha), kept.astype(np.int32), weight.astype(np.float32), bits)


def fold(doc_id: Column) -> Column:
    """The contract's fold: 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def labelled(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """At most ``limit`` learnable rows ``(doc_id, text, y, rank)``; ``rank`` orders them pseudo-randomly.

    A doc_id that several documents share brings the text with the smallest hash.
    """
    y = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y")).where("_id is not null and _y is not null")
    y = y.where(fold(F.col("_id")) != 0).groupBy("_id").agg(F.max("_y").alias("y"))
    # the sample is settled on ids alone, so that texts are never shuffled; it is broadcast, as limit bounds it
    order = [F.xxhash64(F.col("_id"), F.lit(17)), F.col("_id")]
    here = y.join(docs.select(F.col("doc_id").alias("_id")), "_id", "left_semi").orderBy(*order).limit(limit)
    chosen = F.broadcast(checkpointed(here))
    found = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("_id"))
    return found.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("y").alias("y")).withColumn("rank", F.xxhash64(F.col("doc_id"), F.lit(17)))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _features_udf(texts: pd.Series) -> pd.Series:
    return texts.map(features)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = MAX_TRAIN, coordinates: int = MAX_COORDINATES) -> Model:
    """Fit on a bounded sample of ``labels`` outside the held-out fold."""
    path = scratch(docs.sparkSession, "toxicity-sample")
    labelled(docs, labels, label, limit).select("rank", "doc_id", _features_udf("text").alias("x"), "y").write.parquet(path)
    sample = docs.sparkSession.read.parquet(path)
    # at most limit rows of three numbers
    sizes = sorted(map(tuple, sample.select("rank", "doc_id", F.size("x")).collect()))
    taken = int(np.searchsorted(np.cumsum([n for _, _, n in sizes]), coordinates, "right"))
    if taken < len(sizes):
        rank, doc_id, _ = sizes[taken]
        sample = sample.where((F.col("rank") < rank) | (F.col("rank") == rank) & (F.col("doc_id") < doc_id))
    found = sample.toArrow()
    # in order without a copy of the coordinates
    order = pc.sort_indices(found, [("rank", "ascending"), ("doc_id", "ascending")]).to_pylist()
    rows = [np.asarray(found["x"][i].values, np.int32) for i in order]
    model = fit(rows, np.asarray(found["y"], np.float64)[order])
    del rows, found
    # what the pool holds back would count against the driver in all later steps
    pa.default_memory_pool().release_unused()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score``, the probability of label 1."""
    index, weight, bias, bits = model.index, model.weight, model.bias, model.bits

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        dense = np.zeros(1 << bits, np.float32)
        dense[index] = weight
        for texts in batches:
            raw = np.array([dense[features(t, bits)].sum(dtype=np.float64) for t in texts], np.float64)
            yield pd.Series(1 / (1 + np.exp(-np.clip(raw + bias, -30, 30))))

    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "score"]
    return docs.select(*kept, scored(F.col("text")).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity."""
    docs = texts_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
