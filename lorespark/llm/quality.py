"""Quality classifier: gated-attention multiple-instance learning over passages.

A document is a bag of passages of ``PASSAGE`` words.  Every passage becomes a
fixed vector (hashed byte pairs and a few shape shares), a learned layer
encodes it, gated attention weighs the encodings (softmax over the document of
``w . (tanh(V h) * sigmoid(U h))``), and a logistic layer scores the weighted
sum.  Only document labels are used; the attention finds the passages that
decide.

How it scales: the learner sees every passage of at most ``MAX_TRAIN`` labelled
documents, those with the smallest hash of doc_id; the first that would bring
the sample above ``MAX_PASSAGES`` passages ends it.  It runs in
one process, as the sample is bounded.  Scoring is one
map over the documents: no shuffle, whole texts, and memory bounded by one
Arrow batch, as texts pass through in pieces and attention is a running softmax.

Defined results: a null, empty or blank text is one passage without bytes and
scores like any other; rows with a null doc_id or label are never learned from;
without labelled rows, or with one label only, all texts get the smoothed share
of label 1 (0.5 without rows); a doc_id with several labels counts with the
largest.  Repeated rows score alike.  Extra columns are carried through; an
existing ``score`` column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import scratch, table, texts_table
from .toxicity import fold, labelled
from .words import hash_spans, pieces, spans

PASSAGE = 96
PAIRS = 256
SHAPES = 9
WIDTH = PAIRS + SHAPES
HIDDEN, GATE = 24, 12
MAX_TRAIN = 3_000
MAX_PASSAGES = 60_000
EPOCHS, RATE, DECAY, BATCH = 30, 3e-3, 1e-3, 64
THRESHOLD = 0.3

_NOT_SPACE = np.ones(256, bool)
_NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
_KIND = np.zeros((256, 4), np.float32)  # upper, digit, other ASCII sign, above ASCII
_KIND[65:91, 0] = 1
_KIND[48:58, 1] = 1
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)], 2] = 1
_KIND[128:, 3] = 1


def _vectors(b: np.ndarray, passage: int) -> np.ndarray:
    """One row a passage for a piece of a text."""
    starts, ends = spans(b, _NOT_SPACE)
    n = max(1, -(-len(starts) // passage))
    out = np.zeros((n, WIDTH), np.float32)
    if not len(starts):
        return out
    at = np.zeros(len(b), np.int32)
    at[starts[passage::passage]] = 1
    np.cumsum(at, out=at)
    kinds = b.astype(np.int32)
    pair = ((kinds[:-1] * 31 + kinds[1:] * 7) ^ (kinds[:-1] >> 3)) & (PAIRS - 1)
    counts = np.bincount(at[1:] * PAIRS + pair, minlength=n * PAIRS).reshape(n, PAIRS)
    size = np.bincount(at, minlength=n).astype(np.float32)
    out[:, :PAIRS] = np.sqrt(counts / size[:, None])
    for k in range(4):
        out[:, PAIRS + k] = np.bincount(at, weights=_KIND[b, k], minlength=n) / size
    # words that repeat within the passage, and their mean length
    where = np.arange(len(starts)) // passage
    key = hash_spans(b, starts, ends) ^ (where.astype(np.uint64) << np.uint64(40))
    order = np.argsort(key)
    first = np.ones(len(key), bool)
    first[order[1:]] = key[order[1:]] != key[order[:-1]]
    words = np.bincount(where, minlength=n).astype(np.float32)
    out[:, PAIRS + 4] = np.bincount(where, weights=first, minlength=n) / words
    out[:, PAIRS + 5] = np.bincount(where, weights=ends - starts, minlength=n) / words / 10
    out[:, PAIRS + 6] = np.bincount(where, weights=b[ends - 1] == 46, minlength=n) / words
    out[:, PAIRS + 7] = np.minimum(words / passage, 1)
    h = key ^ (where.astype(np.uint64) << np.uint64(40))
    same = np.concatenate(([False], h[1:] == h[:-1]))
    out[:, PAIRS + 8] = np.bincount(where, weights=same, minlength=n) / words
    return out


def passage_vectors(text: str | None, passage: int = PASSAGE) -> Iterator[np.ndarray]:
    """Blocks of passage vectors that together cover the whole text."""
    b = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    if not len(b):
        yield np.zeros((1, WIDTH), np.float32)
    for p in pieces(b, _NOT_SPACE):
        yield _vectors(p, passage)


class Model:
    """Weights of encoder, attention and classifier; ``fit`` learns them."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        self.prior: float | None = None
        self.mean = np.zeros(WIDTH, np.float32)
        self.scale = np.ones(WIDTH, np.float32)
        self.p = {
            "W": r.normal(0, WIDTH**-0.5, (WIDTH, HIDDEN)), "b": np.zeros(HIDDEN),
            "V": r.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "U": r.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "w": r.normal(0, GATE**-0.5, GATE),
            "c": r.normal(0, HIDDEN**-0.5, HIDDEN), "d": np.zeros(1),
        }

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Encodings, gates' two factors and attention logits of passages."""
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        return h, t, s, (t * s) @ p["w"]

    def score(self, text: str | None) -> float:
        """Running softmax over the passages, so that memory doesn't follow the text."""
        if self.prior is not None:
            return self.prior
        top, total, bag = -np.inf, 0.0, np.zeros(HIDDEN)
        for x in passage_vectors(text):
            h, _, _, e = self.encode((x - self.mean) * self.scale)
            new = max(top, float(e.max()))
            a = np.exp(e - new)
            keep = np.exp(top - new)
            total, bag, top = total * keep + a.sum(), bag * keep + a @ h, new
        return float(1 / (1 + np.exp(-np.clip(bag / total @ self.p["c"] + self.p["d"][0], -30, 30))))

    def gradients(self, bags: list[np.ndarray], y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss over scaled bags, by parameter."""
        p, sizes = self.p, np.array([len(x) for x in bags])
        begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        bag = np.repeat(np.arange(len(bags)), sizes)
        x = np.concatenate(bags)
        h, t, s, e = self.encode(x)
        a = np.exp(e - np.maximum.reduceat(e, begin)[bag])
        a /= np.add.reduceat(a, begin)[bag]
        z = np.add.reduceat(a[:, None] * h, begin)
        q = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"][0], -30, 30)))
        g = (q - y) / len(bags)
        gz = g[:, None] * p["c"]
        dot = (gz[bag] * h).sum(1)
        ge = a * (dot - np.add.reduceat(a * dot, begin)[bag])
        gt, gs = ge[:, None] * p["w"] * s * (1 - t * t), ge[:, None] * p["w"] * t * s * (1 - s)
        gh = (a[:, None] * gz[bag] + gt @ p["V"].T + gs @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ gh, "b": gh.sum(0), "V": h.T @ gt, "U": h.T @ gs, "w": (t * s).T @ ge, "c": z.T @ g, "d": np.array([g.sum()])}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, decay: float = DECAY, seed: int = 5) -> Model:
        """Adam on the log loss of whole bags."""
        ones = float(y.sum())
        if not len(bags) or ones in (0.0, float(len(bags))):
            self.prior = (ones + 0.5) / (len(bags) + 1)
            return self
        every = np.concatenate(bags)
        self.mean = every.mean(0)
        self.scale = (1 / (every.std(0) + 0.02)).astype(np.float32)
        bags = [((x - self.mean) * self.scale) for x in bags]
        p = self.p
        p["d"][0] = np.log((ones + 0.5) / (len(bags) - ones + 0.5))
        m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
        r = np.random.default_rng(seed)
        for _ in range(epochs):
            order = r.permutation(len(bags))
            for lo in range(0, len(order), BATCH):
                ids = order[lo : lo + BATCH]
                grads = self.gradients([bags[i] for i in ids], y[ids])
                step += 1
                for k, grad in grads.items():
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad * grad
                    p[k] -= rate * (m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8) + decay * p[k])
        return self


def train_vectors(text: str | None) -> np.ndarray:
    """The vectors of all passages of a text."""
    return np.concatenate(list(passage_vectors(text)))


@F.pandas_udf(T.BinaryType())
def _train_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: train_vectors(t).astype("<f2").tobytes())


def fitting(sizes: list[int], most: int) -> int:
    """How many of the bags, in order, stay within ``most`` together; the first that doesn't ends it, so none is taken for being short."""
    return int(np.searchsorted(np.cumsum(sizes), most, "right"))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = MAX_TRAIN, passages: int = MAX_PASSAGES) -> Model:
    """Fit on a bounded sample of ``labels`` outside the held-out fold."""
    path = scratch(docs.sparkSession, "quality-sample")
    labelled(docs, labels, label, limit).select("rank", "doc_id", _train_udf("text").alias("x"), "y").write.parquet(path)
    sample = docs.sparkSession.read.parquet(path)
    # at most limit rows of three numbers
    sizes = sorted(map(tuple, sample.select("rank", "doc_id", F.octet_length("x") / (2 * WIDTH)).collect()))
    taken = fitting([int(n) for _, _, n in sizes], passages)
    if taken < len(sizes):
        rank, doc_id, _ = sizes[taken]
        sample = sample.where((F.col("rank") < rank) | (F.col("rank") == rank) & (F.col("doc_id") < doc_id))
    sample = sample.toArrow().sort_by([("rank", "ascending"), ("doc_id", "ascending")])
    bags = [np.frombuffer(v.as_py(), "<f2").reshape(-1, WIDTH).astype(np.float32) for v in sample["x"]]
    y = np.asarray(sample["y"], np.float64)
    del sample
    model = Model().fit(bags, y)
    # what the pool holds back would count against the driver in all later steps
    pa.default_memory_pool().release_unused()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score``, the probability of label 1."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([model.score(t) for t in texts], dtype="float64")

    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "score"]
    return docs.select(*kept, scored(F.col("text")).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality."""
    docs = texts_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
