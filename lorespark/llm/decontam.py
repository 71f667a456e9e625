r"""Benchmark decontamination: size-partitioned MinHash containment search.

An item leaks into a document if at least ``THRESHOLD`` of the item's distinct
``SHINGLE``-word shingles occur in the document (words as in ``words.py``).

Items are partitioned by their number of shingles, in powers of two.  From a
partition's largest size ``u`` follows how many shingles an item of it may
miss, ``floor((1 - t) * u)``; its sketch is one shingle more, those with the
smallest hash values (a bottom-k MinHash).  A document that holds the item
misses fewer shingles than the sketch has, so it hits the sketch for certain,
however much longer than the item it is.  Hits are candidates; the shingles of
their items are then looked for in the document word by word, so a reported
containment is exact.

How it scales: documents pass once through a map, whole, in their own rows,
without a shuffle; what a task holds is one block of items of at most
``BLOCK_WORDS`` words.  More items than that make more blocks, each with a job
of its own that stores the leaks by text and lets the block go before the next
is read, so neither driver nor task ever holds the whole benchmark.

Defined results: texts without ``SHINGLE`` words (null and empty ones too)
neither leak nor hold leaks; repeated documents and repeated items each count
as rows of their own; an empty table on either side gives no pair; other
columns are ignored by the search and kept by ``with_leaks``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .near_dup import node
from .shared import broadcast_if_small, checkpointed, fresh, scratch, table, texts_table
from .words import WORD_PATTERN, mix, ngram_hashes, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
BLOCK_WORDS = 1_000_000
SEED = np.uint64(0x7C3A_55F1_09D2_6E8B)
LEAKS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("shared", T.IntegerType()), T.StructField("shingles", T.IntegerType())]))
_words = re.compile(WORD_PATTERN)


def shingles(text: str | None, n: int = SHINGLE) -> list[str]:
    """Distinct word shingles in order of first occurrence."""
    w = _words.findall((text or "").lower())
    return list(dict.fromkeys(" ".join(w[i : i + n]) for i in range(len(w) - n + 1)))


def sketch_size(size: int, threshold: float) -> int:
    """Shingles that an item of the partition with this size must show."""
    upper = 1 << max(0, size - 1).bit_length()
    return min(size, upper - int(np.ceil(threshold * upper - 1e-9)) + 1)


class Block:
    """A bounded set of items with their sketches, sorted for look-up."""

    def __init__(self, items: list[tuple[int | None, str | None]], n: int = SHINGLE, threshold: float = THRESHOLD):
        self.n, self.threshold = n, threshold
        self.ids: list[int | None] = []
        self.shingles: list[list[str]] = []
        keys, owners = [], []
        for item_id, text in items:
            s = shingles(text, n)
            if not s:
                continue
            h = np.unique(ngram_hashes(word_hashes(text), n))
            h = h[np.argsort(mix(h ^ SEED), kind="stable")[: sketch_size(len(s), threshold)]]
            keys.append(h)
            owners.append(np.full(len(h), len(self.ids)))
            self.ids.append(item_id)
            self.shingles.append(s)
        self.key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.argsort(self.key, kind="stable")
        self.key, self.owner = self.key[order], owner[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.key >> np.uint64(44)).astype(np.int64)] = True

    def candidates(self, text: str | None) -> np.ndarray:
        h = ngram_hashes(word_hashes(text), self.n)
        h = np.unique(h[self.seen[(h >> np.uint64(44)).astype(np.int64)]])
        lo, hi = np.searchsorted(self.key, h, "left"), np.searchsorted(self.key, h, "right")
        found = [self.owner[a:b] for a, b in zip(lo, hi, strict=True) if a < b]
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def leaks(self, text: str | None) -> list[tuple[int | None, int, int]]:
        """(item_id, shared shingles, item's shingles) at or above the threshold."""
        found = self.candidates(text)
        if not len(found):
            return []
        whole = f" {' '.join(_words.findall(text.lower()))} "
        out = []
        for k in found:
            s = self.shingles[k]
            shared = sum(f" {x} " in whole for x in s)
            if shared >= self.threshold * len(s) - 1e-9:
                out.append((self.ids[k], shared, len(s)))
        return out


def blocks(items: DataFrame, n: int = SHINGLE, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> Iterator[Block]:
    """Items in blocks of a bounded size, read one partition at a time."""
    held: list[tuple[int | None, str | None]] = []
    words = 0
    for r in items.select("item_id", "text").toLocalIterator():
        size = len(r["text"] or "") // 2 + 1
        if held and words + size > block_words:
            yield Block(held, n, threshold)
            held, words = [], 0
        held.append((r["item_id"], r["text"]))
        words += size
    if held:
        yield Block(held, n, threshold)


def _search(held: Broadcast):
    """The map over texts that looks for one broadcast block's items."""

    @F.pandas_udf(LEAKS)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(held.value.leaks)

    return found


def with_leaks(docs: DataFrame, items: DataFrame, column: str = "leaks", n: int = SHINGLE, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with an array of ``(item_id, shared, shingles)`` a row."""
    sc = docs.sparkSession.sparkContext
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != column.lower()]
    ahead = blocks(items, n, threshold, block_words)
    block, after = next(ahead, None), next(ahead, None)
    if block is None:
        return docs.select(*kept, F.array().cast(LEAKS).alias(column))
    if after is None:
        return docs.select(*kept, _search(sc.broadcast(block))(F.col("text")).alias(column))
    path, k = scratch(docs.sparkSession, "leaks"), 0
    while block is not None:
        held = sc.broadcast(block)
        found = docs.where(F.col("text").isNotNull()).select(node(F.col("text")).alias("node"), _search(held)(F.col("text")).alias("leaks")).where(F.size("leaks") > 0)
        found.groupBy("node").agg(F.first("leaks").alias("leaks")).select("node", F.lit(k).alias("block"), "leaks").write.parquet(f"{path}/{k}")
        held.destroy()
        block, after, k = after, next(ahead, None), k + 1
    stored = docs.sparkSession.read.parquet(*[f"{path}/{i}" for i in range(k)])
    # as many entries a text as there are blocks
    by_text = stored.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("block", "leaks"))).alias("found"))
    of, more = fresh(docs, "_of"), fresh(docs, "_more")
    by_text = broadcast_if_small(checkpointed(by_text.select(F.col("node").alias(of), F.flatten(F.transform("found", lambda x: x["leaks"])).alias(more))))
    joined = docs.join(by_text, node(F.col("text")) == F.col(of), "left")
    return joined.select(*kept, F.coalesce(F.col(more), F.array().cast(LEAKS)).alias(column))


def find_leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row a leaking pair: ``doc_id, item_id, shared, shingles, containment``."""
    pairs = with_leaks(docs.select("doc_id", "text"), items, **options).select("doc_id", F.explode("leaks").alias("l"))
    return pairs.select("doc_id", "l.item_id", "l.shared", "l.shingles", (F.col("l.shared") / F.col("l.shingles")).alias("containment"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leak of a benchmark item into a document."""
    return find_leaks(texts_table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents)
), b AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
  FROM (SELECT item_id, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark)
), n AS (
  SELECT item_id, count(*) AS n FROM b GROUP BY item_id
), p AS (
  SELECT doc_id, item_id, count(*) AS shared FROM d JOIN b USING (s) GROUP BY doc_id, item_id
)
SELECT doc_id, item_id, CAST(shared AS INTEGER) AS shared, CAST(n AS INTEGER) AS shingles, CAST(shared AS DOUBLE) / n AS containment
FROM p JOIN n USING (item_id)
WHERE shared >= 0.8::DOUBLE * n - 1e-9
"""
