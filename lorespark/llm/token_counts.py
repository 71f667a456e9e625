"""Token counts: rollups maintained by deltas, with idempotent batch commits.

The rollup holds additive totals (documents, tokens) by source, language and
tokenizer version.  A batch is a set of change rows ``(op, source, lang,
tokenizer, n_tokens, old_tokens)``: ``insert`` adds, ``delete`` takes away,
``revise`` replaces an old count by a new one.  ``commit`` reduces a batch to
signed sums, writes them aside and moves them to the batch's name by a rename,
whose result counts: a batch that could not be moved raises and is not
committed.  On file systems with atomic renames of folders (HDFS, local ones) of
two writers of one name one wins; on object stores, where a rename copies file
by file, one writer at a time may commit a name.  The totals are the sums over all
committed batches.  A batch that is committed again is recognised by
its name and leaves the totals as they are; a writer that dies leaves no marker
and therefore no totals, and the batch can be committed anew.  ``compact``
folds committed batches into a snapshot that remembers their names.

How it scales: tokenising is a map over whole texts with a public vocabulary
(``tokenizers``, loaded once a worker from a path parameter) that sees a word
once as long as a worker remembers it; every batch is
reduced to at most one row a (source, language, version) by partial sums, so a
hot source costs nothing, and later reads see the reduced rows only.

Defined results: a null or empty text has 0 tokens and still counts as a
document; null source or language are groups of their own; null counts are 0;
an unknown op fails the batch before anything is written; empty batches commit
and change nothing; rows repeated within a batch count each time (a batch's
name, not its rows, is what makes it idempotent).  Extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .near_dup import node
from .shared import checkpointed, scratch, texts_table

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"
VERSION = "byte_bpe_50k"
CHARS_PER_TOKEN = 4
KEYS = ("source", "lang", "tokenizer")
TOTALS = T.StructType([T.StructField(k, T.StringType()) for k in KEYS] + [T.StructField("documents", T.LongType()), T.StructField("tokens", T.LongType())])
#: Texts go to the tokenizer in parts of at most so many characters, cut before a space.
PART = 200_000
#: Words with their space are counted once a worker, of at most ``LONG`` characters and up to so many.
KNOWN, LONG = 500_000, 64
CUT = re.compile(r"(?<=[!-~\u00a1-\u024f]) (?=[!-~\u00a1-\u024f])")


def parts(text: str, size: int = PART) -> Iterator[str]:
    """A long text in parts; a byte-level vocabulary never merges across the space that begins a word."""
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            while end < len(text) and not (text[end] == " " and text[end - 1].isalnum() and text[end + 1 : end + 2].isalnum()):
                end += 1
        yield text[at:end]
        at = end


def words(text: str) -> list[str]:
    """A text cut before single spaces between signs that are no white space; such a space begins a token's word."""
    first, *others = CUT.split(text)
    return [first, *[" " + w for w in others]]


def counter(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
    """A column function that counts the tokens of texts."""

    @F.pandas_udf(T.LongType())
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(os.path.join(folder, vocabulary))
        t.encode_special_tokens = True
        known: dict[str, int] = {}

        def sizes(texts: list[str]) -> list[int]:
            return [len(e.ids) for e in t.encode_batch_fast(texts, add_special_tokens=False)]

        for texts in batches:
            counts = []
            for lo in range(0, len(texts), 64):
                group = [words(x or "") for x in texts.iloc[lo : lo + 64]]
                if len(known) > KNOWN:
                    known.clear()
                new = [w for w in set().union(*group) if w not in known]
                short = [w for w in new if len(w) <= PART]
                known.update(zip(short, sizes(short), strict=True))
                known.update((w, sum(sizes(list(parts(w))))) for w in new if len(w) > PART)
                counts += [sum(map(known.__getitem__, g)) for g in group]
                for w in new:
                    if len(w) > LONG:
                        del known[w]
            yield pd.Series(counts, dtype="int64")

    return tokens


def signed(changes: DataFrame) -> DataFrame:
    """A batch's change rows as signed sums, one row a group."""
    new, old = F.coalesce(F.col("n_tokens"), F.lit(0)), F.coalesce(F.col("old_tokens"), F.lit(0))
    op = F.col("op")
    known = F.when(op.isin("insert", "delete", "revise"), op).otherwise(F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce(op, F.lit("null")))))
    docs = F.when(known == "insert", 1).when(op == "delete", -1).otherwise(0)
    tokens = F.when(op == "insert", new).when(op == "delete", -new).otherwise(new - old)
    return changes.groupBy(*KEYS).agg(F.sum(docs).cast("long").alias("documents"), F.sum(tokens).cast("long").alias("tokens"))


class Rollup:
    """Committed batches in a folder of the shared store."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _listed(self, folder: str) -> list[str]:
        at = self._at(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _done(self, folder: str) -> list[str]:
        return [n for n in self._listed(folder) if self._fs.exists(self._at(f"{self.path}/{folder}/{n}/_SUCCESS"))]

    def _snapshot(self) -> str | None:
        return max(self._done("snapshots"), default=None)

    def _folded(self, s: str | None) -> DataFrame:
        """Names of the batches that a snapshot holds."""
        return self.spark.createDataFrame([], "batch string") if s is None else self.spark.read.schema("batch string").parquet(f"{self.path}/folded/{s}")

    def batches(self) -> DataFrame:
        """Names of all committed batches, folded or not."""
        done = self.spark.createDataFrame([(b,) for b in self._done("batches")], "batch string")
        return self._folded(self._snapshot()).union(done).distinct()

    def committed(self, batch: str) -> bool:
        return self._fs.exists(self._at(f"{self.path}/batches/{batch}/_SUCCESS")) or not self._folded(self._snapshot()).where(F.col("batch") == batch).isEmpty()

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch unless its name is committed already; says whether it did.

        A batch that can't be put in its place raises ``OSError`` and leaves
        nothing.
        """
        if self.committed(batch):
            return False
        own = f"_{uuid.uuid4().hex}"
        signed(changes).select(*TOTALS.names).coalesce(1).write.parquet(f"{self.path}/pending/{own}")
        written, target = self._at(f"{self.path}/pending/{own}"), self._at(f"{self.path}/batches/{batch}")
        if self.committed(batch):
            self._fs.delete(written, True)
            return False
        if self._fs.exists(target) and not self._fs.exists(self._at(f"{target}/_SUCCESS")):
            self._fs.delete(target, True)
        self._fs.mkdirs(target.getParent())
        moved = self._fs.rename(written, target)
        # where another writer's folder was there by then, ours went into it, under a name that readers pass over
        late = self._at(f"{target}/{own}")
        if self._fs.exists(late) or not moved and self.committed(batch):
            self._fs.delete(late, True)
            self._fs.delete(written, True)
            return False
        if not moved or not self.committed(batch):
            self._fs.delete(written, True)
            raise OSError(f"batch {batch} was written, but could not be moved to {target}")
        return True

    def totals(self) -> DataFrame:
        """The current totals; groups without a document or token are left out."""
        return self._summed(*self._state())

    def _state(self) -> tuple[str | None, set[str], list[str]]:
        """The newest snapshot, those of the listed batches that are folded into it, and those that came since."""
        done, s = self._done("batches"), self._snapshot()
        folded = {r["batch"] for r in self._folded(s).where(F.col("batch").isin(done)).collect()} if s is not None and done else set()
        return s, folded, [b for b in done if b not in folded]

    def _summed(self, s: str | None, folded: set[str], since: list[str]) -> DataFrame:
        paths = [f"{self.path}/batches/{b}" for b in since]
        paths += [f"{self.path}/snapshots/{s}"] if s is not None else []
        rows = self.spark.read.schema(TOTALS).parquet(*paths) if paths else self.spark.createDataFrame([], TOTALS)
        return rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where("documents <> 0 or tokens <> 0")

    def compact(self) -> None:
        """Fold the batches committed so far into a new snapshot; the old files may go afterwards.

        Sums and names come from one listing, so a batch that is committed
        meanwhile is in neither.  One process at a time may compact.
        """
        s, folded, since = self._state()
        name = f"{int(s or 0) + 1:010d}"
        self._folded(s).union(self.spark.createDataFrame([(n,) for n in since], "batch string")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/folded/{name}")
        self._summed(s, folded, since).select(*TOTALS.names).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/snapshots/{name}")


def changes(docs: DataFrame, op: str, tokenizer: str, n_tokens: Column, old_tokens: Column | None = None) -> DataFrame:
    """Change rows of one kind for every row of ``docs``."""
    old = F.lit(None) if old_tokens is None else old_tokens
    return docs.select(F.lit(op).alias("op"), "source", "lang", F.lit(tokenizer).alias("tokenizer"), n_tokens.cast("long").alias("n_tokens"), old.cast("long").alias("old_tokens"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches over ``documents``, the second committed twice.

    ``load`` inserts every document with a provisional count of a token a four
    characters, ``count`` revises every provisional count to the tokenizer's,
    ``copies`` deletes all but one row of equal texts (the one with the smallest
    source, language and doc_id stays).
    """
    docs = texts_table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    provisional = F.floor(F.coalesce(F.length("text"), F.lit(0)) / CHARS_PER_TOKEN).cast("long")
    counted = scratch(spark, "token-counts")
    docs.select("doc_id", "source", "lang", node(F.coalesce("text", F.lit(""))).alias("node"), provisional.alias("provisional"), counter()(F.col("text")).alias("n_tokens")).write.parquet(counted)
    rows = spark.read.parquet(counted)
    rollup = Rollup(spark, scratch(spark, "token-rollup"))
    rollup.commit("load", changes(rows, "insert", VERSION, F.col("provisional")))
    revision = changes(rows, "revise", VERSION, F.col("n_tokens"), F.col("provisional"))
    rollup.commit("count", revision)
    rollup.commit("count", revision)
    one = F.struct("source", "lang", "doc_id")
    stays = rows.groupBy("node").agg(F.min(one).alias("stays"), F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = checkpointed(stays)
    gone = rows.join(repeated, "node").where(~one.eqNullSafe(F.col("stays")))
    rollup.commit("copies", changes(gone, "delete", VERSION, F.col("n_tokens")))
    return rollup.totals()
