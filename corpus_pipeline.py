"""Corpus pipeline: quality, toxicity, near duplicates, benchmark leaks, mixing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes every stage's result as Parquet in the shared folder and reads it again
as the next stage's documents, so a lost executor never repeats an earlier
stage.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm import decontam, mixing, near_dup, quality, toxicity
from lorespark.llm.shared import fresh, scratch, table


def _passing(scored: DataFrame, docs: DataFrame, good) -> DataFrame:
    return scored.where(good).select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose quality score is below the classifier's threshold."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return _passing(quality.score(docs, model), docs, F.col("score") >= quality.THRESHOLD)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose toxicity score reaches the classifier's threshold."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return _passing(toxicity.score(docs, model), docs, F.col("score") < toxicity.THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate class."""
    return near_dup.deduplicate(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    column = fresh(docs, "leaks")
    found = decontam.with_leaks(docs, table(spark, sf_dir, "benchmark"), column=column)
    return _passing(found, docs, F.size(column) == 0)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents to their sources' target weights; ``copy`` counts from 1."""
    return mixing.mix(docs)


STAGES = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mix", mix_sources),
]

#: Learned classifiers and alignments have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed corpus of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
