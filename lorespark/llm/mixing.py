r"""Mixing sources to target weights.  [native]

Sizes are counted in words, ``[^\x20\x09-\x0D]+``.  Sources in code-point order
(null last) weigh 1, 2, 3, 1, 2, 3, ... unless ``weights`` are given.  Together
their targets are the total of all sizes; a target stops at ``max_rate`` times
its source's size, and what it can't take is shared again by weight among the
others until none is above its limit.  A source's rate is target / size; every
document is emitted floor(rate) times, and once more if its hash-seeded draw is
below the rate's fraction.

How it scales: one pass aggregates sizes per source (partial sums on the map
side, so a source with a third of all rows is no hot spot); the per-source
table is tiny against the input, is checkpointed, and is broadcast only after
its rows are counted; documents are never shuffled.  Ranking sources uses a
window over that per-source table alone.

Defined results: a null or wordless text has size 0 and draws like the others
(it takes no words either way); a source whose sizes are all 0 has target 0 and
rate 0; a null source is a source of its own; repeated rows draw alike, as the
draw is a function of seed and doc_id (of the text where doc_id is null); an
empty table gives an empty mix.  Extra columns are carried through; the names
the operator adds replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import broadcast_if_small, checkpointed, table

WORD = r"[^\x20\x09-\x0D]+"
MAX_RATE = 3.0
CYCLE = 3
SEED = "mix-1"
ADDED = ("size", "source_size", "target", "rate", "copies", "taken")


def word_count(text: Column) -> Column:
    """Words of a text: boundaries from white space to anything else."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: DataFrame | None = None, max_rate: float = MAX_RATE) -> DataFrame:
    """``(source, source_size, target)`` from per-source sizes.

    The reshared targets have a closed form: with a level L, a source gets
    ``min(max_rate * size, L * weight)``.  Ordered by ``max_rate * size / weight``
    the sources at their limit come first.  Taking the first k for limited, the
    rest would get ``(total - their limits) / weights left`` each; that grows as
    long as limited sources are taken out and falls after, so L is its maximum.
    """
    if weights is None:
        rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
        weighed = sizes.withColumn("weight", ((rank - 1) % CYCLE + 1).cast("double"))
    else:
        w = weights.select(F.col("source").alias("_s"), F.col("weight").cast("double").alias("weight"))
        weighed = sizes.join(w, sizes["source"].eqNullSafe(w["_s"]), "left").drop("_s").fillna({"weight": 0.0})
    limit = F.col("source_size") * F.lit(max_rate)
    at = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    before = at.rowsBetween(Window.unboundedPreceding, -1)
    live = (
        weighed.withColumn("limit", limit)
        .withColumn("ratio", F.when(F.col("weight") > 0, F.col("limit") / F.col("weight")).otherwise(F.lit(float("inf"))))
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("weight_left", F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("size_left", F.col("total") - F.coalesce(F.sum(F.when(F.col("weight") > 0, F.col("limit"))).over(before), F.lit(0.0)))
        .withColumn("here", F.when((F.col("weight") > 0) & (F.col("weight_left") > 0), F.col("size_left") / F.col("weight_left")))
    )
    share = F.coalesce(F.max("here").over(Window.partitionBy()), F.lit(0.0))
    target = F.when(F.col("weight") > 0, F.when(share * F.col("weight") < F.col("limit"), share * F.col("weight")).otherwise(F.col("limit"))).otherwise(F.lit(0.0))
    return live.select("source", "source_size", target.alias("target"))


def draw(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the seed and the document alone."""
    key = F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    hexed = F.substring(F.md5(F.concat(F.lit(seed + ":"), key).cast("binary")), 1, 13)
    return F.conv(hexed, 16, 10).cast("long") / F.lit(float(2**52))


def repetition_plan(docs: DataFrame, weights: DataFrame | None = None, max_rate: float = MAX_RATE, seed: str = SEED) -> DataFrame:
    """Every document once, with ``size, source_size, target, rate, copies, taken``."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ADDED]
    sizes = docs.select("source", word_count(F.col("text")).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = checkpointed(source_targets(checkpointed(sizes), weights, max_rate))
    t = broadcast_if_small(targets.withColumnRenamed("source", "_source"))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_rate)))).otherwise(F.lit(0.0))
    joined = docs.select(*kept, word_count(F.col("text")).alias("size")).join(t, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("rate", rate)
    whole = F.floor("rate")
    copies = whole + (draw(F.col("doc_id"), F.col("text"), seed) < F.col("rate") - whole).cast("long")
    return joined.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies"))


def mix(docs: DataFrame, weights: DataFrame | None = None, max_rate: float = MAX_RATE, seed: str = SEED) -> DataFrame:
    """The mixed corpus: each document as often as its plan says, with ``copy`` from 1."""
    plan = repetition_plan(docs, weights, max_rate, seed)
    columns = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in {*ADDED, "copy"}]
    return plan.where("copies > 0").select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' sizes, targets and taken words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return repetition_plan(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight,
         source_size * 3.0::DOUBLE AS lim, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s
), r AS (
  SELECT *, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS weight_left,
         total - coalesce(sum(lim) OVER b, 0) AS size_left
  FROM w WINDOW b AS (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT *, max(size_left / weight_left) OVER () AS level FROM r
), t AS (
  SELECT source, source_size, least(level * weight, lim) AS target FROM l
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate,
         CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(d.doc_id AS VARCHAR), md5(coalesce(d.text, '')))), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM p
"""
