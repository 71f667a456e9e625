"""Vector search, rank fusion and reranking."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..sources.store import scratch, stored

#: Vectors that are scored at a time.
PIECE = 512


def top_k_cosine(vectors: DataFrame, query: list[float] | Column, k: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Best ``k`` of ``vectors`` for one query vector; a scan with a partial top-k in every task."""
    q = F.array(*[F.lit(float(x)) for x in query]) if isinstance(query, list) else query
    return vectors.select(vec_id, scoring.cosine(q, F.col(vector)).alias("score")).orderBy(F.desc("score"), vec_id).limit(k)


def top_k_cosine_many(vectors: DataFrame, queries: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """``(query_id, vec_id, score, rank)``, the best ``k`` of ``vectors(vec_id, embedding)`` for each of ``queries(query_id, q)``.

    Queries are taken in blocks of bounded size, one pass over all vectors a
    block: every task multiplies pieces of ``PIECE`` vectors with the block (16 MB
    of scores at 4,096 queries) and keeps its own
    best ``k`` a query, so what is shuffled is tasks x queries x k rows.  Each
    block's result is stored before the next block is read.  Scores are rounded
    to 12 places, so that equal vectors tie; ties go by id.
    """
    spark = vectors.sparkSession
    out, n, held = scratch(spark, "nearest"), 0, []

    def scan(rows: list) -> None:
        ids, q = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)
        shared = spark.sparkContext.broadcast((ids, q))

        def best(batches):
            query_ids, matrix = shared.value
            top, who = np.full((len(query_ids), k), -1.0), np.zeros((len(query_ids), k), np.int64)
            for pdf in batches:
                for at in range(0, len(pdf), PIECE):
                    piece = pdf.iloc[at : at + PIECE]
                    score = np.round(np.clip(matrix @ np.stack(piece["embedding"].to_numpy()).astype(np.float64).T, 0, 1), 12)
                    better = np.flatnonzero((score >= top[:, -1:]).any(1))  # these queries have a new best, or a tie
                    both = np.concatenate([top[better], score[better]], 1)
                    ids = np.concatenate([who[better], np.broadcast_to(piece["vec_id"].to_numpy(np.int64), (len(better), len(piece)))], 1)
                    order = np.lexsort((ids, -both), axis=1)[:, :k]
                    top[better], who[better] = np.take_along_axis(both, order, 1), np.take_along_axis(ids, order, 1)
            there = top.ravel() >= 0  # fewer than k vectors were seen
            yield pd.DataFrame({"query_id": np.repeat(query_ids, k)[there], "vec_id": who.ravel()[there], "score": top.ravel()[there]})

        scored = vectors.where("embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInPandas(best, "query_id long, vec_id long, score double")
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        scored.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k).write.parquet(f"{out}/{n}")
        shared.destroy()

    for r in queries.select("query_id", "q").toLocalIterator():
        held.append((r[0], [float(x) for x in r[1]]))
        if len(held) == block:
            scan(held)
            held, n = [], n + 1
    if held:
        scan(held)
        n += 1
    schema = "query_id long, vec_id long, score double, rank int"
    return spark.read.schema(schema).parquet(*[f"{out}/{i}" for i in range(n)]) if n else spark.createDataFrame([], schema)


def union_lists(first: DataFrame, second: DataFrame) -> DataFrame:
    """``(id, score)`` of the first list, then of the second what the first lacks."""
    return first.select("id", "score").unionByName(second.select("id", "score").join(first.select("id"), "id", "left_anti"))


def mean_pooling(tokens: Column | str, mask: Column | str) -> Column:
    """The mean of token vectors whose mask is not 0, as a unit vector; zeros where all are masked."""
    t, m = (F.col(c) if isinstance(c, str) else c for c in (tokens, mask))
    live = F.transform(F.filter(F.arrays_zip(t.alias("t"), m.alias("m")), lambda z: z["m"] != 0), lambda z: z["t"])
    dims = F.sequence(F.lit(1), F.size(F.element_at(t, 1)))
    mean = F.transform(dims, lambda d: F.aggregate(live, F.lit(0.0), lambda acc, v: acc + F.element_at(v, d).cast("double")) / F.greatest(F.size(live), F.lit(1)))
    return scoring.unit(mean)


def nearest(vectors: DataFrame, query: list[float], k: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Cosine distance ascending, norms included."""
    q = F.array(*[F.lit(float(x)) for x in query])
    norms = F.sqrt(scoring.dot(vector, vector)) * F.sqrt(scoring.dot(q, q))
    return vectors.select(vec_id, (1 - scoring.dot(q, vector) / norms).alias("distance")).orderBy("distance", vec_id).limit(k)


def rrf(lexical: DataFrame, semantic: DataFrame, k: int = scoring.RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ``(id, rank)`` lists with ranks from 0 (Q3); ties favour the semantic list, then the id."""
    both = lexical.select("id", F.col("rank").alias("lex"), F.lit(None).cast("int").alias("sem")).unionByName(semantic.select("id", F.lit(None).cast("int").alias("lex"), F.col("rank").alias("sem")))
    merged = both.groupBy("id").agg(F.min("lex").alias("lex"), F.min("sem").alias("sem"))
    part = lambda c: F.coalesce(1.0 / (F.lit(float(k)) + F.col(c)), F.lit(0.0))
    return merged.select("id", (part("lex") + part("sem")).alias("score"), F.col("sem").isNotNull().alias("in_semantic")).orderBy(F.desc("score"), F.desc("in_semantic"), "id")


def ranked(scores: DataFrame, limit: int, id_column: str = "id", score: str = "score") -> DataFrame:
    """``(id, rank, score)`` of the best ``limit`` rows, rank from 0."""
    best = scores.select(F.col(id_column).alias("id"), F.col(score).alias("score")).orderBy(F.desc("score"), "id").limit(limit)
    return best.withColumn("rank", (F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1).cast("int"))


def merge_by_type(results: DataFrame, k: int = scoring.RRF_K) -> DataFrame:
    """Fuse results of several types by their rank within the type."""
    w = Window.partitionBy("type").orderBy(F.desc("score"), "id")
    return results.withColumn("score", 1.0 / (F.lit(float(k)) + F.row_number().over(w) - 1)).orderBy(F.desc("score"), "id")


def rerank_fused(fused: DataFrame, query: str) -> DataFrame:
    """Additive bonuses on fused scores with their breakdown; ``fused(id, score, title, tags)``, with ``title_stem`` if it is at hand.

    In field order: exact id, title density and title match, then the tag share
    of the running score (so tags weigh what came before).
    """
    q, terms = query.lower(), text.tokenize(query)
    id_, title, tags = F.lower("id"), F.lower("title"), F.lower("tags")
    literal = F.lit(q)
    words = F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")
    matched = lambda c: F.size(F.filter(words, lambda t: F.contains(c, t))).cast("double")
    out = fused.withColumn("rrf", F.col("score"))
    out = out.withColumn("exact_id", F.when(id_ == literal, 0.10).otherwise(0.0))
    out = out.withColumn("title_density", F.coalesce(matched(title) * 0.03, F.lit(0.0)))
    stem = F.col("title_stem") if "title_stem" in fused.columns else text.stem(title)
    exact = (title == literal) | (stem == F.lit(text.stem_word(q)))
    starts = F.startswith(title, literal) | F.startswith(literal, title)
    out = out.withColumn("exact_title", F.when(exact, 0.15).otherwise(0.0))
    out = out.withColumn("title_starts_with", F.when((F.col("exact_title") == 0) & starts, 0.08).otherwise(0.0))
    out = out.withColumn("title_contains", F.when((F.col("exact_title") == 0) & (F.col("title_starts_with") == 0) & F.contains(title, literal), 0.04).otherwise(0.0))
    before = F.col("rrf") + F.col("exact_id") + F.col("title_density") + F.col("exact_title") + F.col("title_starts_with") + F.col("title_contains")
    share = F.coalesce(matched(tags), F.lit(0.0)) / F.lit(float(max(len(terms), 1)))
    out = out.withColumn("tag_overlap", share * 0.1 * before)
    return out.withColumn("score", before + F.col("tag_overlap"))


def normalise_vectors(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    return vectors.withColumn(vector, scoring.unit(vector))


def carry_forward(new: DataFrame, old: DataFrame, force: bool = False) -> DataFrame:
    """Vectors that needn't be computed again: ``new(id, hash)`` against ``old(id, hash, v)``.

    A row keeps its own vector if its hash is unchanged, takes that of equal
    content under another id (the smallest), or has ``v`` null and must be
    embedded; with ``force`` all must.
    """
    if force:
        return new.select("id", "hash", F.lit(None).cast(old.schema["v"].dataType).alias("v"), F.lit(True).alias("embed"))
    same = old.select(F.col("id"), F.col("hash"), F.col("v").alias("own"))
    by_hash = old.groupBy("hash").agg(F.min_by("v", "id").alias("other"))
    joined = new.select("id", "hash").join(same, ["id", "hash"], "left").join(by_hash, "hash", "left")
    return joined.select("id", "hash", F.coalesce("own", "other").alias("v"), F.coalesce("own", "other").isNull().alias("embed"))


def must_embed_anew(old: dict[str, str], model_modified_at: str = "", chunking_version: str = "") -> bool:
    """Whether stored vectors are void: the model or the chunking changed, or neither was ever noted and there is a model."""
    model, chunking = old.get("model_modified_at", ""), old.get("chunking_version", "")
    if not model and not chunking:
        return bool(model_modified_at)
    return bool(model and model_modified_at and model != model_modified_at) or bool(chunking and chunking != chunking_version)


class VectorStore:
    """Vectors ``(id, hash, v)`` and their metadata in a folder, committed together: a version's name is written last."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _current(self) -> str | None:
        mark = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/current/_SUCCESS")
        if not mark.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
            return None
        return self.spark.read.parquet(f"{self.path}/current").first()["at"]

    def vectors(self) -> DataFrame:
        at = self._current()
        return self.spark.createDataFrame([], "id string, hash string, v array<float>") if at is None else self.spark.read.parquet(f"{at}/vectors")

    def metadata(self) -> dict[str, str]:
        at = self._current()
        return {} if at is None else {r["key"]: r["value"] for r in self.spark.read.parquet(f"{at}/metadata").collect()}

    def commit(self, vectors: DataFrame, metadata: dict[str, str]) -> None:
        at = f"{self.path}/v{uuid.uuid4().hex}"
        vectors.select("id", "hash", F.col("v").cast("array<float>").alias("v")).write.parquet(f"{at}/vectors")
        self.spark.createDataFrame(sorted(metadata.items()), "key string, value string").coalesce(1).write.parquet(f"{at}/metadata")
        self.spark.createDataFrame([(at,)], "at string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/current")

    def refresh(self, docs: DataFrame, embed: Callable[[Column], Column], model_modified_at: str = "", chunking_version: str = "") -> DataFrame:
        """Bring the store in step with ``docs(id, text)``; returns ``(id, embed)``, which rows were embedded.

        Unchanged rows keep their vectors, unless the metadata say that the model
        or the chunking is another; rows that are gone lose theirs.
        """
        old = self.metadata()
        force = must_embed_anew(old, model_modified_at, chunking_version)
        rows = docs.select("id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
        plan = stored(carry_forward(rows, self.vectors(), force), "embed-plan")
        fresh = rows.join(plan.where("embed").select("id"), "id", "left_semi").select("id", "hash", scoring.unit(embed(F.col("text"))).alias("v"))
        kept = plan.where("not embed").select("id", "hash", "v")
        noted = {"model_modified_at": model_modified_at or old.get("model_modified_at", ""), "chunking_version": chunking_version or old.get("chunking_version", "")}
        self.commit(kept.unionByName(fresh), noted)
        return plan.select("id", "embed")


def upsert(table: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """``table`` with rows of ``changes`` in place of those with the same key."""
    return table.join(changes.select(key).distinct(), key, "left_anti").unionByName(changes)


def reconcile(table: DataFrame, live: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``table`` whose key is still alive."""
    return table.join(live.select(key).distinct(), key, "left_semi")


def hashed_embedding(words: Column, dims: int = 64) -> Column:
    """A deterministic stand-in embedder: signed hashed token counts, unit length."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    dimension = lambda i: F.aggregate(hashes, F.lit(0.0), lambda acc, h: acc + F.when(F.pmod(h, F.lit(dims)) == i, F.when(F.shiftright(h, 62) % 2 == 0, 1.0).otherwise(-1.0)).otherwise(0.0))
    return scoring.unit(F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), dimension))


def batches(docs: DataFrame, max_docs: int = 32, max_tokens: int = 32768) -> DataFrame:
    """``docs(id, text)`` with ``batch``: consecutive ids of a hash bucket within both limits' running sums.

    A bucket is a task's share; a batch never exceeds ``max_docs`` documents or
    ``max_tokens`` words by more than its last document.
    """
    size = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda t: t != ""))
    rows = docs.withColumn("tokens", size).withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(1024)))
    w = Window.partitionBy("bucket").orderBy("id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    by_docs = F.floor((F.row_number().over(w) - 1) / max_docs)
    by_tokens = F.floor(F.coalesce(F.sum("tokens").over(before), F.lit(0)) / max_tokens)
    return rows.withColumn("batch", F.struct("bucket", by_docs.alias("by_docs"), by_tokens.alias("by_tokens"))).drop("bucket")


def embeddings_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, v array<float>, hash string").parquet(path)
