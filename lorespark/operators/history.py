"""Versions, field diffs, source lifecycle, and content-hash change sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring

KEEP = {"task": 3, "doc": 10}
STABILITY = {"task": 7.0, "doc": 30.0}
DROP_BELOW = 0.15
ORPHAN_MINUTES = 30


def field_changes(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``(key, field, old_value, new_value)`` where the value differs, nulls included; values as text."""
    tall = lambda df, name: df.select(key, F.explode(F.map_from_entries(F.array(*[F.struct(F.lit(f), F.col(f).cast("string")) for f in fields]))).alias("field", name))
    joined = tall(old, "old_value").join(tall(new, "new_value"), [key, "field"], "full_outer")
    return joined.where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def newest(versions: DataFrame, k: int, entity: str = "entity_id", version: str = "version") -> DataFrame:
    """The ``k`` newest versions of every entity."""
    w = Window.partitionBy(entity).orderBy(F.desc(version))
    return versions.withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= k).drop("_at")


def append_version(versions: DataFrame, changes: DataFrame) -> DataFrame:
    """New versions after each entity's last; ``changes(entity_id, timestamp, author, changes)``."""
    last = versions.groupBy("entity_id").agg(F.max("version").alias("_last"))
    w = Window.partitionBy("entity_id").orderBy("timestamp")
    new = changes.join(last, "entity_id", "left").withColumn("version", (F.coalesce("_last", F.lit(0)) + F.row_number().over(w)).cast("int")).withColumn("compacted", F.lit(False)).drop("_last")
    return versions.unionByName(new.select(*versions.columns))


def compact(versions: DataFrame, kind: str, now: Column, strict_compat: bool = False) -> DataFrame:
    """Drop faded old versions beyond the newest ``KEEP`` of each entity.

    A version's score is ``1 / (1 + age / stability)``; old ones below
    ``DROP_BELOW`` go, and for documents one marker row (``compacted``) stands
    for them.  With ``strict_compat`` the others beyond the newest go, too (Q14).
    """
    keep = KEEP[kind]
    w = Window.partitionBy("entity_id").orderBy(F.desc("version"))
    age = (F.unix_timestamp(now) - F.unix_timestamp(F.to_timestamp("timestamp"))) / 86400
    rows = versions.withColumn("_at", F.row_number().over(w)).withColumn("_score", scoring.version_score(age, STABILITY[kind]))
    faded = (F.col("_at") > keep) & (F.lit(True) if strict_compat else F.col("_score") < DROP_BELOW)
    out = rows.where(~faded).drop("_at", "_score")
    if kind == "doc":
        gone = rows.where(faded)
        marker = gone.withColumn("_last", F.max("version").over(Window.partitionBy("entity_id"))).where("version = _last").withColumn("compacted", F.lit(True)).withColumn("changes", F.slice("changes", 1, 0))
        out = out.unionByName(marker.select(*versions.columns))
    return out.select(*versions.columns)


def rollback(versions: DataFrame, target: int) -> DataFrame:
    """Field values to restore for ``target``: of every field's earliest later change the old value."""
    later = versions.where(F.col("version") > target).select("entity_id", "version", F.explode("changes").alias("c"))
    return later.groupBy("entity_id", F.col("c.field").alias("field")).agg(F.min_by("c.old_value", "version").alias("value"))


# ---- sources -----------------------------------------------------------------


def add_sources(sources: DataFrame, files: DataFrame, now: Column) -> DataFrame:
    """Register ``files(path, content_hash)`` that aren't known by hash or path."""
    new = discover(sources, files)
    w = Window.partitionBy("content_hash").orderBy("path")
    new = new.withColumn("_at", F.row_number().over(w)).where("_at = 1")
    made = new.select(F.concat(F.lit("src_"), F.substring("content_hash", 1, 8)).alias("id"), F.col("path").alias("original_path"), "content_hash", F.lit("pending").alias("state"), now.alias("added_at"))
    return sources.unionByName(made, allowMissingColumns=True)


def discover(sources: DataFrame, files: DataFrame) -> DataFrame:
    """Files that no source has, by content or by path."""
    return files.join(sources.select("content_hash"), "content_hash", "left_anti").join(sources.select(F.col("original_path").alias("path")), "path", "left_anti")


def claim(sources: DataFrame, n: int, now: Column) -> DataFrame:
    """The ``n`` oldest pending sources become processing."""
    chosen = sources.where("state = 'pending'").orderBy("added_at", "id").limit(n).select("id", F.lit(True).alias("_take"))
    out = sources.join(F.broadcast(chosen), "id", "left")
    return out.withColumns({"state": F.when(F.col("_take"), F.lit("processing")).otherwise(F.col("state")), "last_processed_at": F.when(F.col("_take"), now).otherwise(F.col("last_processed_at"))}).drop("_take")


def finish(sources: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Apply ``results(id, page_refs, error)``: done, or error with one more retry."""
    r = results.select("id", F.col("page_refs").alias("_refs"), F.col("error").alias("_error"), F.lit(True).alias("_is"))
    bad = F.col("_error").isNotNull()
    out = sources.join(r, "id", "left")
    out = out.withColumns(
        {
            "state": F.when(F.col("_is") & bad, F.lit("error")).when(F.col("_is"), F.lit("done")).otherwise(F.col("state")),
            "error_message": F.when(F.col("_is"), F.col("_error")).otherwise(F.col("error_message")),
            "retry_count": F.col("retry_count") + F.when(F.col("_is") & bad, 1).otherwise(0),
            "page_refs": F.when(F.col("_is") & ~bad, F.col("_refs")).otherwise(F.col("page_refs")),
            "last_processed_at": F.when(F.col("_is"), now).otherwise(F.col("last_processed_at")),
        }
    )
    return out.select(*sources.columns)


def verify(sources: DataFrame, files: DataFrame) -> DataFrame:
    """Sources whose stored file has another hash now become stale; ``files(path, content_hash)``."""
    now = files.select(F.col("path").alias("stored_path"), F.col("content_hash").alias("_now"))
    drifted = F.col("_now").isNotNull() & (F.col("_now") != F.col("content_hash"))
    return sources.join(now, "stored_path", "left").withColumn("state", F.when(drifted, F.lit("stale")).otherwise(F.col("state"))).select(*sources.columns)


def reset_orphans(sources: DataFrame, now: Column, minutes: int = ORPHAN_MINUTES) -> DataFrame:
    """Processing sources without news for ``minutes`` are pending again."""
    lost = (F.col("state") == "processing") & (F.unix_timestamp(now) - F.unix_timestamp("last_processed_at") >= minutes * 60)
    return sources.withColumn("state", F.when(lost, F.lit("pending")).otherwise(F.col("state")))


def list_sources(sources: DataFrame, state: str | None = None) -> DataFrame:
    """Sources in a state; an unknown state filters nothing."""
    known = state in {"pending", "processing", "done", "error", "stale"}
    return (sources.where(F.col("state") == state) if known else sources).orderBy("id")


def source_status(sources: DataFrame) -> DataFrame:
    return sources.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


# ---- change sets -----------------------------------------------------------


def change_set(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """``(key, change)``: added, changed, removed or same, by content hash."""
    o, n = old.select(key, F.col("hash").alias("_old")), new.select(key, F.col("hash").alias("_new"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") == F.col("_new"), "same").otherwise("changed")
    return o.join(n, key, "full_outer").select(key, change.alias("change"))


def content_duplicates(docs: DataFrame, key: str = "doc_id", content: str = "text") -> DataFrame:
    """Content hashes that several rows share, with their number and least key."""
    return docs.select(F.sha2(content, 256).alias("hash"), key).groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_id")).where("n > 1")
