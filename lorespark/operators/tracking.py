"""Work tracking: boards, task and memory lists, time reports, upserts of tasks and memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring, text

MEMORY_CAPACITY = 1000


def statuses(spark) -> DataFrame:
    return spark.createDataFrame(list(enumerate(scoring.STATUSES)), "ord int, status string")


def board(tasks: DataFrame, columns: list[str] | None = None, dimension: DataFrame | None = None) -> DataFrame:
    """A row for every status, counted even when empty, in board order; ``tasks(id, title, status, parent)``.

    A column's items are an array; use ``board_items`` for columns of any size.
    """
    dim = statuses(tasks.sparkSession) if dimension is None else dimension
    if columns is not None:
        dim = dim.where(F.col("status").isin(*columns))
    counts = tasks.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return dim.join(counts, "status", "left").select("ord", "status", F.coalesce("n", F.lit(0)).cast("long").alias("n")).orderBy("ord")


def board_items(tasks: DataFrame) -> DataFrame:
    """Tasks with the number of their subtasks."""
    children = tasks.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("subtasks"))
    return tasks.join(children, "id", "left").select("status", "id", "title", F.coalesce("subtasks", F.lit(0)).cast("long").alias("subtasks"))


def task_list(tasks: DataFrame, status: str | None = None, label: str | None = None, limit: int = 50) -> DataFrame:
    """Tasks by status and by any tag equal to the label without case, in id order."""
    out = tasks
    if status is not None:
        out = out.where(F.col("status") == status)
    if label is not None:
        out = out.where(F.exists("tags", lambda t: F.lower(t) == label.lower()))
    return out.orderBy("id").limit(limit)


def memory_list(memories: DataFrame, layer: str = "session", tag: str | None = None, status: str | None = None, limit: int = 50) -> DataFrame:
    """Memories of a layer by tag; the session layer filters by status, too."""
    out = memories.where(F.col("layer") == layer)
    if tag is not None:
        out = out.where(F.array_contains("tags", tag))
    if status is not None and layer == "session":
        out = out.where(F.col("status") == status)
    return out.orderBy("id").limit(limit)


def evict(memories: DataFrame, capacity: int = MEMORY_CAPACITY, group: str | None = None, stability: float = scoring.DEFAULT_STABILITY) -> DataFrame:
    """The ``capacity`` memories with the highest recency of ``days`` (a group); the lowest go, the largest id first among equals."""
    keys = [F.col(group)] if group else []
    w = Window.partitionBy(*keys).orderBy(F.desc(scoring.recency("days", "fsrs", stability)), "id")
    return memories.withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= capacity).drop("_at")


def time_report(tasks: DataFrame) -> DataFrame:
    """Totals over tasks with time spent, started or estimated; hours are the number before ``h``."""
    listed = (F.coalesce("time_spent", F.lit("")) != "") | (F.coalesce("time_started", F.lit("")) != "") | F.col("estimate").isNotNull()
    return tasks.agg(
        F.count_if(listed).alias("total_tasks"),
        F.coalesce(F.sum(text.duration_hours("time_spent")), F.lit(0.0)).alias("total_hours"),
        F.coalesce(F.sum(F.col("estimate").cast("double")), F.lit(0.0)).alias("total_estimated_hours"),
    )


def time_rows(tasks: DataFrame) -> DataFrame:
    listed = (F.coalesce("time_spent", F.lit("")) != "") | (F.coalesce("time_started", F.lit("")) != "") | F.col("estimate").isNotNull()
    return tasks.where(listed).select("id", "title", F.coalesce("time_spent", F.lit("")).alias("time_spent"), F.coalesce("time_started", F.lit("")).alias("time_started"), "estimate")


def add_time(tasks: DataFrame, entries: DataFrame) -> DataFrame:
    """``tasks`` with the minutes of ``entries(id, minutes)`` added to ``time_spent``."""
    more = entries.groupBy("id").agg(F.sum("minutes").alias("_more"))
    spent = text.duration_minutes("time_spent") + F.coalesce("_more", F.lit(0.0))
    out = tasks.join(more, "id", "left").withColumn("time_spent", F.when(F.col("_more").isNull(), F.col("time_spent")).otherwise(text.format_duration(spent)))
    return out.select(*tasks.columns)


def stop_timers(tasks: DataFrame, now: Column) -> DataFrame:
    """Running timers stopped at ``now``, their minutes added."""
    running = F.col("time_started").isNotNull()
    minutes = (F.unix_timestamp(now) - F.unix_timestamp(F.to_timestamp("time_started"))) / 60
    out = tasks.withColumn("time_spent", F.when(running, text.format_duration(text.duration_minutes("time_spent") + minutes)).otherwise(F.col("time_spent")))
    return out.withColumn("time_started", F.lit(None).cast("string"))


def recover_orphan_timers(tasks: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Tasks whose timer runs for ``hours`` or more become done."""
    old = (F.unix_timestamp(now) - F.unix_timestamp(F.to_timestamp("time_started"))) >= hours * 3600
    return tasks.withColumns({"status": F.when(old, F.lit("done")).otherwise(F.col("status")), "time_started": F.when(old, F.lit(None)).otherwise(F.col("time_started"))})


def merge(table: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Field-wise upsert: a null field of ``changes`` keeps the old value; new keys are added."""
    new = changes.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in changes.columns if c != key])
    joined = table.join(new, key, "full_outer")
    return joined.select(key, *[F.coalesce(f"_new_{c}", c).alias(c) if c in changes.columns else F.col(c) for c in table.columns if c != key])


def subtask(tasks: DataFrame, parent: str, task_id: str, title: str) -> DataFrame:
    """A new task below another, to do, unless its id is taken."""
    known = {"id": F.lit(task_id), "title": F.lit(title), "status": F.lit("todo"), "parent": F.lit(parent)}
    row = tasks.sparkSession.range(1).select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in tasks.schema])
    return tasks.unionByName(row.join(tasks.select("id"), "id", "left_anti").select(*tasks.columns))


def remember(memories: DataFrame, new: DataFrame, capacity: int = MEMORY_CAPACITY, stability: float = scoring.DEFAULT_STABILITY) -> DataFrame:
    """Session memories with ``new`` in place of equal ids; above the capacity the least recent of the old go."""
    room = capacity - new.select("id").distinct().count()
    old = evict(delete(memories, new), max(room, 0), stability=stability)
    return old.unionByName(new)


def promote(memories: DataFrame, memory: str, layer: str = "project") -> DataFrame:
    """Move one memory to another layer."""
    return memories.withColumn("layer", F.when(F.col("id") == memory, layer).otherwise(F.col("layer")))


def delete(table: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return table.join(gone.select(key), key, "left_anti")


def toggle_criterion(tasks: DataFrame, task: str, index: int, checked: bool) -> DataFrame:
    """Check or uncheck an acceptance criterion (from 0) of one task."""
    flipped = F.transform("acceptance_criteria", lambda a, i: F.when(i == index, a.withField("checked", F.lit(checked))).otherwise(a))
    return tasks.withColumn("acceptance_criteria", F.when(F.col("id") == task, flipped).otherwise(F.col("acceptance_criteria")))


def link(pages: DataFrame, page: str, edge_type: str, target: str) -> DataFrame:
    """Add a relation to one page unless it has it."""
    new = F.struct(F.lit(edge_type).alias("type"), F.lit(target).alias("target"))
    return pages.withColumn("relates_to", F.when((F.col("id") == page) & ~F.array_contains("relates_to", new), F.array_append("relates_to", new)).otherwise(F.col("relates_to")))


def unlink(pages: DataFrame, page: str, target: str, strict_compat: bool = False) -> DataFrame:
    """Remove a page's relations to ``target`` (with ``strict_compat``: to any target that contains it, Q19)."""
    stays = (lambda r: ~F.contains(r["target"], F.lit(target))) if strict_compat else (lambda r: r["target"] != target)
    return pages.withColumn("relates_to", F.when(F.col("id") == page, F.filter("relates_to", stays)).otherwise(F.col("relates_to")))


def skills_for(skills: DataFrame, event: str) -> DataFrame:
    """Skills triggered by an event, in id order; ``skills(id, events)``."""
    return skills.where(F.array_contains("events", event)).orderBy("id")
