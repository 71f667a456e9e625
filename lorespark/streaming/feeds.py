"""Incremental maintenance as Structured Streaming jobs.

``change_feed`` turns files that appear into batches of the latest version of
each page, upserts them and tells the code index once a batch; ``debounced`` closes a key's burst of changes with
a session window; ``audit`` appends events, ``bounded_audit`` through buffers
of a fixed size; ``lifecycle`` keeps each source's
state with a timer for processing that went silent.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.code import language_of
from ..sources.store import scratch, stored

DEBOUNCE = "500 milliseconds"
CHANGE = "path string, content string, change string, at timestamp"
STATE = T.StructType([T.StructField("state", T.StringType()), T.StructField("retries", T.IntegerType())])
LIFECYCLE = T.StructType([T.StructField("id", T.StringType()), T.StructField("state", T.StringType()), T.StructField("retries", T.IntegerType()), T.StructField("reason", T.StringType())])


def changes(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of change records ``(path, content, change, at)`` from JSON files; ``change`` is create, modify or remove."""
    return spark.readStream.schema(CHANGE).json(folder)


def latest(batch: DataFrame, key: str = "path", at: str = "at") -> DataFrame:
    """The last change of each key in a batch."""
    return batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), F.struct(at, F.xxhash64(*batch.columns))).alias("r")).select("r.*")


class VersionedTable:
    """A table of immutable versions in a folder, dealt into buckets by a hash of its key.

    A batch writes the buckets that it touches anew and a list of all buckets'
    folders; readers take the newest complete list.  A version is named by its
    number, by whoever sent the batch and by that sender's epoch, so a batch that
    runs again changes nothing, and a new sender begins anew.  One job at a time
    may write.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "path", buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets
        jvm = spark.sparkContext._jvm
        self._at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[tuple[int, str, int]]:
        """Complete versions ``(number, sender, epoch)``, ascending."""
        at = self._at(f"{self.path}/versions")
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        parts = [n.split("-") for n in names if self._fs.exists(self._at(f"{self.path}/versions/{n}/_SUCCESS"))]
        return sorted((int(v), sender, int(epoch)) for v, sender, epoch in parts)

    def version(self) -> int:
        return max((v for v, _, _ in self._versions()), default=-1)

    def _folders(self) -> dict[int, str]:
        """The folder of each bucket that has rows."""
        last = max(self._versions(), default=None)
        if last is None:
            return {}
        rows = self.spark.read.schema("bucket int, folder string").parquet(f"{self.path}/versions/{last[0]:012d}-{last[1]}-{last[2]}").collect()  # at most ``buckets``
        return {r["bucket"]: r["folder"] for r in rows}

    def _rows(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._rows(sorted(self._folders().values()))

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def apply(self, batch: DataFrame, sender: str = "", epoch: int | None = None) -> bool:
        """Write the version after a batch of changes; False where the sender's epoch is in the table already."""
        done, name = self._versions(), hashlib.sha256(sender.encode()).hexdigest()[:16]
        last = max((e for _, s, e in done if s == name), default=-1)
        epoch = last + 1 if epoch is None else epoch
        if epoch <= last:
            return False
        now = max((v for v, _, _ in done), default=-1) + 1
        changed = stored(latest(batch, self.key).withColumn("_bucket", self.bucket()), "changes")
        touched = {r[0] for r in changed.select("_bucket").distinct().collect()}  # at most ``buckets``
        folders = self._folders()
        old = self._rows([f for b, f in folders.items() if b in touched])
        rows = old.join(changed.select(self.key), self.key, "left_anti").unionByName(changed.where("change <> 'remove'").select(*old.columns))
        at = f"{self.path}/data/{now:012d}-{uuid.uuid4().hex}"
        rows.withColumn("bucket", self.bucket()).repartition("bucket").write.partitionBy("bucket").parquet(at)
        for b in touched:
            folders.pop(b, None)
            if self._fs.exists(self._at(f"{at}/bucket={b}")):
                folders[b] = f"{at}/bucket={b}"
        listed = self.spark.createDataFrame(sorted(folders.items()), "bucket int, folder string")
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/versions/{now:012d}-{name}-{epoch}")
        return True


def page_feed(stream: DataFrame, table: VersionedTable, checkpoint: str | None = None, refresh: Callable[[DataFrame], None] | None = None):
    """Start the job that keeps ``table`` in step with a change stream; ``refresh`` sees the new table after each batch."""
    return change_feed(stream, table, checkpoint=checkpoint, refresh=refresh, is_page=None)


def change_feed(stream: DataFrame, pages: VersionedTable, code_changed: Callable[[], None] | None = None, checkpoint: str | None = None, refresh: Callable[[DataFrame], None] | None = None, is_page: Callable[[Column], Column] | None = lambda path: F.endswith(path, F.lit(".md"))):
    """Start the job that routes a change stream: pages into their table, sources to one ``code_changed`` a batch.

    A path that is neither is passed over; with ``is_page`` None all are pages.
    Versions of the table carry the checkpoint and epoch, so a batch that is run
    again after a failure changes nothing, and a run with another checkpoint goes on.
    """
    at = checkpoint or scratch(stream.sparkSession, "feed")

    def step(batch: DataFrame, epoch: int) -> None:
        seen = batch if is_page is None else stored(batch, "batch")
        wiki = seen if is_page is None else seen.where(is_page(F.col("path")))
        if (is_page is None or not wiki.isEmpty()) and pages.apply(wiki, at, epoch) and refresh is not None:
            refresh(pages.read())
        if is_page is not None and code_changed is not None and not seen.where(~is_page(F.col("path")) & language_of("path").isNotNull()).isEmpty():
            code_changed()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", at).trigger(availableNow=True).start()


def debounced(stream: DataFrame, key: str, at: str = "at", gap: str = DEBOUNCE, late: str = "10 seconds") -> DataFrame:
    """One row a burst: changes of a key with less than ``gap`` between them, and the last of them."""
    marked = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    burst = marked.groupBy(F.session_window(at, gap).alias("w"), key)
    return burst.agg(F.count(F.lit(1)).alias("changes"), F.max(at).alias("last")).select(key, F.col("w.start").alias("first"), "last", "changes")


def debounced_batch(rows: DataFrame, key: str, at: str, seconds: float) -> DataFrame:
    """The same bursts of a bounded table, by gaps between neighbours."""
    w = Window.partitionBy(key).orderBy(at)
    t = F.unix_micros(F.col(at).cast("timestamp"))
    new = F.coalesce((t - F.lag(t).over(w) >= int(seconds * 1e6)).cast("int"), F.lit(1))
    burst = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_new", new).withColumn("_burst", burst).groupBy(key, "_burst").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("changes")).drop("_burst")


def windowed_counts(stream: DataFrame, at: str = "ts", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events and values by tumbling window and type, with a watermark."""
    marked = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return marked.groupBy(F.window(at, width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def audit(stream: DataFrame, folder: str, checkpoint: str, quiet: tuple[str, ...] = ("help", "initial")):
    """Append audit events as JSON lines, without the quiet actions."""
    kept = stream.where(~F.col("action").isin(*quiet))
    return kept.writeStream.format("json").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


AUDITED = "shard int, event string, dropped long"


def buffered(capacity: int, drain: int):
    """A shard's waiting audit events, oldest first, at most ``capacity``; what comes while it is full is dropped and counted."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, dropped = ([*state.get[0]], state.get[1]) if state.exists else ([], 0)
        if not state.hasTimedOut:
            for batch in batches:
                rows = batch.sort_values(["at", "event"])["event"].tolist()
                room = max(capacity - len(waiting), 0)
                waiting += rows[:room]
                dropped += len(rows[room:])
        out, waiting = waiting[:drain], waiting[drain:]
        state.update((waiting, dropped))
        if waiting:
            state.setTimeoutDuration(1)
        yield pd.DataFrame({"shard": [key[0]] * len(out), "event": out, "dropped": [dropped] * len(out)})

    return step


def bounded_audit(events: DataFrame, capacity: int = 1024, drain: int = 1024, shards: int = 1, quiet: tuple[str, ...] = ("help", "initial")) -> DataFrame:
    """Audit events ``(at, action, ...)`` as JSON through buffers of ``capacity``: ``(shard, event, dropped)``.

    Each trigger takes what a shard's buffer has room for and puts out ``drain``
    events, oldest first; ``dropped`` counts those that found it full so far.
    What waits goes out with the next trigger, whether or not events come.
    """
    kept = events.where(~F.col("action").isin(*quiet))
    rows = kept.select(F.pmod(F.xxhash64(*kept.columns), F.lit(shards)).cast("int").alias("shard"), F.col("at").cast("timestamp").alias("at"), F.to_json(F.struct(*kept.columns)).alias("event"))
    # without anything that waits no timer is set, so a job over what is available ends
    timeout = GroupStateTimeout.NoTimeout if drain >= capacity else GroupStateTimeout.ProcessingTimeTimeout
    return rows.groupBy("shard").applyInPandasWithState(buffered(capacity, drain), AUDITED, "waiting array<string>, dropped long", "append", timeout)


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now, retries = state.get if state.exists else ("pending", 0)
    if state.hasTimedOut:
        state.update(("pending", retries))  # retries outlive the timeout
        yield pd.DataFrame([(key[0], "pending", retries, "timeout")], columns=LIFECYCLE.names)
        return
    events = pd.concat(list(batches)).sort_values("at")
    for e in events["event"]:
        if e == "claim" and now in ("pending", "stale", "error"):
            now = "processing"
        elif e == "complete" and now == "processing":
            now = "done"
        elif e == "fail" and now == "processing":
            now, retries = "error", retries + 1
        elif e == "drift" and now == "done":
            now = "stale"
    state.update((now, retries))
    if now == "processing":
        state.setTimeoutDuration(30 * 60 * 1000)
    yield pd.DataFrame([(key[0], now, int(retries), "event")], columns=LIFECYCLE.names)


def lifecycle(events: DataFrame) -> DataFrame:
    """Source states from a stream ``(id, event, at)``; processing without news for 30 minutes is pending again."""
    return events.groupBy("id").applyInPandasWithState(_advance, LIFECYCLE, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)
