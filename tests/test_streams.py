import datetime
import json
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespark.operators import lexical, vector
from lorespark.streaming import feeds

BASE = datetime.datetime(2024, 1, 1)


def drop(inbox, name, *rows):
    inbox.mkdir(exist_ok=True)
    (inbox / name).write_text("\n".join(json.dumps({"path": p, "content": c, "change": k, "at": f"2024-01-01 00:00:{t:02d}"}) for p, c, k, t in rows))


def pages_of(spark, tmp_path, **more):
    return feeds.VersionedTable(spark, f"file://{tmp_path}/pages", "path string, content string", **more)


def rows_of(table):
    return sorted(map(tuple, table.read().collect()))


def test_runs_with_separate_checkpoints_lose_nothing(spark, tmp_path):
    table = pages_of(spark, tmp_path, buckets=4)
    for k, inbox in enumerate(("one", "two", "three")):
        drop(tmp_path / inbox, "1.json", (f"p{k}", str(k), "create", 1), ("shared", str(k), "modify", 2))
        feeds.page_feed(feeds.changes(spark, str(tmp_path / inbox)), table, f"file://{tmp_path}/cp{k}").awaitTermination()
    assert rows_of(table) == [("p0", "0"), ("p1", "1"), ("p2", "2"), ("shared", "2")]
    # no checkpoint named: a fresh one each time, and again nothing is lost
    drop(tmp_path / "four", "1.json", ("p3", "3", "create", 1))
    feeds.page_feed(feeds.changes(spark, str(tmp_path / "four")), table).awaitTermination()
    assert ("p3", "3") in rows_of(table) and table.version() == 3


def test_a_batch_that_runs_again_changes_nothing_and_only_its_buckets_are_written(spark, tmp_path):
    table = pages_of(spark, tmp_path, buckets=8)
    batch = lambda *rows: spark.createDataFrame([(p, c, k, BASE) for p, c, k in rows], feeds.CHANGE)
    assert table.apply(batch(*((f"p{i}", "1", "create") for i in range(40))), "a", 0)
    before = table._folders()
    assert table.apply(batch(("p1", "2", "modify"), ("p2", None, "remove")), "a", 1)
    assert not table.apply(batch(("p1", "9", "modify")), "a", 1) and not table.apply(batch(("p1", "9", "modify")), "a", 0)
    assert table.apply(batch(("p3", "3", "modify")), "b", 0)
    after = table._folders()
    changed = {b for b in before if before[b] != after.get(b)}
    assert 0 < len(changed) <= 3
    assert dict(rows_of(table)) == {f"p{i}": {1: "2", 3: "3"}.get(i, "1") for i in range(40) if i != 2}
    assert table.apply(batch(*((f"p{i}", None, "remove") for i in range(40))), "a", 2) and rows_of(table) == []


def test_pages_and_sources_are_routed(spark, tmp_path):
    table, refreshed, seen = pages_of(spark, tmp_path), [], []
    drop(tmp_path / "in", "1.json", ("wiki/a.md", "# A", "create", 1), ("src/x.rs", "fn x() {}", "create", 1), ("src/y.py", None, "remove", 2), ("notes.bin", "?", "create", 2))
    run = lambda: feeds.change_feed(feeds.changes(spark, str(tmp_path / "in")), table, lambda: refreshed.append(1), f"file://{tmp_path}/cp", lambda df: seen.append(df.count())).awaitTermination()
    run()
    assert rows_of(table) == [("wiki/a.md", "# A")] and refreshed == [1] and seen == [1]
    drop(tmp_path / "in", "2.json", ("wiki/b.md", "# B", "create", 3))
    run()
    assert refreshed == [1] and seen == [1, 2]
    drop(tmp_path / "in", "3.json", ("src/x.rs", "fn z() {}", "modify", 4))
    run()
    assert refreshed == [1, 1] and seen == [1, 2]


def test_a_full_audit_buffer_drops_and_counts(spark, tmp_path):
    inbox = tmp_path / "events"
    inbox.mkdir()
    write = lambda name, lo, hi: (inbox / name).write_text("\n".join(json.dumps({"at": f"2024-01-01 00:00:{i:02d}", "action": "help" if i % 5 == 4 else "search", "n": i}) for i in range(lo, hi)))
    run = lambda: feeds.bounded_audit(spark.readStream.schema("at timestamp, action string, n int").json(str(inbox)), capacity=10, drain=10).writeStream.format("json").option("path", f"{tmp_path}/log").option("checkpointLocation", f"file://{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    write("1.json", 0, 30)  # 24 that are logged, 10 places
    run()
    write("2.json", 30, 35)
    run()
    rows = [(json.loads(r["event"])["n"], r["dropped"]) for r in spark.read.json(f"{tmp_path}/log").collect()]
    kept = [i for i in range(30) if i % 5 != 4][:10]
    assert sorted(rows) == [(i, 14) for i in kept] + [(i, 14) for i in range(30, 34)]


def test_a_slow_drain_keeps_events_waiting():
    import pandas as pd

    class State:
        exists, hasTimedOut, get, timers = False, False, None, 0

        def update(self, v):
            self.get, self.exists = v, True

        def setTimeoutDuration(self, ms):
            self.timers += 1

    step, state = feeds.buffered(5, 2), State()
    batch = lambda lo, hi: iter([pd.DataFrame({"at": [BASE + datetime.timedelta(seconds=i) for i in range(lo, hi)], "event": [str(i) for i in range(lo, hi)]})])
    out = lambda frames: [(e, d) for f in frames for e, d in zip(f["event"], f["dropped"], strict=True)]
    assert out(step((0,), batch(0, 4), state)) == [("0", 0), ("1", 0)] and state.timers == 1
    assert out(step((0,), batch(4, 9), state)) == [("2", 2), ("3", 2)]
    state.hasTimedOut = True
    assert out(step((0,), iter([]), state)) == [("4", 2), ("5", 2)]
    assert out(step((0,), iter([]), state)) == [("6", 2)] and state.timers == 3


@pytest.mark.parametrize(("old", "model", "chunking", "want"), [
    ({}, "", "1", False), ({}, "m1", "1", True), ({"chunking_version": "1"}, "m1", "1", False), ({"model_modified_at": "m1"}, "m1", "2", False),
    ({"model_modified_at": "m1", "chunking_version": "1"}, "m2", "1", True), ({"model_modified_at": "m1", "chunking_version": "1"}, "", "1", False),
    ({"model_modified_at": "m1", "chunking_version": "1"}, "m1", "2", True), ({"model_modified_at": "m1", "chunking_version": "1"}, "m1", "1", False),
])
def test_what_makes_stored_vectors_void(old, model, chunking, want):
    assert vector.must_embed_anew(old, model, chunking) is want


def test_vectors_and_metadata_are_committed_together(spark, tmp_path):
    store = vector.VectorStore(spark, f"file://{tmp_path}/vectors")
    docs = lambda *rows: spark.createDataFrame(list(rows), "id string, text string")
    embed = lambda c: F.array(F.length(c).cast("double"), F.lit(1.0))
    done = lambda plan: {r["id"] for r in plan.where("embed").collect()}
    some = docs(("a", "one"), ("b", "three"), ("c", None))
    assert store.metadata() == {} and store.vectors().count() == 0
    assert done(store.refresh(some, lambda c: embed(F.coalesce(c, F.lit(""))), "m1", "1")) == {"a", "b", "c"}
    assert store.metadata() == {"model_modified_at": "m1", "chunking_version": "1"}
    assert done(store.refresh(docs(("a", "one"), ("b", "four!!"), ("d", "three")), embed, "m1", "1")) == {"b"}  # d has b's old vector
    assert {r["id"]: round(r["v"][0] / r["v"][1]) for r in store.vectors().collect()} == {"a": 3, "b": 6, "d": 5}
    assert done(store.refresh(docs(("a", "one"), ("d", "three")), embed, "m2", "1")) == {"a", "d"}
    assert done(store.refresh(docs(("a", "one"), ("d", "three")), embed, "m2", "2")) == {"a", "d"}
    assert done(store.refresh(docs(("a", "one")), embed, "m2", "2")) == set() and store.vectors().count() == 1


def test_nearest_vectors_with_ties_over_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(vector, "PIECE", 7)
    rng = np.random.default_rng(4)
    v = rng.integers(-2, 3, (120, 3)).astype(float)
    v[v.any(1) == 0] = 1
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)
    got = vector.top_k_cosine_many(df, df.where("vec_id < 20").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 5, block=8)
    found = {}
    for r in got.collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    for q in range(20):
        score = np.round(np.clip(v @ v[q], 0, 1), 12)
        want = sorted(range(120), key=lambda i: (-score[i], i))[:5]
        assert [found[q][i] for i in range(5)] == want
    few = vector.top_k_cosine_many(df.limit(3), df.limit(1).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 5)
    assert few.count() == 3


def test_terms_are_counted_inside_rows(spark):
    rows = [(1, ["b", "a", "b", "", "b"]), (2, []), (3, None), (4, ["x"])]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    got = {r["id"]: r["t"] for r in df.select("id", lexical.term_counts(F.coalesce("tokens", F.array().cast("array<string>"))).alias("t")).collect()}
    assert {i: {x["term"]: x["tf"] for x in t} for i, t in got.items()} == {i: dict(Counter(t or [])) for i, t in rows}
    fields = spark.createDataFrame([(1, "body", "alpha beta alpha", 1.0), (2, "body", None, 1.0), (3, "title", "beta", 4.0)], "doc_id long, field string, text string, weight double")
    plan = lexical._counted(fields, None)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
