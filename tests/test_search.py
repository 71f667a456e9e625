"""A small folder of pages from files to ranked results, and its incremental upkeep."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from lorespark.operators import history, lexical, rules, vector
from lorespark.plans.search import KnowledgeBase
from lorespark.streaming import feeds

PAGES = {
    "concepts/alpha.md": "---\ntitle: Alpha Engine\ntype: concept\nid: wiki:concepts:alpha\ntags: [storage]\nrelates_to:\n  - type: depends_on\n    target: wiki:concepts:beta\n---\nThe alpha engine reads pages.\n\n## Design\nIt uses graph_store for edges.\n",
    "concepts/beta.md": "---\ntitle: Beta Store\ntype: concept\nid: wiki:concepts:beta\nrelates_to:\n  - type: extends\n    target: wiki:concepts:gamma\n---\nBeta holds vectors and pages.\n",
    "concepts/gamma.md": "---\ntitle: Gamma\ntype: concept\nid: wiki:concepts:gamma\n---\nGamma has quasar-4242 inside.\n",
    "tasks/fix.md": "---\ntitle: Fix pages\ntype: task\nid: wiki:tasks:fix\nstatus: todo\nrelates_to:\n  - type: references\n    target: wiki:nowhere\n---\nPages pages pages.\n",
}


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pages")
    for name, content in PAGES.items():
        (folder / name).parent.mkdir(exist_ok=True)
        (folder / name).write_text(content)
    (folder / "log.md").write_text("generated")
    return KnowledgeBase.from_folder(spark, str(folder))


def test_pages_and_edges(base):
    assert sorted(r["id"] for r in base.pages.collect()) == ["wiki:concepts:alpha", "wiki:concepts:beta", "wiki:concepts:gamma", "wiki:tasks:fix"]
    assert sorted((r["src"], r["dst"], r["edge_type"]) for r in base.edges.collect()) == [("wiki:concepts:alpha", "wiki:concepts:beta", "depends_on"), ("wiki:concepts:beta", "wiki:concepts:gamma", "extends")]


def test_keyword_search_finds_compounds_and_titles(base):
    found = [r["id"] for r in base.search("quasar-4242").results.collect()]
    assert found[0].startswith("wiki:concepts:gamma")
    assert base.search("graph_store").results.first()["id"] == "wiki:concepts:alpha#design"
    assert base.search("zzz", "keyword").results.count() == 0 and base.search("", "keyword").results.count() == 0


def test_hybrid_without_an_embedder_degrades(base):
    r = base.search("pages", "hybrid")
    assert r.degraded and r.warning and r.results.count() >= 3
    with pytest.raises(ValueError, match="embedder"):
        base.search("pages", "semantic")


def test_operations_by_name(base):
    assert base.call("search.resolve", query="beta store").first()["id"] == "wiki:concepts:beta"
    assert {r["id"] for r in base.call("graph.affected", node="wiki:concepts:gamma").collect()} == {"wiki:concepts:beta", "wiki:concepts:alpha"}
    assert base.call("page.list", page_type="task").count() == 1
    packed = base.call("search.retrieve", query="alpha_engine").orderBy(F.desc("score")).collect()
    assert [r["id"] for r in packed] == ["wiki:concepts:alpha", "wiki:concepts:beta"] and "Title: Alpha Engine" in packed[0]["text"]
    with pytest.raises(KeyError):
        base.call("no.such")


def test_lint_and_validation(base):
    found = {(r["type"], r["id"]) for r in rules.lint(base.pages, base.edges).collect()}
    assert ("orphan", "wiki:tasks:fix") in found and ("missing_acs", "wiki:tasks:fix") in found and ("unresolved_target", "wiki:tasks:fix") in found
    assert ("orphan", "wiki:concepts:beta") not in found
    assert rules.verdict(rules.validate(base.pages, base.edges)).first()["status"] == "fail"


def test_deltas_give_the_rebuilt_index(spark):
    rows = [(i, "body", f"alpha w{i % 3} pages x{i}", 1.0) for i in range(12)]
    changed = [(3, "body", "wholly new words", 1.0), (20, "body", "alpha again", 1.0)]
    schema = "doc_id long, field string, text string, weight double"
    frame = lambda x: spark.createDataFrame(x, schema)
    got = lexical.merge_statistics(lexical.build_index(frame(rows)), frame([rows[3], rows[5]]), frame(changed))
    want = lexical.build_index(frame([r for r in rows if r[0] not in (3, 5)] + changed))
    for name in ("postings", "frequencies", "lengths", "total"):
        a, b = getattr(got, name), getattr(want, name)
        assert sorted(map(tuple, a.select(*b.columns).collect())) == sorted(map(tuple, b.collect())), name


def test_fusion_and_carried_vectors(spark):
    lex = spark.createDataFrame([("a", 0), ("b", 1)], "id string, rank int")
    sem = spark.createDataFrame([("b", 0), ("c", 1)], "id string, rank int")
    assert [(r["id"], round(r["score"], 6)) for r in vector.rrf(lex, sem).collect()] == [("b", round(1 / 61 + 1 / 60, 6)), ("a", round(1 / 60, 6)), ("c", round(1 / 61, 6))]
    new = spark.createDataFrame([("a", "h1"), ("b", "h9"), ("c", "h2")], "id string, hash string")
    old = spark.createDataFrame([("a", "h1", [1.0]), ("z", "h2", [2.0]), ("b", "h3", [3.0])], "id string, hash string, v array<double>")
    assert {r["id"]: (r["v"], r["embed"]) for r in vector.carry_forward(new, old).collect()} == {"a": ([1.0], False), "b": (None, True), "c": ([2.0], False)}


def test_change_sets_and_rollback(spark):
    a = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "id string, hash string")
    b = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "id string, hash string")
    assert {r["id"]: r["change"] for r in history.change_set(a, b).collect()} == {"a": "same", "b": "changed", "c": "removed", "d": "added"}
    v = spark.createDataFrame([("t", 1, [("x", None, "1")]), ("t", 2, [("x", "1", "2"), ("y", None, "5")]), ("t", 3, [("x", "2", "3")])], "entity_id string, version int, changes array<struct<field:string,old_value:string,new_value:string>>")
    assert {r["field"]: r["value"] for r in history.rollback(v, 1).collect()} == {"x": "1", "y": None}


def test_page_feed_keeps_the_table_in_step(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()

    def drop(name, *rows):
        (inbox / name).write_text("\n".join(json.dumps({"path": p, "content": c, "change": k, "at": t}) for p, c, k, t in rows))

    table = feeds.VersionedTable(spark, f"file://{tmp_path}/pages", "path string, content string")
    run = lambda: feeds.page_feed(feeds.changes(spark, str(inbox)), table, f"file://{tmp_path}/cp").awaitTermination()
    drop("1.json", ("a", "1", "create", "2024-01-01 00:00:00"), ("b", "1", "create", "2024-01-01 00:00:00"), ("a", "2", "modify", "2024-01-01 00:00:01"))
    run()
    assert sorted(map(tuple, table.read().collect())) == [("a", "2"), ("b", "1")]
    drop("2.json", ("b", None, "remove", "2024-01-02 00:00:00"), ("c", "1", "create", "2024-01-02 00:00:00"))
    run()
    run()
    assert sorted(map(tuple, table.read().collect())) == [("a", "2"), ("c", "1")]
    assert table.version() == 1


def test_bursts_of_changes(spark):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = spark.createDataFrame([("a", at(0)), ("a", at(0.3)), ("a", at(0.9)), ("b", at(0.1))], "path string, at timestamp")
    got = feeds.debounced_batch(rows, "path", "at", 0.5).groupBy("path").agg(F.sort_array(F.collect_list("changes")).alias("n")).collect()
    assert {r["path"]: list(r["n"]) for r in got} == {"a": [1, 2], "b": [1]}


def test_stems_are_counted_inside_rows_and_only_wanted_terms_kept(spark):
    from lorespark.operators import lexical

    fields = spark.createDataFrame([(1, "b", "Running runs run-time a", 1.0), (2, "b", None, 1.0), (3, "h", "runs", 4.0), (3, "b", "runs", 1.0)], "doc_id long, field string, text string, weight double")
    only = spark.createDataFrame([("run",)], "term string")
    index = lexical.build_index(fields, stems=True, only=only)
    assert sorted((r["doc_id"], r["field"], r["length"], r["term"], r["tf"]) for r in index.postings.collect()) == [(1, "b", 7, "run", 3), (3, "b", 2, "run", 1), (3, "h", 2, "run", 1)]
    assert [tuple(r) for r in index.frequencies.collect()] == [("run", 2)]
    assert index.total.first()["n"] == 3
