"""Link resolution, deltas with stems, long chains, code extraction and index, paths, durations, page upkeep."""

import pytest
from pyspark.sql import functions as F

from lorespark.functions import text
from lorespark.operators import codeintel, graph, lexical, tracking, vector
from lorespark.plans.search import KnowledgeBase
from lorespark.sources import code, store, wiki

PAGES = "id string, title string, aliases array<string>, relates_to array<struct<type:string,target:string>>, refs array<string>"


def targets(spark, pages, wanted):
    src = [("wiki:z:src", "Xqj", [], [("references", t) for t in wanted], [])]
    found = graph.build_edges(spark.createDataFrame(pages + src, PAGES)).collect()
    return sorted((r["dst"], r["provenance"]) for r in found)


@pytest.mark.parametrize(
    ("target", "want"),
    [
        ("alph", []), ("the gamma page", [("wiki:c:zz", "explicit")]), ("be", [("wiki:c:alpha", "explicit")]), ("BETA", [("wiki:c:alpha", "explicit")]), ("zz", [("wiki:c:zz", "explicit")]),
        ("graph-store", [("wiki:c:gs", "explicit")]), ("graph store design", [("wiki:c:gs", "explicit")]), ("other-name", [("wiki:c:gs", "explicit")]), ("a", [("wiki:c:alpha", "ambiguous")]), ("wiki/c/zz", [("wiki:c:zz", "explicit")]),
    ],
)
def test_what_a_link_means(spark, target, want):
    pages = [("wiki:c:alpha", "Beta", [], [], []), ("wiki:c:zz", "Gamma", [], [], []), ("wiki:c:gs", "Graph Store", ["Other Name"], [], [])]
    assert targets(spark, pages, [target]) == want


def test_deltas_of_a_stemmed_index(spark):
    rows = [(i, "body", t, 1.0) for i, t in enumerate(["running patterns", "the pattern runs", "queries and query", "run"])]
    frame = lambda x: spark.createDataFrame(x, "doc_id long, field string, text string, weight double")
    got = lexical.merge_statistics(lexical.build_index(frame(rows), stems=True), frame(rows[:1]), frame([(9, "body", "designers run", 1.0)]))
    want = lexical.build_index(frame(rows[1:] + [(9, "body", "designers run", 1.0)]), stems=True)
    for name in ("postings", "frequencies", "lengths", "total"):
        a, b = getattr(got, name), getattr(want, name)
        assert sorted(map(tuple, a.select(*b.columns).collect())) == sorted(map(tuple, b.collect())), name


def test_a_part_of_the_index_scores_like_the_whole(spark):
    rows = spark.createDataFrame([(i, "body", f"alpha w{i % 3} pages x{i} pages", 1.0) for i in range(12)], "doc_id long, field string, text string, weight double")
    terms = lexical.query_terms(spark.createDataFrame([(1, "alpha pages"), (2, "w1 nothing")], "query_id long, text string"))
    view = lambda index: sorted(map(tuple, lexical.bm25(index, terms).collect()))
    assert view(lexical.build_index(rows, only=terms)) == view(lexical.build_index(rows)) != []


def test_long_chains_are_no_cycles(spark):
    chain = lambda n: spark.range(n).select(F.concat(F.lit("n"), "id").alias("src"), F.concat(F.lit("n"), (F.col("id") + 1).cast("string")).alias("dst"))
    assert not graph.has_cycle(chain(400))
    assert graph.has_cycle(chain(9).unionByName(spark.createDataFrame([("n9", "n0")], "src string, dst string")))
    assert graph.cyclic_core(chain(9)).count() == 0


def test_places_follow_the_order(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    assert sorted((r["seq"], r["k"]) for r in graph.with_seq(rows, "k").collect()) == [(i + 1, i) for i in range(1000)]
    assert graph.with_seq(rows.limit(0), "k").count() == 0


def test_nearest_of_many_against_a_plain_search(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    v = rng.normal(size=(200, 8))
    v /= np.linalg.norm(v, axis=1)[:, None]
    v[50] = v[7]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>").repartition(5)
    queries = df.where("vec_id % 20 = 0 or vec_id = 7").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    got = {}
    for r in vector.top_k_cosine_many(df, queries, 4, block=3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    for q, ids in got.items():
        score = np.round(np.clip(v @ v[q], 0, 1), 12)
        assert ids == sorted(range(200), key=lambda i: (-score[i], i))[:4]
    assert len(got) == 11 and got[7][:2] == [7, 50]
    assert vector.top_k_cosine_many(df, queries.limit(0), 4).count() == 0


def rows_of(content, language, what):
    return [r for r in code.extract(content, language) if r[0] == what]


def test_imports_over_several_lines():
    ts = 'import {\n  A,\n  B,\n} from "./x"; // why\nexport * from "./y"\nimport "./z"\nconst u = "http://a/b"; f(u)\n/* import "./no" */\n'
    assert [(r[7], r[3]) for r in rows_of(ts, "typescript", "import")] == [("./x", 1), ("./y", 5), ("./z", 6)]
    assert [(r[7], r[3]) for r in rows_of('import x from "https://a.b/c.js"\n', "typescript", "import")] == [("https://a.b/c.js", 1)]
    assert [r[7] for r in rows_of("use a::{\n    b,\n    c,\n};\npub use d::e;\nfn f() { g(); }\n", "rust", "import")] == ["a::{ b, c, }", "d::e"]
    assert [r[7] for r in rows_of('package p\nimport (\n  "fmt"\n  x "a/b"\n)\nimport "os"\nvar s = "no"\n', "go", "import")] == ["os", "fmt", "a/b"]
    broken = "import os\nfrom a.b import (\n  c,\n  d as e,\n)\ndef f(:\n    import json\nclass K:\n    def m(self): pass\n"
    assert [(r[7], r[8], r[9]) for r in rows_of(broken, "python", "import")] == [("os", None, False), ("a.b", "c", False), ("a.b", "d", False), ("json", None, True)]
    assert [(r[1], r[2]) for r in rows_of(broken, "python", "symbol")] == [("function", "f"), ("class", "K"), ("method", "m")]


def test_symbols_bases_and_references():
    rust = "pub struct Repo { db: Db }\nimpl Store for Repo {\n    fn get(&self, k: Key) -> Option<Row> { self.db.find(k) }\n}\n"
    assert ("struct", "Repo") in {(r[1], r[2]) for r in rows_of(rust, "rust", "symbol")}
    edges = {(r[1], r[6], r[7]) for r in rows_of(rust, "rust", "edge")}
    assert ("implements", "Repo", "Store") in edges and ("calls", "get", "find") in edges
    assert {t for k, _, t in edges if k == "references"} >= {"Db", "Key", "Row"}
    ts = "export class A extends B implements C {\n  run() {\n    return step(1)\n  }\n}\n"
    edges = {(r[1], r[7]) for r in rows_of(ts, "typescript", "edge")}
    assert {("inherits", "B"), ("implements", "C"), ("calls", "step")} <= edges


def test_a_code_index_is_refreshed(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "step.py").write_text("def step():\n    pass\n")
    (src / "run.py").write_text("from step import step\ndef run():\n    step()\n")
    (src / "main.py").write_text("from run import run\ndef main():\n    run()\n")
    at = f"file://{tmp_path}/index"
    assert code.index_tables(spark, at) is None and code.lag_seconds(code.scan(spark, str(src)), None) is None
    first = code.refresh(spark, str(src), at).first()
    assert (first["scanned"], first["changed"], first["symbols"]) == (3, 3, 3)
    edges = code.index_tables(spark, at)["edges"]
    reached = {(r["id"], r["depth"]) for r in codeintel.affected_code(edges, "step.py#step").collect()}
    assert reached == {("run.py#run", 1), ("main.py#main", 2)}
    assert {r["id"] for r in codeintel.affected_code(edges, "step").collect()} == {"run.py#run", "main.py#main"}
    assert {"run.py", "run.py#run", "main.py#main"} <= {r["id"] for r in codeintel.affected_code(edges, "step.py").collect()}
    assert codeintel.has_file(edges, "run.py") and codeintel.has_symbol(edges, "run.py", "run") and not codeintel.has_file(edges, "no.py")
    assert [r["source_symbol"] for r in codeintel.search_edges(edges, "calls", "main").collect()] == ["main"]
    assert code.refresh(spark, str(src), at).first()["changed"] == 0
    (src / "main.py").unlink()
    (src / "more.py").write_text("from step import step\ndef more():\n    step()\n")
    again = code.refresh(spark, str(src), at).first()
    assert (again["scanned"], again["changed"], again["symbols"]) == (3, 1, 3)
    tables = code.index_tables(spark, at)
    assert {r["id"] for r in codeintel.affected_code(tables["edges"], "step.py#step").collect()} == {"run.py#run", "more.py#more"}
    assert code.lag_seconds(code.scan(spark, str(src)), tables["manifest"]) == 0
    assert code.read_file(code.scan(spark, str(src)), "./x/../run.py").first()["content"].startswith("from step")


@pytest.mark.parametrize("path", ["../a", "a/../../b", "/etc/x", ".git/config", "a/.env"])
def test_paths_stay_inside(path):
    with pytest.raises(ValueError):
        store.confined(path)


def test_allowed_sources_and_lists(spark):
    files = spark.createDataFrame([("docs/a.md",), ("docs/b.exe",), ("x/c.md",)], "path string")
    assert [r["path"] for r in store.allowed_sources(files, ["md"], ["docs"]).collect()] == ["docs/a.md"]
    assert store.allowed_sources(files).count() == 3
    a, b = (spark.createDataFrame(x, "id string, score double") for x in ([("a", 1.0), ("b", 0.5)], [("b", 9.0), ("c", 0.1)]))
    assert sorted(map(tuple, vector.union_lists(a, b).collect())) == [("a", 1.0), ("b", 0.5), ("c", 0.1)]
    t = spark.createDataFrame([([[1.0, 0.0], [0.0, 3.0], [9.0, 9.0]], [1, 1, 0])], "t array<array<double>>, m array<int>")
    assert t.select(vector.mean_pooling("t", "m")).first()[0] == pytest.approx([1 / 10**0.5, 3 / 10**0.5])


def test_whole_minutes(spark):
    want = {"1h 30m": 90, "2h": 120, "45m": 45, "2": 0, "1.5h": 0, " 3H 5M ": 185, "soon": 0, "": 0, "10m 1h": 0, "1h30": 60}
    df = spark.createDataFrame([(k,) for k in want], "t string")
    assert {r["t"]: r["m"] for r in df.select("t", text.duration_whole_minutes("t").alias("m")).collect()} == want


def test_spellings(spark):
    rows = [("a.md", "---\ntitle: A\ntype: guide\nstatus: complete\npriority: critical\n---\nx"), ("b.md", "---\ntitle: B\ntype: notes\nstatus: accepted\n---\nx"), ("c.md", "---\ntitle: C\nstatus: wip\npriority: soon\n---\nx\n  ## Head #no\n#yes")]
    got = {r["id"]: r for r in wiki.pages(spark.createDataFrame(rows, "path string, content string")).collect()}
    assert [(got[k]["page_type"], got[k]["status"], got[k]["priority"]) for k in ("wiki:a", "wiki:b", "wiki:c")] == [("howto", "done", "urgent"), ("note", "approved", None), ("concept", "in-progress", None)]
    assert got["wiki:c"]["tags"] == ["yes"]


def test_pages_change_as_a_rebuild_would(spark):
    page = lambda t, kind, body, to="": f"---\ntitle: {t}\ntype: {kind}\nstatus: {'todo' if kind == 'task' else 'draft'}\n{to}---\n{body}\n"
    to = "relates_to:\n  - type: depends_on\n    target: wiki:b\n"
    files = {"a.md": page("Alpha", "concept", "alpha reads pages", to), "b.md": page("Beta", "concept", "beta holds pages"), "c.md": page("Gamma", "task", "gamma runs")}
    frame = lambda x: spark.createDataFrame(sorted(x.items()), "path string, content string")
    base = KnowledgeBase.from_pages(wiki.pages(frame(files)))
    news = {"b.md": page("Beta", "concept", "wholly new words"), "d.md": page("Delta", "memory", "delta pages noted")}
    got = base.changed(frame(news), ["wiki:c"])
    want = KnowledgeBase.from_pages(wiki.pages(frame({**{k: v for k, v in files.items() if k != "c.md"}, **news})))
    assert got.status() == want.status() and got.status()["graph_nodes"] == 3
    for name in ("postings", "frequencies", "lengths", "total"):
        a, b = getattr(got.index, name), getattr(want.index, name)
        assert sorted(map(repr, a.select(*b.columns).collect())) == sorted(map(repr, b.collect())), name
    assert sorted(map(repr, got.edges.collect())) == sorted(map(repr, want.edges.collect()))
    assert got.search("holds", "keyword").results.count() == 0 and got.search("wholly", "keyword").results.first()["id"].startswith("wiki:b")
    noted = got.call("search.context", query="pages").collect()
    assert {r["type"] for r in noted} == {"page", "memory"} and any("[memory:wiki:d] Delta" in r["text"] for r in noted)
    with pytest.raises(ValueError, match="not allowed"):
        base.changed(frame({"e.md": "---\ntitle: E\ntype: spec\nstatus: todo\n---\nx"}))


def test_tasks_and_memories(spark):
    tasks = spark.createDataFrame([("t1", "One", "todo", None)], "id string, title string, status string, parent string")
    two = tracking.subtask(tasks, "t1", "t2", "Two")
    assert sorted(map(repr, tracking.subtask(two, "t1", "t2", "Again").collect())) == sorted(map(repr, two.collect())) and two.where("parent = 't1'").count() == 1
    memories = spark.createDataFrame([(f"m{i}", float(i), "session") for i in range(5)], "id string, days double, layer string")
    kept = tracking.remember(memories, spark.createDataFrame([("new", 0.0, "session"), ("m1", 0.0, "session")], memories.schema), 4)
    assert {r["id"] for r in kept.collect()} == {"new", "m0", "m1", "m2"}
    assert {r["id"] for r in tracking.promote(kept, "m2").where("layer = 'project'").collect()} == {"m2"}
