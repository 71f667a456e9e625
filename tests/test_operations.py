import pytest

from lorespark.plans.operations import Operations, Refused, json_rows, page_text, path_of
from lorespark.plans.search import KnowledgeBase
from lorespark.sources import wiki


@pytest.fixture
def base(spark):
    files = [
        ("concepts/a.md", "---\ntitle: Alpha\ntype: concept\n---\nAbout [[concepts/b]].\n"), ("concepts/b.md", "---\ntitle: Beta\ntype: concept\n---\nText.\n"),
        ("skills/s.md", "---\ntitle: Review\ntype: note\nskill: review\nevents: [task_done, commit]\n---\nLook at it.\n"), ("skills/t.md", "---\ntitle: Other\ntype: note\nskill: other\nevents: [commit]\n---\nX.\n"),
        ("templates/letter.md", "---\ntitle: Letter\ntype: note\n---\nDear {{ name }}, {{what}} {{ name }} {{rest}}.\n"),
    ]
    return KnowledgeBase.from_pages(wiki.pages(spark.createDataFrame(files, "path string, content string")))


def test_allowed_refused_and_failed_calls_are_logged(base, tmp_path):
    ops = Operations(base, permitted=lambda name: name != "page.delete", audit=f"file://{tmp_path}/audit")
    assert [r["id"] for r in ops.call("page.list", page_type="concept").collect()] == ["wiki:concepts:a", "wiki:concepts:b"]
    with pytest.raises(Refused):
        ops.call("page.delete", id="wiki:concepts:a")
    with pytest.raises(KeyError):
        ops.call("no.such")
    with pytest.raises(TypeError):
        ops.call("decision.get", name="x")
    with pytest.raises(LookupError):
        ops.call("decision.get", id="wiki:decisions:none")
    ops.register("help", "About", lambda: 1)
    assert ops.call("help") == 1
    log = [(r["operation"], r["action"], r["result"], r["error"] is None) for r in ops.log().orderBy("at").collect()]
    assert log == [("page.list", "list", "ok", True), ("page.delete", "delete", "refused", True), ("no.such", "such", "error", False), ("decision.get", "get", "error", False), ("decision.get", "get", "error", False)]
    assert base.pages.count() == ops.base.pages.count()
    assert "page.delete" not in {r["operation"] for r in ops.described().collect()}


def test_decisions_are_created_and_read(base):
    ops = Operations(base)
    made = ops.call("decision.create", id="wiki:decisions:store", title="Store: which?", context="Need a store", rationale="It's simple", options=["files", "a: b"], content="## More\nquasar words")
    assert tuple(made.first()) == ("wiki:decisions:store", "Store: which?", "draft")
    got = ops.call("decision.get", id="wiki:decisions:store").first()
    assert (got["context"], got["options"], got["rationale"], got["outcome"]) == ("Need a store", ["files", "a: b"], "It's simple", None) and "quasar" in got["content"]
    assert "wiki:decisions:store" in {r["id"].split("#")[0] for r in ops.call("search.query", query="quasar").collect()}
    with pytest.raises(ValueError, match="exists"):
        ops.call("decision.create", id="wiki:decisions:store", title="x", context="", rationale="")
    with pytest.raises(ValueError, match="not allowed"):
        ops.call("decision.create", id="wiki:decisions:other", title="x", context="", rationale="", status="done")
    with pytest.raises(LookupError):
        ops.call("decision.get", id="wiki:concepts:a")
    with pytest.raises(ValueError):
        ops.call("decision.create", id="wiki:..:x", title="x", context="", rationale="")


def test_tasks_are_created_changed_and_deleted(base):
    ops = Operations(base)
    ops.call("task.create", id="wiki:tasks:t1", title="Do it", priority="high", tags=["x"], acceptance_criteria=["one", "two"], estimate=3, content="Body.")
    ops.call("task.update", id="wiki:tasks:t1", fields={"status": "in-progress", "assignee": "me"}, notes="Started.", check=1)
    r = ops.base.pages.where("id = 'wiki:tasks:t1'").first()
    assert (r["title"], r["status"], r["priority"], r["assignee"], r["estimate"]) == ("Do it", "in-progress", "high", "me", 3)
    assert [(c["text"], c["checked"]) for c in r["acceptance_criteria"]] == [("one", False), ("two", True)] and r["body"].endswith("Started.")
    with pytest.raises(ValueError):
        ops.call("task.update", id="wiki:tasks:t1", fields={"status": "approved"})
    with pytest.raises(LookupError):
        ops.call("task.update", id="wiki:tasks:none", notes="x")
    ops.call("page.delete", id="wiki:tasks:t1")
    assert ops.base.pages.where("id = 'wiki:tasks:t1'").count() == 0


def test_skills_and_templates(base):
    ops = Operations(base)
    assert [r["id"] for r in ops.call("skill.fire", event="commit").collect()] == ["wiki:skills:s", "wiki:skills:t"]
    assert [r["instructions"].strip() for r in ops.call("skill.fire", event="task_done").collect()] == ["Look at it."]
    got = ops.call("template.render", id="wiki:templates:letter", values={"name": "A $1\\", "what": "hi"}).first()
    assert got["text"].strip() == "Dear A $1\\, hi A $1\\ {{rest}}." and got["missing"] == ["rest"]
    assert '"missing":["rest"]' in json_rows(ops.call("template.render", id="wiki:templates:letter", values={"name": "x", "what": "y"})).first()["value"]


def test_pages_from_fields():
    assert path_of("wiki:a:b") == "a/b.md"
    assert page_text({"title": "A: b", "tags": [], "x": None}, "t") == "---\ntitle: 'A: b'\n---\nt"
