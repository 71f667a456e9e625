import os

import pytest
from pyspark.sql import functions as F

from lorespark.operators import graph
from lorespark.sources import page_files, wiki


def written(folder):
    return {os.path.relpath(os.path.join(d, f), folder): open(os.path.join(d, f)).read() for d, _, names in os.walk(folder) for f in names if not f.endswith(".crc")}


def save(df, folder, mode="append", **options):
    page_files.register(df.sparkSession)
    df.write.format("page_files").options(**options).mode(mode).save(str(folder))


def test_files_come_back_as_they_were(spark, tmp_path):
    rows = [(f"d{i % 3}/p{i}.md", f"# Ünï {i}\n" * i) for i in range(40)] + [("none.md", None)]
    df = spark.createDataFrame(rows, "path string, content string").repartition(4)
    save(df, tmp_path / "out")
    assert written(tmp_path / "out") == {p: c or "" for p, c in rows}
    with pytest.raises(Exception, match="exists"):
        save(df.limit(1), tmp_path / "out")
    assert len(written(tmp_path / "out")) == 41
    save(df.where("path = 'none.md'"), tmp_path / "out", "overwrite")
    assert written(tmp_path / "out") == {"none.md": ""}
    save(df.limit(0), tmp_path / "empty")
    assert written(tmp_path / "empty") == {} and sorted(os.listdir(tmp_path)) == ["empty", "out"]


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    df = spark.createDataFrame([(f"p{i}.md" if i != 30 else "../escape.md", "x") for i in range(40)], "path string, content string").repartition(4)
    with pytest.raises(Exception, match="leaves its root"):
        save(df, tmp_path / "out")
    assert os.listdir(tmp_path) == []


def test_the_wiki_folder_is_refused(spark, tmp_path):
    df = spark.createDataFrame([("a.md", "x")], "path string, content string")
    for folder in ("wiki", "wiki/vault", "wiki/../wiki/x"):
        with pytest.raises(Exception, match="protected"):
            save(df, tmp_path / folder, protected=f"{tmp_path}/wiki/")
    save(df, tmp_path / "wiki-vault", protected=f"{tmp_path}/wiki")
    with pytest.raises(Exception, match="columns"):
        save(df.select("content"), tmp_path / "other")


def test_a_vault_has_a_line_a_link(spark, tmp_path):
    files = [("a.md", "---\ntitle: A\n---\nSee [[b]] and [[b]].\n"), ("b.md", "---\ntitle: B\n---\nText.\n")]
    pages = wiki.pages(spark.createDataFrame(files, "path string, content string"))
    edges = graph.build_edges(pages)
    page_files.write_vault(pages, edges, f"{tmp_path}/vault", f"{tmp_path}/wiki")
    got = written(tmp_path / "vault")
    assert set(got) == {"a.md", "b.md"} and got["b.md"].startswith("---\ntitle: B")
    lines = [x for x in got["a.md"].split("\n") if x.startswith("- [[")]
    assert len(lines) == len(set(lines)) == edges.where(F.col("src") == "wiki:a").select("dst", "edge_type", "provenance").distinct().count() >= 1
