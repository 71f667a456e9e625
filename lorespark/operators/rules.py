"""Lint and validation as unions of rule frames ``(type, severity, id, message)``.

``pages`` has ``id, title, path, page_type, status, relates_to, refs, tags,
aliases, acceptance_criteria, content``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph

TYPE_OF_DIR = ["core", "rule", "task", "spec", "pattern", "concept", "decision", "memory", "howto", "reference", "note"]


def issue(rows: DataFrame, kind: str, severity: str, message: Column | str, id_: Column | str = "id") -> DataFrame:
    text = F.lit(message) if isinstance(message, str) else message
    return rows.select(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), (F.col(id_) if isinstance(id_, str) else id_).alias("id"), text.alias("message"))


def frontmatter(content: Column | str) -> Column:
    """The block between the first ``---`` and the next line that begins with it."""
    return F.regexp_extract(F.trim(content if isinstance(content, Column) else F.col(content)), r"(?s)^---(.*?)\n---", 1)


def frontmatter_health(pages: DataFrame) -> DataFrame:
    """``id, stem, has_id, raw_id, scientific, blocks``."""
    block = frontmatter("content")
    raw = F.regexp_replace(F.trim(F.regexp_extract(block, r"(?m)^id\s*:[ \t]*(.*)$", 1)), "^[\"']|[\"']$", "")
    quoted = F.rlike(block, F.lit(r"(?m)^id\s*:[ \t]*[\"']"))
    stem = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    return pages.select("id", "title", "path", "page_type", stem.alias("stem"), (raw != "").alias("has_id"), raw.alias("raw_id"), (F.rlike(raw, F.lit("^[0-9]+[eE][0-9]+$")) & ~quoted).alias("scientific"), F.rlike(F.trim("content"), F.lit(r"(?s)^---.*?\n---[ \t]*\n\s*---[ \t]*\n")).alias("duplicate"), (block != "").alias("has_block"))


def lint(pages: DataFrame, edges: DataFrame, sources: DataFrame | None = None, files: DataFrame | None = None, paths: DataFrame | None = None) -> DataFrame:
    """All lint rules; ``sources`` with ``files(path, content_hash)`` checks hashes, ``paths(path)`` looks for stray folders."""
    health = frontmatter_health(pages)
    found = [
        issue(graph.orphans(pages, edges), "orphan", "warning", "No inbound edges: consider adding relationships"),
        issue(graph.unresolved(pages).where("ord < 1000000"), "unresolved_target", "warning", F.concat(F.lit("Unresolved relates_to target '"), "target", F.lit("'")), "src"),
        issue(pages.where("page_type = 'task' and coalesce(size(acceptance_criteria), 0) <= 0"), "missing_acs", "warning", "Task has no acceptance criteria"),
        issue(pages.where("page_type = 'spec' and status = 'draft'"), "spec_status", "info", "Spec status is draft"),
        issue(health.where("has_block and not has_id"), "missing_id", "warning", F.concat(F.lit("Page '"), "title", F.lit("' has no id in its frontmatter"))),
        issue(health.where("scientific"), "scientific_notation_id", "error", F.concat(F.lit("Frontmatter id '"), "raw_id", F.lit("' reads as a number: quote it"))),
        issue(health.where("duplicate"), "duplicate_frontmatter", "error", "File has more than one frontmatter block"),
        issue(health.where("page_type = 'task' and has_id and raw_id <> stem and raw_id <> id"), "frontmatter_id_mismatch", "warning", F.concat(F.lit("Frontmatter id '"), "raw_id", F.lit("' differs from the file's name"))),
    ]
    if sources is not None:
        stale = sources.where("state = 'stale'")
        if files is not None:
            drift = sources.where("state <> 'stale'").join(files.select(F.col("path").alias("stored_path"), F.col("content_hash").alias("_now")), "stored_path").where("_now <> content_hash")
            stale = stale.select("id").unionByName(drift.select("id"))
        found.append(issue(stale, "stale_source", "warning", F.concat(F.lit("Source '"), "id", F.lit("' changed and needs reprocessing"))))
        found.append(issue(stale.agg(F.count(F.lit(1)).alias("n")).where("n > 0"), "stale_sources_summary", "info", F.concat(F.col("n").cast("string"), F.lit(" stale source(s)")), F.lit("registry")))
    if paths is not None:
        stray = paths.select(F.regexp_extract("path", r"^(.+/\.wm)/", 1).alias("id")).where("id <> ''").distinct()
        # fixed values: the names of these two issues
        found.append(issue(stray, "rogue_wm_dir", "error", "A second data folder below the project root"))
        found.append(issue(stray.agg(F.count(F.lit(1)).alias("n")).where("n > 0"), "rogue_wm_summary", "info", F.concat(F.col("n").cast("string"), F.lit(" stray folder(s)")), F.lit("filesystem")))
    out = reduce(DataFrame.unionByName, found)
    if graph.has_cycle(edges):
        one = pages.sparkSession.createDataFrame([("graph",)], "id string")
        out = out.unionByName(issue(one, "cycle", "info", "The page graph has a cycle"))
    return out


def fix_types(pages: DataFrame) -> DataFrame:
    """Infer a missing page type from the folder."""
    folder = F.regexp_replace(F.regexp_extract("path", r"(?:^|/)([^/]+)/[^/]*$", 1), "s$", "")
    return pages.withColumn("page_type", F.when(F.coalesce("page_type", F.lit("")) != "", F.col("page_type")).otherwise(F.when(folder.isin(*TYPE_OF_DIR), folder).otherwise("concept")))


def spec_coverage(pages: DataFrame) -> DataFrame:
    """Specs to which no task relates."""
    to = pages.where("page_type = 'task'").select(F.explode("relates_to").alias("r")).select(F.explode(F.array("r.target", F.concat(F.lit("wiki:"), F.replace(F.regexp_replace("r.target", "^wiki:", ""), F.lit("/"), F.lit(":"))))).alias("id")).distinct()
    return pages.where("page_type = 'spec'").join(to, "id", "left_anti")


def validate(pages: DataFrame, edges: DataFrame, scope: str = "all", strict_compat: bool = False) -> DataFrame:
    """Errors and warnings of a scope: ``all``, ``sdd``, or a page id.

    References count as resolved by the intended normalisation; with
    ``strict_compat`` only exact targets do (Q15).
    """
    at = pages if scope in ("all", "sdd") else pages.where(F.col("id") == scope)
    coverage = issue(spec_coverage(at), "sdd_coverage", "warning", F.concat(F.lit("Spec '"), "title", F.lit("' has no linked tasks")))
    if scope == "sdd":
        return coverage
    said = graph.mentions(at)
    target = F.col("target") if strict_compat else F.replace("target", F.lit("/"), F.lit(":"))
    broken = said.withColumn("_t", target).join(pages.select(F.col("id").alias("_t")), "_t", "left_anti")
    return reduce(
        DataFrame.unionByName,
        [
            issue(broken, "broken_reference", "error", F.concat(F.lit("Unknown target '"), "target", F.lit("'")), "src"),
            issue(at.where("coalesce(title, '') = ''"), "missing_title", "error", "Page has no title"),
            issue(graph.orphans(at, edges), "orphan", "warning", "Nothing links here"),
            issue(at.where("page_type = 'task' and coalesce(size(acceptance_criteria), 0) <= 0"), "missing_acs", "warning", "Task has no acceptance criteria"),
            coverage,
        ],
    )


def verdict(issues: DataFrame) -> DataFrame:
    """One row: pass or fail, with counts."""
    errors = F.count_if(F.col("severity") == "error")
    return issues.agg(F.when(errors == 0, "pass").otherwise("fail").alias("status"), errors.alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.count(F.lit(1)).alias("total"))


def health(pages: DataFrame, sections: DataFrame, edges: DataFrame) -> DataFrame:
    """Pages without sections, with the number of edges that lead there."""
    empty = pages.join(sections.select(F.col("page_id").alias("id")), "id", "left_anti")
    inbound = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("inbound"))
    return empty.join(inbound, "id", "left").select("id", "title", F.coalesce("inbound", F.lit(0)).alias("inbound"))


def recall_metrics(results: DataFrame, golden: DataFrame, k: int = 5) -> DataFrame:
    """Macro recall@k, recall@1 and mean reciprocal rank; ``results(query, id, rank)`` from 0, ``golden(query, expected)``."""
    want = golden.select("query", F.explode(F.array_distinct("expected")).alias("id"))
    hits = want.join(results, ["query", "id"]).groupBy("query").agg(F.count_if(F.col("rank") < k).alias("at_k"), F.count_if(F.col("rank") < 1).alias("at_1"), F.min("rank").alias("first"))
    per = golden.select("query", F.size(F.array_distinct("expected")).alias("n")).join(hits, "query", "left")
    share = lambda c: F.coalesce(F.col(c), F.lit(0)) / F.col("n")
    return per.agg(F.avg(share("at_k")).alias("recall_at_k"), F.avg(share("at_1")).alias("recall_at_1"), F.avg(F.coalesce(1.0 / (F.col("first") + 1), F.lit(0.0))).alias("mrr"))
