"""Markdown pages as typed tables: scan, frontmatter, sections, references.

A page is one row; its frontmatter is a fixed struct with a map for keys it
doesn't know.  YAML and section splitting are small per-row helpers inside
Arrow batches; ids, links, tags and references are column expressions.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text

S = T.StringType()
RELATION = T.StructType([T.StructField("type", S), T.StructField("target", S)])
CRITERION = T.StructType([T.StructField("text", S), T.StructField("checked", T.BooleanType())])
FRONTMATTER = T.StructType(
    [
        T.StructField("title", S), T.StructField("id", S), T.StructField("type", S), T.StructField("status", S), T.StructField("priority", S),
        T.StructField("assignee", S), T.StructField("parent", S), T.StructField("time_started", S), T.StructField("time_spent", S), T.StructField("updated_at", S),
        T.StructField("estimate", T.IntegerType()), T.StructField("tags", T.ArrayType(S)), T.StructField("aliases", T.ArrayType(S)), T.StructField("sources", T.ArrayType(S)),
        T.StructField("relates_to", T.ArrayType(RELATION)), T.StructField("acceptance_criteria", T.ArrayType(CRITERION)), T.StructField("unknown", T.MapType(S, S)),
    ]
)
SECTION = T.ArrayType(T.StructType([T.StructField("ordinal", T.IntegerType()), T.StructField("header", S), T.StructField("body", S)]))
GENERATED = ("index.md", "log.md")

# fixed values: spellings that mean a page type, a status or a priority
TYPE_ALIASES = {
    "task": "task", "spec": "spec", "concept": "concept", "pattern": "pattern", "decision": "decision", "howto": "howto", "guide": "howto", "reference": "reference",
    "memory": "memory", "note": "note", "notes": "note", "rule": "rule", "core": "core",
}
STATUS_ALIASES = {
    "todo": "todo", "in-progress": "in-progress", "wip": "in-progress", "in-review": "in-review", "reviewing": "in-review", "in_review": "in-review", "done": "done", "complete": "done",
    "blocked": "blocked", "cancelled": "cancelled", "canceled": "cancelled", "draft": "draft", "reviewed": "reviewed", "review": "reviewed", "superseded": "superseded",
    "approved": "approved", "accepted": "approved", "active": "active", "stale": "stale", "rejected": "rejected", "archived": "archived",
}
PRIORITY_ALIASES = {"low": "low", "medium": "medium", "med": "medium", "high": "high", "urgent": "urgent", "critical": "urgent"}


def _alias(c: Column, table: dict[str, str], default: str | None) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.lower(c)), F.lit(default))


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, content)`` of all pages below ``folder``; generated and blank files are left out."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    base = folder.rstrip("/").removeprefix("file://").removeprefix("file:")
    path = F.regexp_replace(F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/"), f"^{base}/", "")
    named = raw.select(F.url_decode(path).alias("path"), F.col("value").alias("content"))
    return named.where(~F.element_at(F.split("path", "/"), -1).isin(*GENERATED) & (F.trim("content") != ""))


def split_frontmatter(content: Column | str) -> tuple[Column, Column]:
    """The frontmatter block (null without one) and the body."""
    c = F.trim(F.col(content) if isinstance(content, str) else content)
    has = F.rlike(c, F.lit(r"(?s)^---.*?\n---"))
    block = F.when(has, F.regexp_extract(c, r"(?s)^---(.*?)\n---", 1))
    return block, F.when(has, F.trim(F.regexp_replace(c, r"(?s)^---.*?\n---", ""))).otherwise(c)


def _texts(x) -> list[str]:
    if x is None:
        return []
    return [str(v) for v in x] if isinstance(x, list) else [str(x)]


def _relation(x) -> tuple[str, str] | None:
    if isinstance(x, dict) and "target" in x:
        return str(x.get("type", "relates_to")), str(x["target"])
    if isinstance(x, dict) and len(x) == 1:
        (k, v), = x.items()
        return str(k), str(v)
    return ("relates_to", x) if isinstance(x, str) else None


def _criterion(x) -> tuple[str, bool]:
    if isinstance(x, dict):
        return str(x.get("text", "")), str(x.get("checked", "")).lower() in ("true", "yes", "on")
    return str(x), False


def frontmatter_fields(block: str | None) -> tuple | None:
    """A block in the order of ``FRONTMATTER``; null if it is no YAML mapping."""
    import yaml

    if block is None:
        return None
    try:
        found = yaml.load(block, Loader=yaml.BaseLoader) or {}
    except yaml.YAMLError:
        return None
    if not isinstance(found, dict):
        return None
    plain = [None if found.get(k) is None or isinstance(found.get(k), (list, dict)) else str(found[k]) for k in FRONTMATTER.names[:10]]
    estimate = str(found.get("estimate", ""))
    known = {*FRONTMATTER.names}
    relations = [r for r in map(_relation, found.get("relates_to") or []) if r] if isinstance(found.get("relates_to"), list) else []
    criteria = [_criterion(x) for x in found.get("acceptance_criteria") or []] if isinstance(found.get("acceptance_criteria"), list) else []
    other = {str(k): v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in found.items() if k not in known}
    return (*plain, int(estimate) if estimate.isdigit() else None, _texts(found.get("tags")), _texts(found.get("aliases")), _texts(found.get("sources")), relations, criteria, other)


@F.pandas_udf(FRONTMATTER)
def parse_frontmatter(blocks: pd.Series) -> pd.DataFrame:
    rows = [frontmatter_fields(b) or (None,) * len(FRONTMATTER) for b in blocks]
    return pd.DataFrame(rows, columns=FRONTMATTER.names, dtype=object)


def sections_of(body: str | None) -> list[tuple[int, str, str]]:
    """Second-level sections ``(ordinal, header, body)``; what stands first is "Overview", empty bodies go."""
    out, header, held, fenced = [], "Overview", [], False
    for line in (body or "").split("\n"):
        if line.lstrip().startswith("```"):
            fenced = not fenced
        if line.startswith("## ") and not fenced:
            out.append((header, "\n".join(held).strip()))
            header, held = line[3:].strip(), []
        else:
            held.append(line)
    out.append((header, "\n".join(held).strip()))
    return [(i, h, b) for i, (h, b) in enumerate(x for x in out if x[1])]


@F.pandas_udf(SECTION)
def split_sections(bodies: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in bodies:
        yield s.map(sections_of)


def pages(files: DataFrame) -> DataFrame:
    """Typed pages of ``(path, content)``."""
    block, body = split_frontmatter("content")
    split = files.select("path", "content", block.alias("_block"), body.alias("_body"))
    read = split.withColumn("fm", parse_frontmatter("_block"))
    fm = F.col("fm")
    broken = F.col("_block").isNotNull() & fm["unknown"].isNull()
    body = F.when(broken, F.trim("content")).otherwise(F.col("_body"))
    stem = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    none = F.array().cast("array<string>")
    links = text.wikilinks(body)
    own = F.coalesce(fm["relates_to"], F.array().cast(T.ArrayType(RELATION)))
    said = F.transform(own, lambda r: r["target"])
    linked = F.transform(F.array_except(links, said), lambda t: F.struct(F.lit("relates_to").alias("type"), t.alias("target")))
    return read.select(
        text.path_to_id("path").alias("id"), F.coalesce(F.nullif(fm["title"], F.lit("")), F.replace(stem, F.lit("-"), F.lit(" "))).alias("title"), "path",
        _alias(fm["type"], TYPE_ALIASES, "concept").alias("page_type"), _alias(fm["status"], STATUS_ALIASES, "draft").alias("status"),
        F.array_union(F.coalesce(fm["tags"], none), text.inline_tags(body)).alias("tags"), F.coalesce(fm["aliases"], none).alias("aliases"), F.coalesce(fm["sources"], none).alias("sources"),
        F.concat(own, linked).alias("relates_to"), text.references(body).alias("refs"), F.coalesce(fm["acceptance_criteria"], F.array().cast(T.ArrayType(CRITERION))).alias("acceptance_criteria"),
        _alias(fm["priority"], PRIORITY_ALIASES, None).alias("priority"), fm["assignee"].alias("assignee"), fm["parent"].alias("parent"), fm["estimate"].alias("estimate"),
        fm["time_started"].alias("time_started"), fm["time_spent"].alias("time_spent"), fm["updated_at"].alias("updated_at"), fm["unknown"].alias("unknown"),
        body.alias("body"), "content", F.sha2("content", 256).alias("hash"),
    )


def sections(pages: DataFrame) -> DataFrame:
    """Sections of pages; ``section_id`` repeats where headers do, ``ordinal`` tells them apart."""
    rows = pages.select(F.col("id").alias("page_id"), "title", "tags", F.explode(split_sections("body")).alias("s"))
    return rows.select(text.section_id("page_id", "s.header").alias("section_id"), "page_id", F.col("s.header").alias("header"), F.col("s.body").alias("body"), "title", "tags", F.col("s.ordinal").alias("ordinal"))


def search_fields(sections: DataFrame) -> DataFrame:
    """Sections as index fields: header weighs 4, body 1; id, title and tags only count for document frequency (Q4)."""
    kinds = F.array(*[F.struct(F.lit(n).alias("field"), c.alias("text"), F.lit(w).alias("weight")) for n, c, w in (("header", F.col("header"), 4.0), ("body", F.col("body"), 1.0), ("id", F.col("page_id"), 0.0), ("title", F.col("title"), 0.0), ("tags", F.concat_ws(" ", "tags"), 0.0))])
    return sections.select(F.col("section_id").alias("doc_id"), F.explode(kinds).alias("f")).select("doc_id", "f.field", "f.text", "f.weight")


def resolve_references(found: DataFrame, pages: DataFrame) -> DataFrame:
    """``found(src, ref)`` with the page's title and content, or ``error``."""
    named = found.withColumn("id", F.concat(F.lit("wiki:"), F.replace("ref", F.lit("/"), F.lit(":"))))
    joined = named.join(pages.select("id", "title", "content"), "id", "left")
    return joined.withColumn("error", F.when(F.col("content").isNull(), F.concat(F.lit("unknown page "), "ref")))


def resolve_query(pages: DataFrame, query: str) -> DataFrame:
    """The page that a text names: by id, else by title or id without case."""
    q = F.lit(query)
    rank = F.when(F.col("id") == q, 0).when((F.lower("title") == F.lower(q)) | (F.lower("id") == F.lower(q)), 1)
    return pages.withColumn("_rank", rank).where("_rank is not null").orderBy("_rank", "id").limit(1).drop("_rank")
