"""Unified search over a knowledge base: mode choice, hybrid fusion, ranking, context assembly."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scoring, text
from ..operators import codeintel, graph, lexical, vector
from ..sources import wiki
from ..sources.store import stored

# fixed values: statuses that a page of a type may have
ALLOWED_STATUSES = {
    "task": ["todo", "in-progress", "in-review", "done", "blocked", "cancelled"], "spec": ["draft", "reviewed", "approved", "superseded"],
    "decision": ["draft", "approved", "superseded", "rejected", "archived"], "rule": ["draft", "active", "superseded", "archived"], "other": ["draft", "reviewed", "approved", "archived"],
}
MODES = ("auto", "keyword", "semantic", "hybrid")
BUDGET, BUDGET_MIN, BUDGET_MAX = 8192, 256, 131072
UNKNOWN_DAYS = 7.0
CONTEXT = T.StructType([T.StructField("id", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("text", T.StringType())])


def _allowed_status(page_type: Column, status: Column) -> Column:
    out = status.isin(*ALLOWED_STATUSES["other"])
    for kind, allowed in ALLOWED_STATUSES.items():
        out = F.when(page_type == kind, status.isin(*allowed)).otherwise(out)
    return out


def _stemmed(sections: DataFrame) -> DataFrame:
    """Sections with the stem of their lower-cased title, so that queries need no Python for it."""
    return sections.withColumn("title_stem", text.stem(F.lower("title")))


def parse_mode(mode: str | None) -> str:
    """A mode's name; nothing means hybrid, an unknown name keyword."""
    if mode is None:
        return "hybrid"
    return mode.lower() if mode.lower() in MODES else "keyword"


def auto_detect(query: str) -> str:
    return "keyword" if "_" in query or "-" in query or sum(c.isupper() for c in query) > 2 else "hybrid"


@dataclass
class Response:
    results: DataFrame
    degraded: bool = False
    warning: str | None = None


@dataclass
class KnowledgeBase:
    """Pages with everything derived from them; ``vectors(id, v)`` and ``embed`` (text to vector) are optional."""

    pages: DataFrame
    sections: DataFrame
    edges: DataFrame
    index: lexical.Index
    vectors: DataFrame | None = None
    embed: object = None
    strict_compat: bool = False
    #: Resolved edges of a code index (``sources.code.load_edges``).
    code_edges: DataFrame | None = None
    options: dict = field(default_factory=dict)

    @classmethod
    def from_folder(cls, spark: SparkSession, folder: str, **more) -> KnowledgeBase:
        return cls.from_pages(wiki.pages(wiki.scan(spark, folder)), **more)

    @classmethod
    def from_pages(cls, pages: DataFrame, **more) -> KnowledgeBase:
        sections = stored(_stemmed(wiki.sections(pages)), "sections")
        return cls(pages, sections, graph.build_edges(pages), lexical.build_index(wiki.search_fields(sections), stems=True), **more)

    # ---- search ------------------------------------------------------------

    def documents(self) -> DataFrame:
        return self.sections.select(F.col("section_id").alias("doc_id"), "title", F.concat_ws(" ", "tags").alias("tags"), "title_stem")

    def _semantic(self, query: str, limit: int) -> DataFrame:
        q = [float(x) for x in self.embed(query)]
        return vector.top_k_cosine(self.vectors, q, limit, "id", "v")

    def search(self, query: str, mode: str | None = "auto", limit: int = 10, offset: int = 0, recency: bool = True) -> Response:
        """Ranked results ``id, title, page_type, score, centrality, ...``; see ``rank`` for the order.

        Hybrid search without an embedder degrades to keyword search and says
        so; semantic search without one is an error.
        """
        mode = parse_mode(mode)
        mode = auto_detect(query) if mode == "auto" else mode
        ready = self.vectors is not None and self.embed is not None
        degraded, warning = False, None
        if mode == "semantic" and not ready:
            raise ValueError("semantic search needs vectors and an embedder")
        if mode == "hybrid" and not ready:
            mode, degraded, warning = "keyword", True, "no embedder: keyword results only"
        if mode == "keyword":
            hits = lexical.keyword_search(self.index, self.documents(), query, limit).select(F.col("doc_id").alias("id"), "score")
        elif mode == "semantic":
            hits = self._semantic(query, limit)
        else:
            # twice the limit from each list: part of the semantics, as it decides which ids meet
            words = lexical.keyword_search(self.index, self.documents(), query, 2 * limit)
            near = self._semantic(query, 2 * limit)
            fused = vector.rrf(vector.ranked(words, 2 * limit, "doc_id"), vector.ranked(near, 2 * limit))
            docs = self.documents().withColumnRenamed("doc_id", "id").dropDuplicates(["id"])
            hits = vector.rerank_fused(fused.join(docs, "id", "left"), query).orderBy(F.desc("score"), "id").limit(limit)
        return Response(self.rank(hits, limit, offset, recency), degraded, warning)

    def rank(self, hits: DataFrame, limit: int, offset: int = 0, recency: bool = True) -> DataFrame:
        """Hits with their page, ordered by score, weighted inbound centrality, type rank and id.

        The reported ``centrality`` is the number of relations, the sort key the
        weighted inbound sum (Q12).  The offset skips rows of the limited list
        and leaves at least one (Q11).
        """
        meta = self.pages.select(F.col("id").alias("_base"), "title", "page_type", F.size("relates_to").alias("centrality"), "updated_at")
        inbound = graph.centrality(self.edges).select(F.col("id").alias("_base"), F.col("centrality").alias("_weight"))
        rows = hits.withColumn("_base", text.base_id("id")).join(meta, "_base", "left").join(inbound, "_base", "left")
        if recency:
            days = F.lit(UNKNOWN_DAYS)
            if not self.strict_compat:
                since = F.floor((F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp(F.try_to_timestamp("updated_at"))) / 3600) / 24
                days = F.coalesce(since, days)
            factor = F.when(F.col("page_type") == "task", scoring.recency(days)).otherwise(F.lit(1.0))
            rows = rows.withColumn("recency", factor).withColumn("score", F.col("score") * F.col("recency"))
        ordered = rows.orderBy(F.desc("score"), F.coalesce("_weight", F.lit(0.0)).desc(), scoring.page_type_rank("page_type").desc(), "id").limit(limit)
        if offset:
            ordered = ordered.offset(min(offset, max(ordered.count() - 1, 0)))
        return ordered.drop("_base", "_weight", "updated_at")

    def resolve(self, query: str, candidates: int = 5) -> DataFrame:
        """The page a text names, else the best keyword candidates."""
        exact = wiki.resolve_query(self.pages, query)
        if not exact.isEmpty():
            return exact.select("id", "title", F.lit(1.0).alias("score"))
        found = lexical.keyword_search(self.index, self.documents(), query, candidates)
        return found.select(text.base_id("doc_id").alias("id"), F.col("snippet").alias("title"), "score")

    def retrieve(self, query: str, budget: int = BUDGET) -> DataFrame:
        """Context for a query: its best page and that page's neighbours, packed into the budget."""
        best = self.search(query, "auto", 1).results.select(text.base_id("id").alias("id"))
        return context(self.pages, self.edges, best, query, budget)

    def retrieve_with_memories(self, query: str, budget: int = BUDGET) -> DataFrame:
        """The packed context, then memories that a search finds, as long as their bytes fit what is left: ``(id, score, text, type)``."""
        pages = self.retrieve(query, budget).withColumn("type", F.lit("page"))
        hits = self.of_type("memory").search(query, "auto", 10, recency=False).results.select(text.base_id("id").alias("id"), "score")
        said = hits.groupBy("id").agg(F.max("score").alias("score")).join(self.pages.select("id", "title", "body"), "id")
        note = F.concat(F.lit("[memory:"), "id", F.lit("] "), "title", F.lit(" — "), F.trim("body"), F.lit("\n"))
        left = budget - (pages.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0)
        rows, taken = said.select("id", "score", note.alias("text")).orderBy(F.desc("score"), "id").collect(), []  # ten at most
        for r in rows:
            if len(r["text"].encode()) <= left:
                left -= len(r["text"].encode())
                taken.append((r["id"], r["score"], r["text"], "memory"))
        return pages.unionByName(pages.sparkSession.createDataFrame(taken, pages.schema))

    def of_type(self, page_type: str) -> KnowledgeBase:
        """The part of the base with the pages of one type; statistics stay those of the whole."""
        pages = self.pages.where(F.col("page_type") == page_type)
        sections = self.sections.join(pages.select(F.col("id").alias("page_id")), "page_id", "left_semi")
        postings = self.index.postings.join(sections.select(F.col("section_id").alias("doc_id")).distinct(), "doc_id", "left_semi")
        return replace(self, pages=pages, sections=sections, index=replace(self.index, postings=postings))

    # ---- upkeep ------------------------------------------------------------

    def changed(self, files: DataFrame | None = None, gone: list[str] | None = None) -> KnowledgeBase:
        """The base after ``files(path, content)`` were created or updated and the pages ``gone`` deleted.

        Pages, sections and vectors of these ids are replaced, the index moves
        by deltas of their sections, and the edges are built anew.  New sections
        have no vector until ``embed`` gives them one here.
        """
        new = wiki.pages(files) if files is not None else self.pages.limit(0)
        bad = new.where(~_allowed_status(F.col("page_type"), F.col("status"))).select("id", "status").first()
        if bad is not None:
            raise ValueError(f"status {bad['status']} is not allowed for {bad['id']}")
        ids = new.select("id")
        if gone:
            ids = ids.unionByName(self.pages.sparkSession.createDataFrame([(g,) for g in gone], "id string"))
        ids = stored(ids.distinct(), "changed-ids")
        pages = stored(self.pages.join(ids, "id", "left_anti").unionByName(new), "pages")
        of = ids.withColumnRenamed("id", "page_id")
        was, now = self.sections.join(of, "page_id", "left_semi"), stored(_stemmed(wiki.sections(new)), "new-sections")
        sections = stored(self.sections.join(of, "page_id", "left_anti").unionByName(now), "sections")
        index = lexical.merge_statistics(self.index, wiki.search_fields(was), wiki.search_fields(now))
        vectors = self.vectors
        if vectors is not None:
            vectors = vectors.withColumn("_base", text.base_id("id")).join(ids.withColumnRenamed("id", "_base"), "_base", "left_anti").drop("_base")
            if self.embed is not None:
                made = embed_batches(now.select(F.col("section_id").alias("id"), F.concat_ws("\n", "header", "body").alias("text")), self.embed)
                vectors = vectors.select("id", "v").unionByName(made.select("id", F.col("v").cast(dict(vectors.dtypes)["v"]).alias("v")))
        return replace(self, pages=pages, sections=sections, edges=graph.build_edges(pages), index=index, vectors=vectors)

    def status(self, code_lag: int | None = None, stale: bool = False) -> dict:
        """Sizes of everything derived, and how far the code index is behind."""
        n = lambda df: 0 if df is None else df.count()
        return {
            "graph_nodes": n(self.pages), "graph_edges": n(self.edges), "sections": n(self.sections), "indexed": self.index.total.first()["n"] or 0, "vectors": n(self.vectors),
            "embedder_loaded": self.embed is not None, "stale": stale, "code_index_age_seconds": code_lag,
        }

    # ---- dispatch ------------------------------------------------------------

    def call(self, operation: str, **arguments) -> DataFrame:
        """An operation by name, as a tool registry would offer it."""
        table = {
            "search.query": lambda **a: self.search(**a).results, "search.resolve": self.resolve, "search.retrieve": self.retrieve, "search.context": self.retrieve_with_memories,
            "graph.neighbors": self.neighbors,
            "graph.subgraph": lambda node, depth=1: graph.subgraph(self.edges, node, depth)[0],
            "graph.path": lambda start, end, max_depth=10: graph.shortest_path(self.edges, start, end, max_depth),
            "graph.affected": lambda node, max_depth=10: graph.affected(self.edges, node, max_depth),
            "graph.stats": lambda: graph.stats(self.pages, self.edges), "page.list": self.list_pages,
            "page.get": lambda id: self.pages.where(F.col("id") == re.sub("#.*", "", id)),
        }
        if operation not in table:
            raise KeyError(f"unknown operation: {operation}")
        return table[operation](**arguments)

    def neighbors(self, node: str, query: str | None = None) -> DataFrame:
        """Neighbours among pages and, with ``code_edges``, among sources, the best first."""
        found = graph.neighbors(self.edges, self.pages, node, query)
        if self.code_edges is None:
            return found
        return found.unionByName(codeintel.code_neighbors(self.code_edges, node, query)).orderBy(F.desc("score"), "other", "edge_type")

    def list_pages(self, page_type: str | None = None) -> DataFrame:
        rows = self.pages if page_type is None else self.pages.where(F.col("page_type") == page_type)
        return rows.select("id", "title", "page_type", "status").orderBy("id")


def _pack(pdf: pd.DataFrame, budget: int) -> list[tuple]:
    """Greedy packing of scored parts: one that doesn't fit is skipped, a part costs a quarter of its bytes."""
    out, used = [], 0
    for r in pdf.sort_values(["is_seed", "score", "seq"], ascending=[False, False, True]).itertuples():
        if r.is_seed:
            options = [f"[MATCH: {r.id}]\nTitle: {r.title}\n{r.sources}", f"[MATCH: {r.id}]\nTitle: {r.title}", f"[MATCH: {r.id}]"]
        elif used >= budget:
            break
        elif r.score > 5:
            options = [f"[{r.edge}: {r.id}]\nTitle: {r.title}"]
        elif r.score > 2:
            options = [f"[{r.edge}: {r.id}]"]
        else:
            options = [f"  {r.id} --[{r.edge}]--> {r.title}"]
        for o in options:
            cost = len(o.encode()) // 4
            if cost <= budget - used and (cost or not r.is_seed):
                out.append((r.id, float(r.score), o))
                used += cost
                break
    return sorted(out, key=lambda x: -x[1])


def context(pages: DataFrame, edges: DataFrame, seeds: DataFrame, query: str, budget: int = BUDGET) -> DataFrame:
    """The seed page and its out-neighbours as text within a token budget: ``(id, score, text)``.

    Neighbours are scored in the plan (priority times the query's match of their
    titles); only their packing, which depends on what was skipped before, runs
    per seed on the seed's own neighbourhood.
    """
    budget = max(BUDGET_MIN, min(BUDGET_MAX, budget))
    q = F.lit(query.lower())
    meta = pages.select("id", "title", F.array_join("sources", ", ").alias("sources"))
    first = edges.join(seeds.select(F.col("id").alias("src")), "src", "left_semi").where("src <> dst").groupBy("src", "dst").agg(F.min_by(F.struct("edge_type", "seq"), "seq").alias("e"))
    title = F.lower("title")
    match = F.when(title == q, 8.0).when(F.contains(title, q), 4.0).otherwise(0.0)
    near = first.join(meta.withColumnRenamed("id", "dst"), "dst").select("src", F.col("dst").alias("id"), "title", "sources", F.replace("e.edge_type", F.lit("_"), F.lit("")).alias("edge"), (scoring.edge_priority("e.edge_type") * (1 + match)).alias("score"), F.col("e.seq").cast("long").alias("seq"), F.lit(False).alias("is_seed"))
    own = seeds.select("id").distinct().join(meta, "id").select(F.col("id").alias("src"), "id", "title", "sources", F.lit("").alias("edge"), F.lit(999.0).alias("score"), F.lit(0).cast("long").alias("seq"), F.lit(True).alias("is_seed"))

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_pack(pdf, budget), columns=CONTEXT.names)

    return own.unionByName(near).groupBy("src").applyInPandas(packed, CONTEXT)


def embed_batches(rows: DataFrame, embed, text_column: str = "text") -> DataFrame:
    """``rows`` with ``v``: an embedder called once a partition on Arrow batches (it must be picklable)."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: [float(x) for x in embed(t or "")])

    return rows.withColumn("v", run(F.col(text_column)))
