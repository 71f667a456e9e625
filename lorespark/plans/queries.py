"""Registered queries of the search, graph and tracking operators over the driver tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..operators import codeintel, graph, history, lexical, logs, rules, tracking, vector
from ..sources import code
from ..sources.store import checkpointed, scratch, spread, stored, table
from ..streaming import feeds

QUERIES: dict = {}
SQL: dict[str, str] = {}
AS_OF = "2030-01-01"
TOKENS = r"regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9_\-]+')"
#: The code-aware tokens of a text in SQL: compounds, then parts of more than one character.
CODE_TOKENS = (
    "flatten(list_transform(" + TOKENS + r", lambda t: CASE WHEN regexp_matches(t, '[_\-]') "
    r"THEN list_concat([t], list_filter(regexp_split_to_array(t, '[_\-]'), lambda p: length(p) > 1)) ELSE list_filter([t], lambda p: length(p) > 1) END))"
)


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def six(c) -> F.Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * 1e6 + 0.5) / 1e6


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def _body(spark: SparkSession, d: str) -> DataFrame:
    """Documents as one field each; ``doc_id`` is their key, so a (term, document) pair is one row of counts."""
    return _documents(spark, d).select("doc_id", F.lit("body").alias("field"), "text", F.lit(1.0).alias("weight"))


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


# ---- lexical -----------------------------------------------------------------


@register(f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({CODE_TOKENS.format('text')}) AS term FROM documents) GROUP BY term")
def tok_df(spark, d):
    """Document and collection frequency of every term."""
    return lexical.term_frequencies(_body(spark, d)).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@register(
    f"WITH t AS (SELECT doc_id, unnest({CODE_TOKENS.format('text')}) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL) "
    "SELECT doc_id, CAST(sum(tf) AS BIGINT) AS tokens, count(*) AS terms, max(tf) AS max_tf FROM c GROUP BY doc_id"
)
def term_freq(spark, d):
    """Tokens, distinct terms and the highest term frequency of every document."""
    return lexical.term_frequencies(_body(spark, d)).groupBy("doc_id").agg(F.sum("tf").alias("tokens"), F.count(F.lit(1)).alias("terms"), F.max("tf").alias("max_tf"))


BM25_SQL = """
WITH f AS ({fields}), t AS (
  SELECT doc_id, field, weight, unnest(tk) AS term, len(tk) AS length FROM (SELECT *, {tokens} AS tk FROM f)
), p AS (SELECT doc_id, field, weight, term, length, count(*) AS tf FROM t GROUP BY ALL
), df AS (SELECT term, count(DISTINCT doc_id) AS df FROM p GROUP BY term
), l AS (SELECT field, greatest(sum(length) * 1.0::DOUBLE / count(*), 1.0::DOUBLE) AS mean FROM (SELECT DISTINCT doc_id, field, length FROM p) GROUP BY field
), q AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({qtokens}) AS term FROM benchmark) GROUP BY ALL
), s AS (
  SELECT query_id, doc_id, round(sum(weight * times * ln(1 + ((SELECT count(DISTINCT doc_id) FROM documents) - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))
         * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean)))), 9) AS score
  FROM p JOIN q USING (term) JOIN df USING (term) JOIN l USING (field) WHERE weight <> 0 GROUP BY query_id, doc_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM s)
SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, floor(score * 1e6 + 0.5) / 1e6 AS score FROM r WHERE rank < 10
"""
BODY = "SELECT doc_id, 'body' AS field, text, 1.0::DOUBLE AS weight FROM documents"
TWO = """SELECT doc_id, 'header' AS field, split_part(text, chr(10), 1) AS text, 4.0::DOUBLE AS weight FROM documents UNION ALL
SELECT doc_id, 'body' AS field, CASE WHEN contains(text, chr(10)) THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS text, 1.0::DOUBLE AS weight FROM documents"""


def _top10(spark, d, fields: DataFrame) -> DataFrame:
    terms = stored(lexical.query_terms(_queries(spark, d)), "terms")
    scores = lexical.bm25(lexical.build_index(fields, only=terms), terms)
    return lexical.top_k(scores, 10).select("query_id", "doc_id", F.col("rank").cast("int").alias("rank"), six("score").alias("score"))


@register(BM25_SQL.format(fields=BODY, tokens=CODE_TOKENS.format("text"), qtokens=CODE_TOKENS.format("text")))
def bm25_topk(spark, d):
    """Ten best documents for every benchmark text."""
    return _top10(spark, d, _body(spark, d))


def _fields(docs: DataFrame) -> DataFrame:
    first = F.substring_index("text", "\n", 1)
    rest = F.when(F.contains("text", F.lit("\n")), F.expr("substring(text, instr(text, '\\n') + 1)")).otherwise("")
    kinds = F.array(F.struct(F.lit("header").alias("field"), first.alias("text"), F.lit(4.0).alias("weight")), F.struct(F.lit("body").alias("field"), rest.alias("text"), F.lit(1.0).alias("weight")))
    return docs.select("doc_id", F.explode(kinds).alias("f")).select("doc_id", "f.*")


@register(BM25_SQL.format(fields=TWO, tokens=CODE_TOKENS.format("text"), qtokens=CODE_TOKENS.format("text")))
def bm25_fields(spark, d):
    """The same with the first line as a header of weight 4."""
    return _top10(spark, d, _fields(_documents(spark, d)))


@register()
def bm25_stemmed(spark, d):
    """Stemmed index, benchmark texts as queries; no SQL, as the oracle has no stemmer."""
    fields = _fields(_documents(spark, d))
    terms = stored(lexical.query_terms(_queries(spark, d)), "terms")
    stems = terms.select("term").distinct().withColumn("stem", text.stem("term")).where("stem <> term and not term rlike '[_-]'")
    more = terms.join(stems, "term").select("query_id", F.col("stem").alias("term"), "times")
    both = stored(terms.unionByName(more).groupBy("query_id", "term").agg(F.sum("times").alias("times")), "terms")
    index = lexical.build_index(fields, stems=True, only=both)
    return lexical.top_k(lexical.bm25(index, both), 10).select("query_id", "doc_id", F.col("rank").cast("int").alias("rank"), six("score").alias("score"))


@register(
    "SELECT p_partkey, p_name, CAST((CASE WHEN lower(p_name) = 'small ring' THEN 8 WHEN starts_with(lower(p_name), 'small ring') OR starts_with('small ring', lower(p_name)) THEN 4 "
    "WHEN contains(lower(p_name), 'small ring') THEN 2 ELSE 0 END) + (CASE WHEN CAST(p_partkey AS VARCHAR) = 'small ring' THEN 7 ELSE 0 END) "
    "+ (CASE WHEN contains(lower(p_type), 'small') OR contains(lower(p_type), 'ring') THEN 3 ELSE 0 END) AS DOUBLE) AS boost FROM part"
)
def title_boost(spark, d):
    """Keyword boosts of parts for the query "small ring": name as title, type as tags."""
    parts = table(spark, d, "part").select("p_partkey", "p_name", "p_type", F.col("p_partkey").cast("string").alias("key"))
    return parts.select("p_partkey", "p_name", lexical.boost("small ring", "p_name", "key", "p_type").alias("boost"))


@register(
    """WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(split_part(text, chr(10), 1), '') || ' ' || text, '\\s+'), lambda t: t <> '') AS tk, split_part(text, chr(10), 1) AS title FROM documents),
s AS (SELECT count(*) AS n, greatest(avg(len(tk)), 1.0::DOUBLE) AS mean, sum((len(list_filter(tk, lambda t: t = 'the')) > 0)::BIGINT) AS d1, sum((len(list_filter(tk, lambda t: t = 'de')) > 0)::BIGINT) AS d2 FROM d),
f AS (SELECT doc_id, title, len(tk) AS l, len(list_filter(tk, lambda t: t = 'the')) AS a, len(list_filter(tk, lambda t: t = 'de')) AS b, n, mean, d1, d2 FROM d, s)
SELECT doc_id, floor((CASE WHEN a > 0 THEN ln(1 + (n - d1 + 0.5::DOUBLE) / (d1 + 0.5::DOUBLE)) * (a * 2.2::DOUBLE / (a + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / mean))) ELSE 0 END
 + CASE WHEN b > 0 THEN ln(1 + (n - d2 + 0.5::DOUBLE) / (d2 + 0.5::DOUBLE)) * (b * 2.2::DOUBLE / (b + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / mean))) ELSE 0 END
 + CASE WHEN contains(lower(title), 'the de') THEN 0.15 ELSE 0 END) * 1e6 + 0.5) / 1e6 AS score FROM f"""
)
def rerank_client(spark, d):
    """White-space BM25 of all documents for the query "the de"."""
    docs = _documents(spark, d).select(F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("body"))
    return lexical.rerank_client(docs, "the de").select(F.col("id").alias("doc_id"), six("score").alias("score"))


@register(
    """WITH t AS (SELECT doc_id, unnest(%s) AS term FROM documents WHERE doc_id > 0), p AS (SELECT DISTINCT doc_id, term FROM t)
SELECT term, count(*) AS df FROM p GROUP BY term"""
    % CODE_TOKENS.format("CASE WHEN doc_id = 1 THEN 'a new text' ELSE text END")
)
def index_delta(spark, d):
    """Document frequencies after one document went and another changed, from deltas."""
    fields = _body(spark, d)
    gone = fields.where("doc_id in (0, 1)")
    new = fields.where("doc_id = 1").withColumn("text", F.lit("a new text"))
    return lexical.merge_statistics(lexical.build_index(fields), gone, new).frequencies


# ---- vectors and fusion ------------------------------------------------------

DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"


def _vector(spark, d, vec_id: int = 0) -> list[float]:
    return [float(x) for x in table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]]


@register(f"SELECT vec_id, floor(greatest(0, least(1, {DOT.format('e.embedding', 'q.v')})) * 1e6 + 0.5) / 1e6 AS score FROM embeddings e, (SELECT embedding AS v FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, vec_id LIMIT 10")
def cosine_topk(spark, d):
    """Ten nearest vectors of vector 0."""
    rows = vector.top_k_cosine(table(spark, d, "embeddings"), _vector(spark, d), 10)
    return rows.select("vec_id", six("score").alias("score"))


@register(
    f"WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, greatest(0, least(1, {DOT.format('q.embedding', 'e.embedding')})) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS rank FROM s) "
    "SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, floor(score * 1e6 + 0.5) / 1e6 AS score FROM r WHERE rank < 5"
)
def cosine_topk_many(spark, d):
    """Five nearest vectors of every vector whose id is divisible by 20."""
    vectors = table(spark, d, "embeddings")
    queries = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return vector.top_k_cosine_many(vectors, queries, 5).select("query_id", "vec_id", F.col("rank").cast("int").alias("rank"), six("score").alias("score"))


@register(
    f"SELECT vec_id, floor((1 - {DOT.format('e.embedding', 'q.v')} / (sqrt({DOT.format('e.embedding', 'e.embedding')}) * sqrt({DOT.format('q.v', 'q.v')}))) * 1e6 + 0.5) / 1e6 AS distance "
    "FROM embeddings e, (SELECT embedding AS v FROM embeddings WHERE vec_id = 1) q ORDER BY distance, vec_id LIMIT 10"
)
def cosine_distance(spark, d):
    """Ten vectors at the least cosine distance from vector 1."""
    return vector.nearest(table(spark, d, "embeddings"), _vector(spark, d, 1), 10).select("vec_id", six("distance").alias("distance"))


@register(f"SELECT vec_id, floor(sqrt({DOT.format('embedding', 'embedding')}) * 1e6 + 0.5) / 1e6 AS norm, floor(list_extract(embedding, 1) / sqrt({DOT.format('embedding', 'embedding')}) * 1e6 + 0.5) / 1e6 AS head FROM embeddings")
def unit_vectors(spark, d):
    """Norm and first component of every vector after normalising."""
    e = table(spark, d, "embeddings")
    norm = F.sqrt(scoring.dot("embedding", "embedding"))
    return e.select("vec_id", six(norm).alias("norm"), six(F.element_at(scoring.unit("embedding"), 1)).alias("head"))


@register(
    f"""WITH a AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS rank FROM orders QUALIFY rank < 100),
b AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) - 1 AS rank FROM orders QUALIFY rank < 100),
m AS (SELECT coalesce(a.id, b.id) AS id, coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0) AS score, b.id IS NOT NULL AS in_semantic FROM a FULL JOIN b USING (id))
SELECT id, floor(score * 1e6 + 0.5) / 1e6 AS score, in_semantic FROM m"""
)
def rrf_hybrid(spark, d):
    """Fusion of two lists of a hundred orders, the dearest and the latest."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice", F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("day"))
    fused = vector.rrf(vector.ranked(orders, 100, score="o_totalprice"), vector.ranked(orders, 100, score="day"))
    return fused.select("id", six("score").alias("score"), "in_semantic")


@register(
    """WITH f AS (SELECT p_partkey AS id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY p_partkey) - 1) AS rrf, lower(p_name) AS t, lower(p_brand || ' ' || p_type) AS g FROM part),
m AS (SELECT *, 0.03::DOUBLE * (CASE WHEN contains(t, 'small') THEN 1 ELSE 0 END + CASE WHEN contains(t, 'ring') THEN 1 ELSE 0 END) AS td,
 CASE WHEN t = 'small ring' THEN 0.15::DOUBLE WHEN starts_with(t, 'small ring') OR starts_with('small ring', t) THEN 0.08::DOUBLE WHEN contains(t, 'small ring') THEN 0.04::DOUBLE ELSE 0 END AS ti,
 (CASE WHEN contains(g, 'small') THEN 1 ELSE 0 END + CASE WHEN contains(g, 'ring') THEN 1 ELSE 0 END) / 2.0::DOUBLE AS share FROM f)
SELECT id, floor((rrf + td + ti) * (1 + share * 0.1::DOUBLE) * 1e6 + 0.5) / 1e6 AS score, floor((rrf + td + ti) * share * 0.1::DOUBLE * 1e6 + 0.5) / 1e6 AS tag_overlap FROM m"""
)
def rerank_breakdown(spark, d):
    """Rerank bonuses of all parts for "small ring"."""
    parts = table(spark, d, "part")
    rows = parts.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.concat_ws(" ", "p_brand", "p_type").alias("tags"))
    all_ranked = graph.with_seq(rows.select("id"), "id").select("id", (1.0 / (F.lit(60.0) + F.col("seq") - 1)).alias("score"))
    out = vector.rerank_fused(all_ranked.join(rows, "id").withColumn("id", F.col("id").cast("string")), "small ring")
    return out.select(F.col("id").cast("long").alias("id"), six("score").alias("score"), six("tag_overlap").alias("tag_overlap"))


def _days(c: str) -> F.Column:
    return F.datediff(F.lit(AS_OF).cast("date"), F.col(c).cast("date"))


@register(
    f"""WITH d AS (SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '{AS_OF}') AS days FROM orders)
SELECT o_orderkey, floor(CASE WHEN days <= 0 THEN 1 ELSE greatest(0, least(1, pow(1 + {scoring.FSRS_FACTOR!r}::DOUBLE * days / 7.0::DOUBLE, -0.1542::DOUBLE))) END * 1e6 + 0.5) / 1e6 AS fsrs,
 floor(CASE WHEN days <= 0 THEN 1 ELSE greatest(1 - days / 700.0::DOUBLE, 0) END * 1e6 + 0.5) / 1e6 AS linear,
 floor(CASE WHEN days <= 0 THEN 1 ELSE exp(-days / 700.0::DOUBLE) END * 1e6 + 0.5) / 1e6 AS exponential,
 floor(1 / (1 + days / 700.0::DOUBLE) * 1e6 + 0.5) / 1e6 AS hyperbolic FROM d"""
)
def recency_models(spark, d):
    """All decay models of the age of every order."""
    rows = table(spark, d, "orders").select("o_orderkey", _days("o_orderdate").alias("days"))
    return rows.select(
        "o_orderkey", six(scoring.recency("days", "fsrs", 7.0)).alias("fsrs"), six(scoring.recency("days", "linear", 700.0)).alias("linear"),
        six(scoring.recency("days", "exponential", 700.0)).alias("exponential"), six(scoring.version_score("days", 700.0)).alias("hyperbolic"),
    )


@register(r"SELECT doc_id, CASE WHEN contains(text, '_') OR contains(text, '-') OR len(regexp_extract_all(text, '\p{Lu}')) > 2 THEN 'keyword' ELSE 'hybrid' END AS mode FROM documents")
def auto_mode(spark, d):
    """The mode that each document's text would choose as a query."""
    return _documents(spark, d).select("doc_id", scoring.auto_mode("text").alias("mode"))


@register("SELECT o_orderstatus, o_orderkey, floor(least(1, greatest(CASE WHEN o_totalprice / m < 0.01 THEN 0.01 ELSE floor(o_totalprice / m * 10000 + 0.5) / 10000 END, 0.01)) * 1e6 + 0.5) / 1e6 AS score FROM (SELECT *, max(o_totalprice) OVER () AS m FROM orders)")
def normalised_scores(spark, d):
    """Order prices as normalised scores."""
    orders = table(spark, d, "orders")
    top = orders.agg(F.max("o_totalprice").alias("m")).scalar()
    return orders.select("o_orderstatus", "o_orderkey", six(scoring.normalised("o_totalprice", top)).alias("score"))


# ---- graph -------------------------------------------------------------------


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Typed edges of the star schema: orders, customers, suppliers, nations, regions."""
    one = lambda df, s, a, t, b, kind, prov: df.select(F.concat(F.lit(s), F.col(a).cast("string")).alias("src"), F.concat(F.lit(t), F.col(b).cast("string")).alias("dst"), F.lit(kind).alias("edge_type"), prov.alias("provenance"))
    explicit = F.lit("explicit")
    c = one(table(spark, d, "customer"), "c:", "c_custkey", "n:", "c_nationkey", "extends", F.when(F.col("c_acctbal") < 0, "derived").otherwise("explicit"))
    s = one(table(spark, d, "supplier"), "s:", "s_suppkey", "n:", "s_nationkey", "depends_on", F.when(F.col("s_acctbal") < 0, "ambiguous").otherwise("explicit"))
    n = one(table(spark, d, "nation"), "n:", "n_nationkey", "r:", "n_regionkey", "part_of", explicit)
    o = one(table(spark, d, "orders"), "o:", "o_orderkey", "c:", "o_custkey", "depends_on", explicit)
    return c.unionByName(s).unionByName(n).unionByName(o).withColumn("seq", F.xxhash64("src", "dst"))


EDGES = """e AS (SELECT 'c:' || c_custkey AS src, 'n:' || c_nationkey AS dst, 'extends' AS edge_type, CASE WHEN c_acctbal < 0 THEN 'derived' ELSE 'explicit' END AS provenance FROM customer
UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'depends_on', CASE WHEN s_acctbal < 0 THEN 'ambiguous' ELSE 'explicit' END FROM supplier
UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey, 'part_of', 'explicit' FROM nation
UNION ALL SELECT 'o:' || o_orderkey, 'c:' || o_custkey, 'depends_on', 'explicit' FROM orders)"""
PRIORITY = "CASE edge_type WHEN 'extends' THEN 10 WHEN 'depends_on' THEN 5 WHEN 'part_of' THEN 8 ELSE 0 END"
FACTOR = "CASE provenance WHEN 'derived' THEN 0.5 WHEN 'ambiguous' THEN 0.25 ELSE 1.0 END"


def pages(spark: SparkSession, d: str) -> DataFrame:
    """Customers, suppliers, nations and regions as pages."""
    one = lambda df, s, a, name, kind, tag: df.select(F.concat(F.lit(s), F.col(a).cast("string")).alias("id"), F.col(name).alias("title"), F.lit(kind).alias("page_type"), F.array(tag).alias("tags"))
    rows = one(table(spark, d, "customer"), "c:", "c_custkey", "c_name", "task", F.col("c_mktsegment"))
    rows = rows.unionByName(one(table(spark, d, "supplier"), "s:", "s_suppkey", "s_name", "spec", F.lit("supplier")))
    rows = rows.unionByName(one(table(spark, d, "nation"), "n:", "n_nationkey", "n_name", "concept", F.lit("nation")))
    return rows.unionByName(one(table(spark, d, "region"), "r:", "r_regionkey", "r_name", "core", F.lit("region")))


@register(f"WITH {EDGES} SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id")
def degree(spark, d):
    return graph.degrees(edges(spark, d))


@register(f"WITH {EDGES} SELECT dst AS id, floor(sum({PRIORITY} * {FACTOR}) * 1e6 + 0.5) / 1e6 AS centrality FROM e GROUP BY dst")
def centrality(spark, d):
    return graph.centrality(edges(spark, d)).select("id", six("centrality").alias("centrality"))


@register(
    f"WITH {EDGES} SELECT 'type:task' AS metric, count(*) AS value FROM customer UNION ALL SELECT 'type:spec', count(*) FROM supplier UNION ALL SELECT 'type:concept', count(*) FROM nation "
    "UNION ALL SELECT 'type:core', count(*) FROM region UNION ALL SELECT 'nodes', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) "
    "UNION ALL SELECT 'edges', count(*) FROM e"
)
def graph_stats(spark, d):
    return graph.stats(pages(spark, d), edges(spark, d))


@register(
    f"WITH {EDGES}, u AS (SELECT dst AS other, 'out' AS direction, edge_type FROM e WHERE src = 'n:1' UNION ALL SELECT src, 'in', edge_type FROM e WHERE dst = 'n:1' AND src <> dst), "
    "p AS (SELECT 'c:' || c_custkey AS other, c_name AS title FROM customer UNION ALL SELECT 's:' || s_suppkey, s_name FROM supplier UNION ALL SELECT 'r:' || r_regionkey, r_name FROM region) "
    f"SELECT other, direction, edge_type, CAST({PRIORITY} * (1 + CASE WHEN contains(lower(title), '1') THEN 4 ELSE 0 END) AS DOUBLE) AS score FROM u JOIN p USING (other)"
)
def neighbors(spark, d):
    """Neighbours of nation 1, scored for the query "1"."""
    tagless = pages(spark, d).withColumn("tags", F.array().cast("array<string>"))
    return graph.neighbors(edges(spark, d), tagless, "n:1", "1").select("other", "direction", "edge_type", "score")


REACH = """WITH RECURSIVE {edges}, u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
w(id, depth) AS (SELECT '{start}', 0 UNION SELECT b, depth + 1 FROM w JOIN u ON a = id WHERE depth < {depth})
SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY id"""


@register(REACH.format(edges=EDGES, start="r:1", depth=2))
def subgraph_d2(spark, d):
    """Nodes within two steps of region 1."""
    return graph.subgraph(edges(spark, d), "r:1", 2)[0]


@register(REACH.format(edges=EDGES, start="n:3", depth=3))
def bfs_depth3(spark, d):
    """Nodes within three steps of nation 3."""
    return graph.reach(graph.undirected(edges(spark, d)), spark.createDataFrame([("n:3",)], "id string"), 3)


@register(
    f"""WITH RECURSIVE {EDGES}, u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
w(id, depth) AS (SELECT 'c:1', 0 UNION SELECT b, depth + 1 FROM w JOIN u ON a = id WHERE depth < 6)
SELECT (SELECT 'r:' || n_regionkey FROM nation, customer WHERE n_nationkey = c_nationkey AND c_custkey = 1) AS id, CAST(min(depth) AS INTEGER) AS length, (SELECT 'n:' || n_nationkey || '>r:' || n_regionkey FROM nation, customer WHERE n_nationkey = c_nationkey AND c_custkey = 1) AS path FROM w WHERE id = (SELECT 'r:' || n_regionkey FROM nation, customer WHERE n_nationkey = c_nationkey AND c_custkey = 1) HAVING count(*) > 0"""
)
def shortest_path(spark, d):
    """Length of the shortest path from customer 1 to its region."""
    links = edges(spark, d)
    nation = table(spark, d, "customer").where("c_custkey = 1").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).first()
    return graph.shortest_path(links, "c:1", f"r:{nation['n_regionkey']}", 6).select("id", F.size("hops").alias("length"), F.array_join(F.transform("hops", lambda h: h["node"]), ">").alias("path"))


@register(
    f"""WITH RECURSIVE {EDGES}, w(id, depth, path) AS (SELECT 'n:2', 0, '' UNION SELECT src, depth + 1, path || '>' || src FROM w JOIN e ON dst = id WHERE depth < 10 AND edge_type IN ('depends_on', 'extends'))
SELECT id, CAST(depth AS INTEGER) AS depth, substr(path, 2) AS path FROM w WHERE id <> 'n:2'"""
)
def affected(spark, d):
    """Everything that depends on nation 2, directly or not."""
    return graph.affected(edges(spark, d), "n:2").select("id", "depth", F.array_join(F.transform("hops", lambda h: h["node"]), ">").alias("path"))


@register("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def orphans(spark, d):
    """Customers to which no order leads."""
    c = table(spark, d, "customer").select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("id"), "c_custkey", "c_name")
    return graph.orphans(c, edges(spark, d)).select("c_custkey", "c_name")


@register("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled(spark, d):
    """Documents without a label."""
    return _documents(spark, d).select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@register("SELECT 'n:' || n_nationkey AS src, 'r:' || n_regionkey AS dst FROM nation UNION ALL SELECT 'r:' || n_regionkey, 'n:' || n_nationkey FROM nation")
def cyclic_core(spark, d):
    """What peeling leaves of the star schema with nations' edges both ways."""
    e = edges(spark, d)
    back = e.where("edge_type = 'part_of'").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.cyclic_core(e.select("src", "dst").unionByName(back)).select("src", "dst")


@register(
    """WITH RECURSIVE l AS (SELECT DISTINCT 'p:' || l_partkey AS p, 's:' || l_suppkey AS s FROM lineitem), e AS (SELECT p AS a, s AS b FROM l UNION ALL SELECT s, p FROM l),
w(id, low) USING KEY (id) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, max(w.low) FROM w JOIN e ON e.a = w.id JOIN recurring.w AS r ON r.id = e.b WHERE w.low > r.low GROUP BY e.b)
SELECT low AS component, count(*) AS n FROM w GROUP BY low HAVING count(*) > 1"""
)
def strong_components(spark, d):
    """Components of parts and suppliers that lead to each other through order lines."""
    part, supplier = (F.concat(F.lit(p), F.col(c).cast("string")) for p, c in (("p:", "l_partkey"), ("s:", "l_suppkey")))
    # both ways of a line in one row's place, so that they meet before they are shuffled
    ways = F.explode(F.array(F.struct(part.alias("src"), supplier.alias("dst")), F.struct(supplier.alias("src"), part.alias("dst")))).alias("e")
    found = graph.strong_components(table(spark, d, "lineitem").where("l_partkey is not null and l_suppkey is not null").select(ways).select("e.src", "e.dst"))
    return found.groupBy("component").agg(F.count(F.lit(1)).alias("n"))


@register(f"WITH {EDGES} SELECT src AS id, list_sort(list(DISTINCT '- [[' || dst || ']] <!-- ' || edge_type || ' / ' || provenance || ' -->')) AS lines FROM e GROUP BY src")
def vault_links(spark, d):
    return graph.vault_links(edges(spark, d))


@register(f"""WITH {EDGES} SELECT '{{"source":"' || src || '","target":"' || dst || '","type":"' || edge_type || '","provenance":"' || provenance || '"}}' AS value FROM e""")
def export_json(spark, d):
    return graph.as_json(graph.export_edges(edges(spark, d)).drop("seq"))


# ---- tracking ----------------------------------------------------------------


@register(
    "SELECT CAST(ord AS INTEGER) AS ord, s.status, coalesce(n, 0) AS n FROM (SELECT unnest(range(15)) AS ord, unnest(["
    + ", ".join(f"'{s}'" for s in scoring.STATUSES)
    + "]) AS status) s LEFT JOIN (SELECT CASE o_orderstatus WHEN 'O' THEN 'todo' WHEN 'F' THEN 'done' ELSE 'in-progress' END AS status, count(*) AS n FROM orders GROUP BY 1) USING (status)"
)
def board(spark, d):
    """Orders by status on a board with all columns."""
    status = F.when(F.col("o_orderstatus") == "O", "todo").when(F.col("o_orderstatus") == "F", "done").otherwise("in-progress")
    return tracking.board(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status")))


@register("SELECT n_nationkey, n_name, coalesce(c, 0) AS subtasks FROM nation LEFT JOIN (SELECT c_nationkey AS n_nationkey, count(*) AS c FROM customer GROUP BY 1) USING (n_nationkey)")
def subtasks(spark, d):
    """Nations with their customers as subtasks."""
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("title"), "n_nationkey", F.lit("todo").alias("status"), F.lit(None).cast("string").alias("parent"))
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("title"), F.lit(None).cast("int").alias("n_nationkey"), F.lit("todo").alias("status"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("parent"))
    both = n.unionByName(c)
    return tracking.board_items(both).join(n.select("id", "n_nationkey"), "id").select("n_nationkey", F.col("title").alias("n_name"), "subtasks")


SPENT = "CASE event_type WHEN 'view' THEN floor(value)::BIGINT || 'h' WHEN 'click' THEN floor(value)::BIGINT || 'h ' || (event_id % 60) || 'm' WHEN 'error' THEN (event_id % 60) || 'm' WHEN 'signup' THEN '2' ELSE 'soon' END"


def _spent() -> F.Column:
    h, m = F.floor("value").cast("string"), (F.col("event_id") % 60).cast("string")
    kind = F.col("event_type")
    return F.when(kind == "view", F.concat(h, F.lit("h"))).when(kind == "click", F.concat(h, F.lit("h "), m, F.lit("m"))).when(kind == "error", F.concat(m, F.lit("m"))).when(kind == "signup", "2").otherwise("soon")


@register(f"SELECT event_id, spent, CAST(coalesce(try_cast(trim(split_part(spent, 'h', 1)) AS DOUBLE) * 60, 0) + coalesce(try_cast(regexp_replace(trim(split_part(spent, 'h', -1)), 'm+$', '') AS DOUBLE), 0) AS DOUBLE) AS minutes FROM (SELECT event_id, {SPENT} AS spent FROM events)")
def duration_parse(spark, d):
    """Minutes of durations made from events."""
    return table(spark, d, "events").select("event_id", _spent().alias("spent")).withColumn("minutes", text.duration_minutes("spent"))


@register(f"SELECT count(*) AS total_tasks, coalesce(sum(try_cast(trim(split_part({SPENT}, 'h', 1)) AS DOUBLE)), 0) AS total_hours, CAST(coalesce(sum(CASE WHEN event_id % 3 = 0 THEN event_id % 10 END), 0) AS DOUBLE) AS total_estimated_hours FROM events")
def time_report(spark, d):
    """Totals of a time report with events as tasks."""
    tasks = table(spark, d, "events").select(_spent().alias("time_spent"), F.lit("").alias("time_started"), F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 10).alias("estimate"))
    return tracking.time_report(tasks)


@register(f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY floor(CASE WHEN age <= 0 THEN 1 ELSE pow(1 + {scoring.FSRS_FACTOR!r}::DOUBLE * age / 7.0::DOUBLE, -0.1542::DOUBLE) END * 1e9) DESC, event_id) AS k FROM (SELECT event_id, user_id, CAST(event_id % 97 AS BIGINT) AS age FROM events)) SELECT user_id, event_id, age FROM r WHERE k <= 5")
def memory_evict(spark, d):
    """The five freshest memories of every user."""
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", (F.col("event_id") % 97).alias("days"))
    return tracking.evict(rows, 5, "user_id").select("user_id", F.col("id").alias("event_id"), F.col("days").alias("age"))


def _log(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("line_no"), F.concat_ws(" ", "event_type", "props").alias("value"))


LOG = "SELECT event_id AS line_no, event_type || ' ' || props AS value FROM events"


@register(f"SELECT * FROM ({LOG}) ORDER BY line_no DESC LIMIT 20")
def log_recent(spark, d):
    return logs.recent(_log(spark, d))


@register(f"WITH l AS ({LOG}) SELECT * FROM l WHERE line_no > (SELECT min(line_no) FROM l WHERE contains(value, 'signup'))")
def log_since(spark, d):
    return logs.since(_log(spark, d), "signup")


@register(f"SELECT * FROM ({LOG}) WHERE contains(lower(value), 'purchase')")
def log_filter(spark, d):
    return logs.search(_log(spark, d), "PURCHASE")


# ---- history -----------------------------------------------------------------


@register("SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_dups(spark, d):
    return history.content_duplicates(_documents(spark, d))


@register(
    "WITH o AS (SELECT doc_id AS id, sha256(text) AS h FROM documents WHERE source <> 'src1'), n AS (SELECT doc_id AS id, sha256(CASE WHEN lang = 'de' THEN text || '.' ELSE text END) AS h FROM documents WHERE source <> 'src2') "
    "SELECT id, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' WHEN o.h = n.h THEN 'same' ELSE 'changed' END AS change FROM o FULL JOIN n USING (id)"
)
def incremental_diff(spark, d):
    """Changes between two snapshots of the documents."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")
    old = docs.where("source <> 'src1'").select("id", F.sha2("text", 256).alias("hash"))
    new = docs.where("source <> 'src2'").select("id", F.sha2(F.when(F.col("lang") == "de", F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("hash"))
    return history.change_set(old, new)


@register(
    "WITH o AS (SELECT doc_id AS id, sha256(text) AS h FROM documents WHERE source <> 'src1'), n AS (SELECT doc_id AS id, sha256(text) AS h FROM documents), b AS (SELECT h, min(id) AS other FROM o GROUP BY h) "
    "SELECT n.id, coalesce(s.id, b.other) AS vector_of, coalesce(s.id, b.other) IS NULL AS embed FROM n LEFT JOIN o s ON s.id = n.id AND s.h = n.h LEFT JOIN b ON b.h = n.h"
)
def carry_forward(spark, d):
    """Whose vector each document can take over when one source is new."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("hash"), "source")
    old = docs.where("source <> 'src1'").select("id", "hash", F.col("id").alias("v"))
    return vector.carry_forward(docs.select("id", "hash"), old).select("id", F.col("v").alias("vector_of"), "embed")


@register(
    "WITH n AS (SELECT *, CASE WHEN o_orderstatus = 'O' THEN 'F' ELSE o_orderstatus END AS s2, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS p2 FROM orders) "
    "SELECT o_orderkey, 'o_orderstatus' AS field, o_orderstatus AS old_value, s2 AS new_value FROM n WHERE o_orderstatus IS DISTINCT FROM s2 "
    "UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority, p2 FROM n WHERE o_orderpriority IS DISTINCT FROM p2"
)
def field_changes(spark, d):
    """Fields that differ between two versions of the orders."""
    old = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    new = old.select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "F").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), F.when(F.col("o_orderkey") % 7 == 0, None).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))
    return history.field_changes(old, new, "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@register("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 3")
def versions_newest_k(spark, d):
    """The three latest events of every user."""
    return history.newest(table(spark, d, "events"), 3, "user_id", "event_id").select("user_id", "event_id", "event_type")


@register("SELECT user_id, arg_min(event_type, event_id) AS value FROM events WHERE event_id > 5000 GROUP BY user_id")
def version_rollback(spark, d):
    """Values to restore when events are changes and version 5000 is wanted."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("entity_id"), F.col("event_id").alias("version"), F.array(F.struct(F.lit("kind").alias("field"), F.col("event_type").alias("old_value"), F.lit(None).cast("string").alias("new_value"))).alias("changes"))
    return history.rollback(rows, 5000).select(F.col("entity_id").alias("user_id"), "value")


@register("SELECT c_custkey, c_name, CASE WHEN c_acctbal < 0 THEN 'stale' ELSE 'done' END AS state FROM customer")
def source_verify(spark, d):
    """Sources become stale where the file's hash moved."""
    rows = table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_name").alias("stored_path"), F.sha2("c_name", 256).alias("content_hash"), F.lit("done").alias("state"), "c_acctbal")
    files = rows.select(F.col("stored_path").alias("path"), F.sha2(F.when(F.col("c_acctbal") < 0, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name")), 256).alias("content_hash"))
    return history.verify(rows.drop("c_acctbal"), files).select("c_custkey", "c_name", "state")


# ---- texts, code, streams ----------------------------------------------------


@register(r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<h[1-6][^>]*>')) AS headings, len(regexp_extract_all(html, 'href=\"([^\"]*)\"')) AS links FROM pages")
def page_outline(spark, d):
    """Title and counts of headings and links of every page."""
    p = table(spark, d, "pages")
    return p.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<h[1-6][^>]*>")).alias("headings"), F.regexp_count("html", F.lit('href="([^"]*)"')).alias("links"))


@register(r"SELECT p_partkey, 'wiki:' || replace(regexp_replace('parts/' || p_partkey || '.md', '\.md$', ''), '/', ':') AS id, trim(regexp_replace(regexp_replace(lower(p_name), '[^\p{L}\p{N}_-]', '-', 'g'), '-+', '-', 'g'), '-') AS slug, replace(replace(replace(p_type, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM part")
def names(spark, d):
    """Page ids, slugs and escaped types of parts."""
    p = table(spark, d, "part")
    path = F.concat(F.lit("parts/"), F.col("p_partkey").cast("string"), F.lit(".md"))
    return p.select("p_partkey", text.path_to_id(path).alias("id"), text.slugify("p_name").alias("slug"), text.xml_escape("p_type").alias("escaped"))


@register("SELECT 'doc' || doc_id AS path, CAST(line AS INTEGER) AS line, text FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE regexp_matches(text, '[A-Za-z0-9.]+@[A-Za-z0-9.]+')")
def grep(spark, d):
    """Every line with something like an address."""
    files = _documents(spark, d).select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"), F.lit("text").alias("language"))
    return codeintel.grep(files, "[A-Za-z0-9.]+@[A-Za-z0-9.]+", limit=None).select("path", "line", "text")


@register("SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ring') AND p_brand = 'Brand#2'")
def symbol_filter(spark, d):
    """Parts as symbols: by part of the name and by kind."""
    rows = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("kind"), F.lit("f").alias("file"), F.lit("x").alias("language"))
    return codeintel.query_symbols(rows, name="ring", kind="Brand#2").select("p_partkey", F.col("name").alias("p_name"))


@register(
    r"SELECT page_id, name, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<(script|style)\b.*?</(script|style)\s*>', '', 'g'), '<([A-Za-z][A-Za-z0-9_:.-]*)', 1)) AS name FROM pages) GROUP BY page_id, name"
)
def html_elements(spark, d):
    """Symbols of every page's markup: its elements by name."""
    files = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").alias("content"), F.lit("html").alias("language"))
    found = code.symbols(code.findings(spread(files)))
    return found.groupBy(F.col("file").cast("long").alias("page_id"), "name").agg(F.count(F.lit(1)).alias("n"))


@register(
    f"""WITH best AS ({BM25_SQL.format(fields=BODY, tokens=CODE_TOKENS.format("text"), qtokens=CODE_TOKENS.format("text"))}),
g AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(' ' || d.text || ' ', ' ' || b.text || ' ')),
h AS (SELECT g.item_id, count(*) AS n, count(*) FILTER (best.rank < 5) AS k5, count(*) FILTER (best.rank < 1) AS k1, min(best.rank) AS first FROM g LEFT JOIN best ON best.query_id = g.item_id AND best.doc_id = g.doc_id GROUP BY g.item_id)
SELECT floor(avg(CAST(k5 AS DOUBLE) / n) * 1e6 + 0.5) / 1e6 AS recall_at_k, floor(avg(CAST(k1 AS DOUBLE) / n) * 1e6 + 0.5) / 1e6 AS recall_at_1, floor(avg(coalesce(1.0::DOUBLE / (first + 1), 0)) * 1e6 + 0.5) / 1e6 AS mrr FROM h"""
)
def golden_metrics(spark, d):
    """Retrieval quality over all documents: expected are those that hold a benchmark text's words in a row."""
    items = stored(table(spark, d, "benchmark").where("text is not null").select(F.col("item_id").alias("query"), F.split("text", " ").alias("words")).withColumn("k", F.least(F.size("words"), F.lit(8))), "items")
    sizes = [r["k"] for r in items.select("k").distinct().collect()]  # at most eight
    head = lambda w, at, k: F.xxhash64(F.array_join(F.slice(w, at, k), " "))
    heads = items.select("query", "k", head(F.col("words"), F.lit(1), F.col("k")).alias("head"))
    docs = _documents(spark, d).where("text is not null").select("doc_id", F.split("text", " ").alias("w"))
    runs = lambda k: F.when(F.size("w") >= k, F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (k - 1), F.lit(1))), lambda i: F.struct(F.lit(k).alias("k"), i.alias("at"), head(F.col("w"), i, F.lit(k)).alias("head"))))
    said = docs.select("doc_id", F.explode(F.flatten(F.array_compact(F.array(*[runs(k) for k in sizes])))).alias("r")).select("doc_id", "r.*") if sizes else docs.select("doc_id", F.lit(0).alias("k"), F.lit(1).alias("at"), F.lit(0).cast("long").alias("head")).limit(0)
    # the heads are sought by their hashes, then whole texts are compared
    near = stored(said.join(lexical.broadcast_few(heads), ["k", "head"]).select("doc_id", "query", "at").distinct(), "heads")
    whole = near.join(items.select("query", "words"), "query").join(docs, "doc_id").where(F.slice("w", F.col("at"), F.size("words")) == F.col("words"))
    held = whole.select("query", "doc_id").distinct()
    golden = held.groupBy("query").agg(F.collect_set("doc_id").alias("expected"))
    results = bm25_topk(spark, d).select(F.col("query_id").alias("query"), F.col("doc_id").alias("id"), "rank")
    found = rules.recall_metrics(results, golden)
    return found.select(*[six(c).alias(c) for c in found.columns])


@register(
    "WITH s AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), "
    "b AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS changes FROM b GROUP BY user_id, k"
)
def stream_debounce(spark, d):
    """Bursts of each user's events with gaps below half an hour, by a streaming job over the events file.

    The job runs to the end of its input in complete mode, as the last bursts
    would else wait for a later event to close them.
    """
    stream, kind = _event_stream(spark, d)
    bursts = feeds.debounced(stream.select("user_id", "ts"), "user_id", "ts", "30 minutes")
    out = _ran(spark, bursts, "complete")
    last = spark.read.parquet(out).where(F.col("epoch") == spark.read.parquet(out).agg(F.max("epoch")).first()[0])
    return last.select("user_id", F.col("first").cast(kind).alias("first"), F.col("last").cast(kind).alias("last"), "changes")


def _event_stream(spark, d):
    """The events file as a stream, with the type of its times; the schema is the file's, so that the stream doesn't infer one."""
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(d), schema["ts"].dataType


def _ran(spark, result: DataFrame, mode: str) -> str:
    """Run a streaming job to the end of its input; the folder has a batch's rows under its epoch."""
    out = scratch(spark, "stream-out")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    result.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", scratch(spark, "stream-state")).trigger(availableNow=True).start().awaitTermination()
    return out


@register("SELECT event_type, count(*) AS n, floor(sum(value) * 100 + 0.5) / 100 AS total FROM events GROUP BY event_type")
def stream_counts(spark, d):
    """Hourly counts by a streaming job over the events file, then summed."""
    stream, _ = _event_stream(spark, d)
    # update mode: a batch holds the windows that it changed, closed ones leave the state; the newest row of each counts
    out = _ran(spark, feeds.windowed_counts(stream), "update")
    rows = spark.read.parquet(out).groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "epoch").alias("r")).select("event_type", "r.*")
    return checkpointed(rows.groupBy("event_type").agg(F.sum("n").alias("n"), (F.floor(F.sum("total") * 100 + 0.5) / 100).alias("total")))
