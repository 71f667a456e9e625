"""Field-weighted BM25 over an inverted index held in DataFrames.

``fields`` everywhere is one row a (document, field): ``doc_id, field, text,
weight``.  The index keeps postings (one row a document, field and term),
document frequencies over the union of all fields (weight 0 included), and
length statistics a field.  A query reads only the postings of its own terms,
so its cost follows those terms' frequencies, not the corpus; write the
postings bucketed or sorted by ``term`` for pruning at scale.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scoring, text
from ..sources.store import stored

#: A set of queries above so many terms is joined by shuffle instead of broadcast.
BROADCAST_TERMS = 100_000


@dataclass
class Index:
    """``postings(doc_id, field, weight, length, term, tf)``, ``frequencies(term, df)``, ``lengths(field, total, docs)``, ``total(n)``."""

    postings: DataFrame
    frequencies: DataFrame
    lengths: DataFrame
    total: DataFrame
    stems: bool = False

    def persist(self, path: str) -> Index:
        """The index as Parquet tables, postings range-sorted by term for min/max pruning."""
        spark = self.postings.sparkSession
        parts = {"postings": self.postings.repartitionByRange("term").sortWithinPartitions("term"), "frequencies": self.frequencies, "lengths": self.lengths, "total": self.total}
        for name, df in parts.items():
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        return Index(*(spark.read.parquet(f"{path}/{name}") for name in parts), stems=self.stems)


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def term_counts(tokens: Column) -> Column:
    """``(term, tf)`` structs of an array of tokens, by runs of equal ones in sorted order."""

    def runs(s: Column) -> Column:
        places = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>"))
        first = F.filter(places, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return _let(first, lambda f: F.transform(f, lambda at, i: F.struct(F.get(s, at).alias("term"), (F.coalesce(F.get(f, i + 1), F.size(s)) - at).cast("long").alias("tf"))))

    return _let(F.sort_array(tokens), runs)


TERMS = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())]))
COUNTED = T.StructType([T.StructField("length", T.IntegerType()), T.StructField("terms", TERMS)])


def _arrow_counts(counts: list[dict[str, int]], lengths: list[int]) -> pa.StructArray:
    at = pa.array(np.cumsum([0, *map(len, counts)]), pa.int32())
    terms = pa.array([t for c in counts for t in c], pa.string())
    tf = pa.array([n for c in counts for n in c.values()], pa.int64())
    lists = pa.ListArray.from_arrays(at, pa.StructArray.from_arrays([terms, tf], ["term", "tf"]))
    return pa.StructArray.from_arrays([pa.array(lengths, pa.int32()), lists], ["length", "terms"])


def code_counter(stems: bool):
    """``counter`` of ``text.code_tokens``, from lower-cased texts."""

    @F.arrow_udf(COUNTED)
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        stem = text.remembered_stems() if stems else None
        find = re.compile(text.TOKEN).findall
        for texts in batches:
            counts = []
            for value in texts:
                raw, found = Counter(find(value.as_py() or "")), Counter()
                for token, n in raw.items():
                    if "_" in token or "-" in token:
                        found[token] += n
                        parts = token.replace("-", "_").split("_")
                    else:
                        parts = (token,)
                    for p in parts:
                        if len(p) > 1:
                            found[p] += n
                            if stem is not None and (s := stem(p)) != p:
                                found[s] += n
                counts.append(found)
            yield _arrow_counts(counts, [c.total() for c in counts])

    return count


def _counted(fields: DataFrame, tokens: Column | None, only: DataFrame | None = None, stems: bool = False) -> DataFrame:
    """``(doc_id, field, weight, length, term, tf)``; the empty term stands for the field itself, so that its length is kept.

    A field's terms and stems are counted inside its row, so neither texts nor
    terms are shuffled here; stems lengthen their field.
    """
    if tokens is not None:
        if stems:
            raise ValueError("stems are of code-aware tokens")
        tokens = F.coalesce(tokens, F.array().cast("array<string>"))
    counts = code_counter(stems)(F.lower("text")) if tokens is None else F.struct(F.size(tokens).alias("length"), term_counts(tokens).alias("terms"))
    rows = fields.select("doc_id", "field", F.col("weight").cast("double").alias("weight"), counts.alias("c"))
    own = F.array(F.struct(F.lit("").alias("term"), F.lit(1).cast("long").alias("tf")))
    counted = rows.select("doc_id", "field", "weight", "c.length", F.explode(F.concat(own, F.col("c.terms"))).alias("t"))
    said = counted.select("doc_id", "field", "weight", "length", "t.term", "t.tf")
    if only is not None:
        wanted = fields.sparkSession.createDataFrame([("",)], "term string")
        said = said.join(broadcast_few(only.select("term").union(wanted).distinct()), "term", "left_semi").select("doc_id", "field", "weight", "length", "term", "tf")
    return said


def term_frequencies(fields: DataFrame, tokens: Column | None = None, stems: bool = False) -> DataFrame:
    """Postings of every field; with stems, a part's stem counts beside it where it differs."""
    return _counted(fields, tokens, stems=stems).where("term <> ''")


def build_index(fields: DataFrame, tokens: Column | None = None, stems: bool = False, only: DataFrame | None = None) -> Index:
    """The index of ``fields``; with ``only(term)`` the part that queries of these terms need, without storing other terms.

    Texts are split once; the counts are stored, as everything else is read from them.
    """
    counted = stored(_counted(fields, tokens, only, stems), "postings")
    own, postings = counted.where("term = ''"), counted.where("term <> ''")
    per = own.where("length > 0").select("field", "length", "tf")
    # of documents with one field no term is met twice, so they need no shuffle of (term, document)
    several = stored(own.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "several-fields")
    said = postings.select("term", "doc_id")
    if few(several):
        same = F.col("doc_id").eqNullSafe(F.col("_several"))
        more = F.broadcast(several.withColumnRenamed("doc_id", "_several"))
        said = said.join(more, same, "left_anti").select("term").unionByName(said.join(more, same, "left_semi").distinct().select("term"))
    else:
        said = said.distinct()
    frequencies = said.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    lengths = per.groupBy("field").agg(F.sum(F.col("length") * F.col("tf")).alias("total"), F.sum("tf").cast("long").alias("docs"))
    return Index(postings, frequencies, lengths, own.agg(F.count_distinct("doc_id").alias("n")), stems)


def query_terms(queries: DataFrame, tokens: Column | None = None) -> DataFrame:
    """``(query_id, term, times)`` of ``queries(query_id, text)``; repeats count."""
    tokens = text.code_tokens("text") if tokens is None else tokens
    return queries.select("query_id", F.explode(tokens).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))


def few(df: DataFrame) -> bool:
    return df.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS


def broadcast_few(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast where its counted rows are few, else as it is."""
    return F.broadcast(df) if few(df) else df


def bm25(index: Index, terms: DataFrame) -> DataFrame:
    """``(query_id, doc_id, score)`` for every document that shares a term with a query.

    Scores are rounded to 9 places, so that the order in which parts are summed
    never decides between equal documents.
    """
    small = few(terms)
    n = index.total.scalar()
    weighed = (F.broadcast(terms) if small else terms).join(index.frequencies, "term").select("query_id", "term", (F.col("times") * scoring.idf(n, "df")).alias("idf"))
    means = index.lengths.select("field", F.greatest(F.col("total") / F.col("docs"), F.lit(1.0)).alias("mean"))
    said = index.postings.where("weight <> 0").join(F.broadcast(means), "field").select("doc_id", "term", (F.col("weight") * scoring.tf_part("tf", "length", "mean")).alias("part"))
    hits = said.join(F.broadcast(weighed) if small else weighed, "term")
    return hits.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("idf") * F.col("part")), 9).alias("score"))


def top_k(scores: DataFrame, k: int, by: str = "query_id", score: str = "score", tie: str = "doc_id") -> DataFrame:
    """The best ``k`` rows a group with ``rank`` from 0; ties by id."""
    w = Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(tie).asc())
    return scores.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)


def boost(query: str, title: Column | str, doc_id: Column | str, tags: Column | str, title_stem: Column | None = None) -> Column:
    """Keyword-mode boosts: title 8 / 4 / 2, id 7, tags 3 once; ``title_stem`` has the stems of lower-cased titles, should they be at hand."""
    q, terms = query.lower(), text.tokenize(query)
    title, doc_id, tags = (F.lower(F.col(c) if isinstance(c, str) else c) for c in (title, doc_id, tags))
    literal = F.lit(q)
    # whole strings are compared by their stems, too
    exact = (title == literal) | ((text.stem(title) if title_stem is None else title_stem) == F.lit(text.stem_word(q)))
    on_title = F.when(exact, 8.0).when(F.startswith(title, literal) | F.startswith(literal, title), 4.0).when(F.contains(title, literal), 2.0).otherwise(0.0)
    on_tags = F.when(F.exists(F.array(*[F.lit(t) for t in terms] or [F.lit("\0")]), lambda t: F.contains(tags, t)), 3.0).otherwise(0.0)
    return F.coalesce(on_title, F.lit(0.0)) + F.when(doc_id == literal, 7.0).otherwise(0.0) + F.coalesce(on_tags, F.lit(0.0))


def keyword_search(index: Index, docs: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """BM25 plus boosts, normalised over all hits before the limit; ``docs(doc_id, title, tags)``."""
    spark = docs.sparkSession
    terms = text.tokenize(query)
    if not terms:
        return docs.select("doc_id", F.lit(0.0).alias("score"), F.lit("").alias("snippet")).limit(0)
    counts = {t: terms.count(t) for t in dict.fromkeys(terms)}
    q = spark.createDataFrame([(0, t, n) for t, n in counts.items()], "query_id int, term string, times int")
    scores = bm25(index, q).select("doc_id", "score")
    boosted = docs.join(scores, "doc_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)) + boost(query, "title", "doc_id", "tags", F.col("title_stem") if "title_stem" in docs.columns else None)).where("score > 0")
    top = boosted.agg(F.max("score").alias("m"))
    out = boosted.crossJoin(F.broadcast(top))  # one row
    best = out.orderBy(F.desc("score"), "doc_id").limit(limit)
    return best.select("doc_id", scoring.normalised("score", "m").alias("score"), text.truncate(F.coalesce("title", F.lit("")), 120).alias("snippet"))


def _equals(word: str):
    return lambda t: t == F.lit(word)


def rerank_client(docs: DataFrame, query: str) -> DataFrame:
    """White-space BM25 over title and body of given results, +0.15 for a title that contains the query; all rows stay."""
    both = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("body", F.lit("")))
    tokens = F.filter(F.split(both, r"\s+"), lambda t: t != "")
    words = [t for t in query.split() if t]
    rows = docs.withColumn("_tokens", tokens).withColumn("_len", F.size("_tokens"))
    for i, w in enumerate(words):
        rows = rows.withColumn(f"_tf{i}", F.size(F.filter("_tokens", _equals(w))))
    stats = rows.agg(F.count(F.lit(1)).alias("_n"), F.greatest(F.avg("_len"), F.lit(1.0)).alias("_mean"), *[F.sum((F.col(f"_tf{i}") > 0).cast("long")).alias(f"_df{i}") for i in range(len(words))])
    rows = rows.crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(words)):
        score = score + F.when(F.col(f"_tf{i}") > 0, scoring.idf("_n", f"_df{i}") * scoring.tf_part(f"_tf{i}", "_len", "_mean")).otherwise(0.0)
    score = score + F.when(F.contains(F.lower("title"), F.lit(query.lower())), 0.15).otherwise(0.0)
    return rows.select(*docs.columns, score.alias("score")).orderBy(F.desc("score"), "id")


def merge_statistics(old: Index, removed: DataFrame, added: DataFrame) -> Index:
    """The index after documents went (their fields rows) and came: statistics move by deltas.

    A changed document is in both frames.
    """
    minus, plus = build_index(removed, stems=old.stems), build_index(added, stems=old.stems)
    postings = old.postings.join(removed.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(plus.postings)
    signed = lambda a, b, keys, values: a.unionByName(b.select(*keys, *[(-F.col(v)).alias(v) for v in values]))
    freq = signed(old.frequencies.unionByName(plus.frequencies), minus.frequencies, ["term"], ["df"]).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    lens = signed(old.lengths.unionByName(plus.lengths), minus.lengths, ["field"], ["total", "docs"]).groupBy("field").agg(F.sum("total").alias("total"), F.sum("docs").alias("docs")).where("docs > 0")
    n = signed(old.total.unionByName(plus.total), minus.total, [], ["n"]).agg(F.sum("n").alias("n"))
    return Index(postings, freq, lens, n, old.stems)
