"""Text functions on examples whose results are known."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorespark.functions import scoring, text
from lorespark.operators import lexical
from lorespark.sources.store import spread


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first()["x"]


#: Published pairs of the Snowball English vocabulary.
STEMS = {
    "consign": "consign", "consigned": "consign", "consigning": "consign", "consignment": "consign", "consist": "consist", "consistency": "consist",
    "consolation": "consol", "consolatory": "consolatori", "knack": "knack", "knavish": "knavish", "kneaded": "knead", "kneel": "kneel", "knightly": "knight",
    "running": "run", "hopping": "hop", "hoping": "hope", "dying": "die", "skies": "sky", "generously": "generous", "communism": "communism", "relational": "relat",
    "ties": "tie", "cries": "cri", "by": "by", "say": "say", "gas": "gas", "this": "this", "kiwis": "kiwi", "succeed": "succeed", "agreed": "agre", "luxuriated": "luxuri",
}


def test_stems():
    assert {w: text.stem_word(w) for w in STEMS} == STEMS


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abcdeilnorstuyvz'", max_size=12))
def test_stems_never_grow_much_and_repeat(word):
    assert len(text.stem_word(word)) <= len(word) + 1 and text.stem_word(word) == text.stem_word(word)


def test_code_tokens(spark):
    sample = "Graph_store-v2 a B2 don't RE-use __x é"
    want = []
    for t in re.findall(r"[a-z0-9_\-]+", sample.lower()):
        want += ([t] if re.search("[_-]", t) else []) + [p for p in re.split("[_-]", t) if len(p) > 1]
    assert one(spark, text.code_tokens("t"), sample) == want
    assert one(spark, text.code_tokens("t"), None) == [] and one(spark, text.code_tokens("t"), "") == []
    assert text.tokenize("graph_stores x") == ["graph_stores", "graph", "stores", "store"]


@pytest.mark.parametrize(
    ("make", "value", "want"),
    [
        (text.path_to_id, "concepts/a.md", "wiki:concepts:a"),
        (text.id_to_path, "wiki:concepts:a", "concepts/a.md"),
        (text.base_id, "wiki:a#part", "wiki:a"),
        (text.slugify, "  Hello, Wörld_1! ", "hello-wörld_1"),
        (text.xml_escape, "<a b=\"c\">'&", "&lt;a b=&quot;c&quot;&gt;&apos;&amp;"),
        (text.template_variables, "{{ b }} {{a}} {{ b }} {{}}", ["a", "b"]),
        (text.wikilinks, "[[ A ]] [[b|label]] [[A]] [[ ]] [[x 1]]", ["A", "b", "x 1"]),
        (text.inline_tags, "x #one #a\n## no #two\n```\n#three\n```\n#four_5", ["one", "four_5"]),
        (text.references, "see @wiki/concept/a-b. and\n```\n@wiki/x/y\n```\nme@wiki/no/no", ["concept/a-b"]),
        (text.duration_minutes, "1h 30m", 90.0),
        (text.duration_minutes, "junk", 0.0),
        (text.duration_hours, "2h 15m", 2.0),
        (scoring.auto_mode, "my_func", "keyword"),
        (scoring.auto_mode, "plain words", "hybrid"),
    ],
)
def test_scalar_functions(spark, make, value, want):
    assert one(spark, make("t"), value) == want


def test_decay_models(spark):
    days = spark.createDataFrame([(0.0,), (7.0,), (700.0,), (-3.0,)], "d double")
    rows = days.select(*[scoring.recency("d", m).alias(m) for m in ("fsrs", "linear", "exponential", "none")]).collect()
    assert [r["none"] for r in rows] == [1.0] * 4 and rows[0] == rows[3]
    assert rows[1]["fsrs"] == pytest.approx(0.9) and rows[1]["linear"] == 0 and rows[1]["exponential"] == pytest.approx(0.36787944)
    assert 0 < rows[2]["fsrs"] < rows[1]["fsrs"]


def test_normalised_scores(spark):
    rows = spark.createDataFrame([(4.0, 4.0), (0.001, 4.0), (1.23456, 2.0), (1.0, 0.0)], "s double, m double")
    assert [r[0] for r in rows.select(scoring.normalised("s", "m")).collect()] == [1.0, 0.01, 0.6173, 0.0]


def test_unit_vectors(spark):
    v = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert [list(r[0]) for r in v.select(scoring.unit("v")).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    assert v.select(scoring.cosine(F.array(F.lit(1.0), F.lit(-1.0)), "v")).first()[0] == 0.0


def test_small_inputs_are_dealt_over_the_cores(spark, tmp_path):
    path = f"file://{tmp_path}/one"
    spark.range(100).coalesce(1).write.parquet(path)
    read, cores = spark.read.parquet(path), spark.sparkContext.defaultParallelism
    assert spread(read).rdd.getNumPartitions() >= cores
    assert sorted(r["id"] for r in spread(read).collect()) == list(range(100))
    many = spark.range(0, 100, 1, cores + 1)
    assert spread(many) is many


def test_index_counts_fields_without_terms(spark):
    rows = [(1, "body", "Ab a_b x ab", 1.0), (2, "body", None, 1.0), (3, "body", "", 1.0), (4, "body", "q", 1.0), (1, "header", "ab", 4.0)]
    fields = spark.createDataFrame(rows, "doc_id long, field string, text string, weight double")
    index = lexical.build_index(fields)
    assert index.total.first()["n"] == 4
    assert {tuple(r) for r in index.lengths.select("field", "total", "docs").collect()} == {("body", 3, 1), ("header", 1, 1)}
    assert {tuple(r) for r in index.frequencies.select("term", "df").collect()} == {("ab", 1), ("a_b", 1)}
    assert {tuple(r) for r in index.postings.select("doc_id", "field", "term", "tf", "length").collect()} == {(1, "body", "ab", 2, 3), (1, "body", "a_b", 1, 3), (1, "header", "ab", 1, 1)}
