"""Mixing and URL filters against plain versions, with nulls, ties, repeats and clashing columns."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lorespark.llm import mixing, url_filters

DOCS = "doc_id long, text string, source string, lang string, size string, copy int"


def plain_targets(sizes: dict, max_rate: float = 3.0) -> dict:
    """Targets by resharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, fixed, free = sum(sizes.values()), {}, dict(sizes)
    while free:
        left, w = total - sum(fixed.values()), sum(weight[s] for s in free)
        over = {s: max_rate * n for s, n in free.items() if left * weight[s] / w > max_rate * n}
        if not over:
            return fixed | {s: left * weight[s] / w for s in free}
        fixed |= over
        free = {s: n for s, n in free.items() if s not in over}
    return fixed


def test_mix_matches_plain_version(spark):
    rows = [(i, " ".join(["w"] * (i % 7)), f"s{i % 4}", "en", "x", 9) for i in range(200)]
    rows += [(1000, None, None, None, None, None), (1001, "a b\tc\u00a0d", None, "en", None, 1), (None, "only text", "s1", "en", None, 1), (None, "only text", "s1", "en", None, 1), (5, "", "tiny", "en", None, 1), (6, "one", "tiny", "en", None, 1)]
    plan = mixing.repetition_plan(spark.createDataFrame(rows, DOCS)).collect()
    assert len(plan) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    totals: dict = {}
    for r in rows:
        totals[r[2]] = totals.get(r[2], 0) + size(r[1])
    want = plain_targets(totals)
    assert sum(want.values()) == pytest.approx(sum(totals.values()))
    for r in plan:
        assert r["size"] == size(r["text"]) and r["source_size"] == totals[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        rate = want[r["source"]] / totals[r["source"]] if totals[r["source"]] else 0
        key = str(r["doc_id"]) if r["doc_id"] is not None else hashlib.md5((r["text"] or "").encode()).hexdigest()
        draw = int(hashlib.md5(f"mix-1:{key}".encode()).hexdigest()[:13], 16) / 2**52
        assert r["copies"] == int(rate) + (draw < rate - int(rate)) and r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
    mixed = mixing.mix(spark.createDataFrame(rows, DOCS))
    assert mixed.columns == ["doc_id", "text", "source", "lang", "copy"]
    assert mixed.count() == sum(r["copies"] for r in plan)


def test_mix_of_nothing_and_of_wordless_texts(spark):
    assert mixing.repetition_plan(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(1, None, "a", None, None, None), (2, " \n", "b", None, None, None)]
    assert {(r["size"], r["target"], r["taken"]) for r in mixing.repetition_plan(spark.createDataFrame(rows, DOCS)).collect()} == {(0, 0.0, 0)}


def test_taken_words_come_near_their_targets(spark):
    rows = spark.range(60_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 9 + 1).cast("int")).alias("text"), F.concat(F.lit("s"), (F.pmod(F.col("id") * F.col("id"), F.lit(11))).cast("string")).alias("source"))
    for r in mixing.repetition_plan(rows).groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("n")).collect():
        assert r["n"] == pytest.approx(r["t"], rel=0.05)


def plain_verdict(url, rules, default="allow"):
    m = re.search(r"(?s)://([^/?#]*)([^?#]*)", url or "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]) if m else ""
    path = m[2] if m else ""
    fits = [(h, p, v) for h, p, v in rules if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
    best = min(fits, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r[0] + r[1], r[2]), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else default


URLS = [
    "http://a.example.com/en/7?x=1", "https://EXAMPLE.com/en/75#f", "http://com/en/", "http://com/en", "http://xcom/en/1", "ftp://b.net/de/", "http://example.net/de/8/9",
    "http://x.example.net/de/9", "http://org/es/1", "http://a.org?q=/es/", None, "", "no scheme", "http://", "http://é.com/en/ü", "http://user@h.com:80/en/", "x://y://com/en/", "http://a.com//en/",
    "http://A.b\n.com/en/\nx", "http://example.com/en/7://",
]


@pytest.mark.parametrize("limit", [500, 0])
def test_verdicts_match_plain_version(spark, limit):
    rules = [*url_filters.RULES, ("", "/admin", "block"), ("b.net", "", "block"), ("a+b.org", "/x.y(z", "block"), ("com", "/en/", "block"), ("com", "/en/", "allow"), ("", "", "allow")]
    urls = [*URLS, "http://a+b.org/x.y(zz", "http://q/admin7", "http://x.b.net", "http://x.b.net/q"] + ["http://com/en/1"] * 5
    pages = spark.createDataFrame([(i if i % 5 else None, u, "old", i) for i, u in enumerate(urls)], "page_id long, url string, host string, n int")
    got = url_filters.filter_urls(pages, url_filters.rules_frame(spark, rules), local_rules=limit).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain_verdict(r["url"], rules), r


@pytest.mark.parametrize("limit", [500, 0])
def test_no_rules_and_no_pages(spark, limit):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    got = url_filters.filter_urls(pages, none, local_rules=limit).collect()
    assert [(r["rule"], r["verdict"]) for r in got] == [(None, "allow")]
    assert url_filters.filter_urls(pages.limit(0), url_filters.rules_frame(spark, url_filters.RULES), local_rules=limit).count() == 0


def test_native_plans_have_no_python(spark, sf):
    for q in (mixing.query, url_filters.query):
        plan = q(spark, sf)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan
