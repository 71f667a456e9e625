"""URL filters: pattern rules indexed by their rarest literal token.  [native]

A rule is ``(host, path, verdict)``.  It fits a URL whose host is the rule's
host or a subdomain of it and whose path starts with the rule's path; an empty
rule host fits every host.  Among the fitting rules the longest pattern
(host and path together) wins, then the longer host, then the pattern that is
smaller in code-point order, then ``allow`` before ``block``.

How it scales: every rule is filed under one literal token, the one that the
URLs at hand contain least often.  A URL looks its own tokens up in that index
and runs regular expressions only for the rules it fetched, so the work of a
URL follows its tokens and not the number of rules.  Up to ``LOCAL_RULES``
rules the index is a literal map in the projection (no shuffle of pages at
all); beyond it distinct URLs are exploded to tokens and joined with the
index, and verdicts return by a join on the URL.

Defined results: a null URL or one without ``://`` has an empty host and path,
so only rules with neither can fit it; repeated rows are judged alike; an empty
rule table gives every URL the default verdict; extra columns are carried
through, unless ``host, path, rule, verdict`` clash, which the result replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import broadcast_if_small, checkpointed, table

LOCAL_RULES = 500
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of the registered query.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def url_host(url: Column) -> Column:
    host = F.regexp_extract(url, "://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(host: Column, path: Column) -> Column:
    """Host labels and path words, told apart by a prefix."""
    labels = F.transform(F.split(host, r"\."), lambda t: F.concat(F.lit("h:"), t))
    words = F.transform(F.split(path, "[^0-9A-Za-z]+"), lambda t: F.concat(F.lit("p:"), t))
    return F.filter(F.array_distinct(F.concat(labels, words)), lambda t: F.length(t) > 2)


def _rule_tokens(host: Column, path: Column) -> Column:
    """As ``_tokens``, without a last path word that a URL might continue."""
    return _tokens(host, F.regexp_replace(path, "[0-9A-Za-z]+$", ""))


def compile_rules(rules: DataFrame) -> DataFrame:
    """Distinct rules with pattern, regular expression and literal tokens."""
    host = F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER)
    path = F.coalesce("path", F.lit(""))
    quoted = lambda c: F.regexp_replace(c, r"([^0-9A-Za-z/_])", r"\\$1")
    on_host = F.when(host == "", F.lit("(?s)^[^/]*")).otherwise(F.concat(F.lit(r"(?s)^(?:[^/]*\.)?"), quoted(host)))
    end = F.when(F.substring(path, 1, 1) == "/", F.lit("")).otherwise(F.when(path == "", F.lit("(?=/|$)")).otherwise(F.lit("(?!)")))
    return rules.select(
        host.alias("host"), path.alias("path"), F.col("verdict"),
        F.concat(host, path).alias("rule"),
        F.concat(on_host, end, quoted(path)).alias("regex"),
        _rule_tokens(host, path).alias("tokens"),
    ).distinct()


def index_rules(compiled: DataFrame, urls: DataFrame) -> DataFrame:
    """File every rule under its token that is rarest in ``urls(host, path)``.

    Only tokens that occur in rules are counted, so the counts stay as small as
    the rule table; a rule without a literal token is filed under ``*``.
    """
    wanted = compiled.select(F.explode("tokens").alias("token")).distinct()
    seen = (
        urls.select(F.explode(_tokens(F.col("host"), F.col("path"))).alias("token"))
        .join(broadcast_if_small(wanted), "token", "left_semi")
        .groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    )
    rarest = (
        compiled.select("rule", "host", F.explode("tokens").alias("token"))
        .join(seen, "token", "left")
        .groupBy("rule", "host").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("m"))
    )
    return (
        compiled.join(rarest.select("rule", "host", F.col("m.token").alias("token")), ["rule", "host"], "left")
        .select(F.coalesce("token", F.lit("*")).alias("token"), "rule", "regex", "verdict", F.length("rule").alias("len"), F.length("host").alias("host_len"))
    )


def _best(found: Column) -> Column:
    """The winner of an array of rule structs, null if there is none."""
    order = lambda r: F.struct(-r["len"], -r["host_len"], r["rule"], r["verdict"])
    ranked = F.transform(found, lambda r: F.struct(order(r).alias("o"), r["rule"].alias("rule"), r["verdict"].alias("verdict")))
    return F.array_min(ranked)


def _judge_locally(urls: DataFrame, index: DataFrame) -> DataFrame:
    """Few rules: a literal map from token to rules inside one projection."""
    by_token: dict[str, list] = {}
    for r in index.collect():  # bounded by LOCAL_RULES
        by_token.setdefault(r["token"], []).append(r)
    as_struct = lambda r: F.struct(F.lit(r["rule"]).alias("rule"), F.lit(r["regex"]).alias("regex"), F.lit(r["verdict"]).alias("verdict"), F.lit(r["len"]).alias("len"), F.lit(r["host_len"]).alias("host_len"))
    pairs = [x for t in sorted(by_token) for x in (F.lit(t), F.array(*[as_struct(r) for r in by_token[t]]))]
    if not pairs:
        return urls.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string")})
    rule_map = F.create_map(*pairs)
    keys = F.array(*[F.lit(t) for t in sorted(by_token)])
    asked = F.array_intersect(F.array_append(_tokens(F.col("host"), F.col("path")), F.lit("*")), keys)
    fetched = F.flatten(F.transform(asked, lambda t: F.element_at(rule_map, t)))
    target = F.concat("host", "path")
    best = _best(F.filter(fetched, lambda r: F.rlike(target, r["regex"])))
    return urls.withColumn("_best", best).withColumns({"rule": F.col("_best.rule"), "verdict": F.col("_best.verdict")}).drop("_best")


def _judge_by_join(urls: DataFrame, index: DataFrame) -> DataFrame:
    """Many rules: distinct (host, path) meet the index by an equi-join on tokens."""
    distinct = urls.select("host", "path").distinct()
    asked = distinct.select("host", "path", F.explode(F.array_append(_tokens(F.col("host"), F.col("path")), F.lit("*"))).alias("token"))
    fits = asked.join(index, "token").where(F.rlike(F.concat("host", "path"), F.col("regex")))
    best = fits.groupBy("host", "path").agg(F.min(F.struct((-F.col("len")).alias("l"), (-F.col("host_len")).alias("h"), "rule", "verdict")).alias("m"))
    return urls.join(best.select("host", "path", "m.rule", "m.verdict"), ["host", "path"], "left")


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", local_rules: int = LOCAL_RULES) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict``; see the module's text."""
    kept = [c for c in pages.columns if c.lower() not in {"host", "path", "rule", "verdict"}]
    link = F.col(f"`{url}`")
    urls = pages.select(*[F.col(f"`{c}`") for c in kept], url_host(link).alias("host"), url_path(link).alias("path"))
    compiled = checkpointed(compile_rules(rules))
    index = checkpointed(index_rules(compiled, urls))
    few = index.limit(local_rules + 1).count() <= local_rules
    judged = (_judge_locally if few else _judge_by_join)(urls, index)
    return judged.select(*[F.col(f"`{c}`") for c in kept], "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict under ``RULES``."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, rules_frame(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


SQL = """
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), j AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/'
  END AS rule FROM u
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' ELSE 'allow' END AS verdict
FROM j
"""
