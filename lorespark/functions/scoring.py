"""Ranking formulas as column expressions, and the enumerations they weigh."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
RRF_K = 60
FSRS_DECAY = -0.1542
FSRS_FACTOR = 0.9 ** (1 / FSRS_DECAY) - 1
DEFAULT_STABILITY = 7.0

# fixed values: enumerations with their weights, as the data model defines them
PAGE_TYPE_RANK = {"core": 9, "rule": 8, "task": 7, "spec": 6, "pattern": 5, "concept": 4, "decision": 3, "memory": 2, "howto": 2, "reference": 1, "note": 0}
EDGE_PRIORITY = {
    "extends": 10, "calls": 9, "inherits": 9, "implements": 9, "part_of": 8, "supersedes": 8, "imports": 7, "example_of": 6, "depends_on": 5, "answers": 5,
    "references": 1, "relates_to": 0, "custom": 0,
}
PROVENANCE_FACTOR = {"explicit": 1.0, "derived": 0.5, "ambiguous": 0.25}
STATUSES = ["draft", "todo", "in-progress", "in-review", "blocked", "done", "reviewed", "approved", "accepted", "rejected", "superseded", "cancelled", "archived", "active", "stale"]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(c: Column | str, table: dict, default) -> Column:
    """A small literal map as an expression."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), _col(c)), F.lit(default))


def page_type_rank(c: Column | str) -> Column:
    return lookup(c, PAGE_TYPE_RANK, 0)


def edge_priority(c: Column | str) -> Column:
    return lookup(c, EDGE_PRIORITY, 0)


def provenance_factor(c: Column | str) -> Column:
    return lookup(c, PROVENANCE_FACTOR, 1.0)


def idf(n: Column | str, df: Column | str) -> Column:
    """``ln(1 + (N - df + 0.5) / (df + 0.5))``, never negative (Q1)."""
    return F.log(1 + (_col(n) - _col(df) + 0.5) / (_col(df) + 0.5))


def tf_part(tf: Column | str, length: Column | str, mean: Column | str, k1: float = K1, b: float = B) -> Column:
    t = _col(tf)
    return t * (k1 + 1) / (t + k1 * (1 - b + b * _col(length) / _col(mean)))


def recency(days: Column | str, model: str = "fsrs", stability: float = DEFAULT_STABILITY) -> Column:
    """Decay of a score after ``days`` (1 at or before day 0, or without stability)."""
    d = _col(days).cast("double")
    if stability <= 0 or model == "none":
        return F.lit(1.0)
    if model == "linear":
        out = F.greatest(1 - d / stability, F.lit(0.0))
    elif model == "exponential":
        out = F.exp(-d / stability)
    else:
        out = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.pow(1 + FSRS_FACTOR * d / stability, F.lit(FSRS_DECAY))))
    return F.when(d <= 0, F.lit(1.0)).otherwise(out)


def version_score(age_days: Column | str, stability: float) -> Column:
    """The hyperbolic score of the version store, ``1 / (1 + age / stability)``."""
    return 1 / (1 + F.greatest(_col(age_days).cast("double"), F.lit(0.0)) / stability)


def normalised(score: Column | str, top: Column | str) -> Column:
    """Share of the top score: at most 1, at least 0.01, else rounded to 4 places half up."""
    s = _col(score) / _col(top)
    return F.when(_col(top) <= 0, F.lit(0.0)).when(s >= 1, F.lit(1.0)).when(s < 0.01, F.lit(0.01)).otherwise(F.floor(s * 10000 + 0.5) / 10000)


def cap_boost(recency_part: Column | str, salience: Column | str, cap: float) -> Column:
    return F.least(_col(recency_part) * _col(salience), F.lit(cap))


def dot(a: Column | str, b: Column | str) -> Column:
    """Sum of products over the shorter length, in doubles."""
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Dot product of unit vectors, held in [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b)))


def unit(v: Column | str) -> Column:
    """A vector divided by its norm; one with a squared norm up to 1e-12 stays."""
    c = _col(v)
    square = F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return F.when(square <= 1e-12, F.transform(c, lambda x: x.cast("double"))).otherwise(F.transform(c, lambda x: x.cast("double") / F.sqrt(square)))


def auto_mode(query: Column | str) -> Column:
    """``keyword`` for queries with ``_``, ``-`` or more than two capitals, else ``hybrid``."""
    q = _col(query)
    return F.when(F.contains(q, F.lit("_")) | F.contains(q, F.lit("-")) | (F.regexp_count(q, F.lit(r"\p{Lu}")) > 2), F.lit("keyword")).otherwise(F.lit("hybrid"))
