import hashlib

import numpy as np
import pytest

from lorespark.llm import vector_codes
from lorespark.llm.queries import ORACLE_SQL, QUERIES


def brute(rows, entries=64, rounds=2, parts=16):
    """The contract by plain loops; rows are (vec_id, vector, label)."""
    kept = [(i, [int(np.floor(256 * float(x))) for x in v], lab) for i, v, lab in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return [], None
    d = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * d : (p + 1) * d]
    first = {}
    for i, v, _ in sorted((r for r in kept if r[0] is not None), key=lambda r: (r[0], r[1])):
        first.setdefault(i, v)
    books = [[cut(v, p) for v in list(first.values())[:entries]] for p in range(parts)]

    def assign(v, p):
        far = [sum((a - b) ** 2 for a, b in zip(cut(v, p), e, strict=True)) for e in books[p]]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        new = []
        for p in range(parts):
            mine = [(assign(v, p)[0], cut(v, p)) for _, v, _ in kept]
            new.append([[sum(x[j] for x in own) // len(own) for j in range(d)] if (own := [x for e, x in mine if e == k]) else old for k, old in enumerate(books[p])])
        books = new
    out = []
    for i, v, lab in kept:
        codes = [assign(v, p) for p in range(parts)]
        out.append((i, "".join(f"{c:02x}" for c, _ in codes), sum(x for _, x in codes), lab))
    by = {}
    for _, _, error, lab in out:
        by[lab] = by.get(lab, 0) + error
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, by[lab], sha) for i, c, e, lab in out), key=repr), sha


def test_same_as_sql(same_as_sql):
    same_as_sql(QUERIES["op13_vector_codes"], ORACLE_SQL["op13_vector_codes"])


@pytest.mark.parametrize(("d", "spread"), [(1, 3), (2, 4), (3, 500), (8, 5), (8, 3000)])
def test_partial_search_equals_full_search(d, spread):
    rng = np.random.default_rng(d * spread)
    v, book = rng.integers(-spread, spread, (300, d)), rng.integers(-spread, spread, (40, d))
    book[7] = book[3]  # equal entries: the lower index wins
    full = ((v[:, None] - book[None]) ** 2).sum(2)
    codes, far = vector_codes.nearest(v, book)
    assert (codes == full.argmin(1)).all() and (far == full.min(1)).all()
    assert 7 not in codes


def test_no_vectors_or_one_entry():
    assert [len(x) for x in vector_codes.nearest(np.zeros((0, 4), np.int64), np.zeros((3, 4), np.int64))] == [0, 0]
    codes, far = vector_codes.nearest(np.array([[1, 2], [3, 3]]), np.array([[1, 1]]))
    assert codes.tolist() == [0, 0] and far.tolist() == [1, 8]


def odd_rows():
    rng = np.random.default_rng(5)
    some = [(int(i), [float(x) for x in rng.normal(size=32).astype(np.float32)], int(i) % 3 or None) for i in rng.permutation(90)]
    some += some[:4]  # repeated rows
    nan, inf = float("nan"), float("inf")
    some += [(200, None, 1), (201, [], 1), (202, [0.5] * 31 + [None], 1), (203, [nan] * 32, 1), (204, [0.1] * 31 + [-inf], 2), (None, [0.25] * 32, None), (None, [-0.25] * 32, 9)]
    return some


def test_odd_rows_by_brute_force(spark):
    rows = odd_rows()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, code string").repartition(5)
    got = vector_codes.compress(docs).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)[0]


def test_clashing_names_and_extra_columns(spark):
    df = spark.createDataFrame([(i, [float(i)] * 16, 0, "a", 7) for i in range(3)], "`my.id` long, v array<double>, lab int, label_error string, extra int")
    out = vector_codes.compress(df, "my.id", "v", "lab")
    assert sorted(out.columns) == ["code", "codebooks_sha256", "error", "extra", "lab", "label_error", "my.id"]
    assert {r["label_error"] for r in out.collect()} == {0} and {r["extra"] for r in out.collect()} == {7}


def test_empty_odd_lengths_and_huge_components(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vector_codes.compress(spark.createDataFrame([], schema)).count() == 0
    assert vector_codes.compress(spark.createDataFrame([(None, [1.0] * 16, 1)], schema)).count() == 0
    rows = [(1, [1.0] * 15, 1), (2, [1.0] * 32, 1), (3, [1.0] * 16, 1), (4, [3e38] * 32, 1), (5, [-3e38] * 32, 1)]
    got = {r["vec_id"]: r["error"] for r in vector_codes.compress(spark.createDataFrame(rows, schema)).collect()}
    assert got == {2: 0, 4: 0, 5: 0}
