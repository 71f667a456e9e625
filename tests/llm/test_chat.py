"""Role repair against all labellings, whatever the partitions."""

import itertools
import random

import pytest

from lorespark.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, key string, part int"
ROLES = chat.ROLES


def inserts(before, label):
    """Fewest empty turns between two labels of which the second follows (before None: the start)."""
    allowed = {None: {"system", "user"}, "system": {"user"}, "user": {"assistant"}, "assistant": {"user"}}
    reach, n = {before}, 0
    while n < 6:
        reach = set().union(*(allowed[x] for x in reach))
        if label in reach:
            return n
        n += 1
    return None


def best_cost(roles):
    """The least cost over every labelling, each merged wherever that's cheaper."""
    least = None
    for labels in itertools.product(ROLES, repeat=len(roles)):
        cost, before = 0, None
        for role, label in zip(roles, labels, strict=True):
            cost += 1 if role not in ROLES else 4 * (role != label)
            n = inserts(before, label)
            ways = ([3 * n] if n is not None else []) + ([1] if before == label else [])
            if not ways:
                break
            cost, before = cost + min(ways), label
        else:
            cost += {"system": 6, "user": 3, "assistant": 0}[before]
            least = cost if least is None else min(least, cost)
    return least


def check_rendering(segments):
    """Headers must alternate legally; returns their roles."""
    text = "".join(segments)
    heads = [x.split("\n", 1)[0] for x in text.split("<|im_start|>")[1:]]
    state = None
    for h in heads:
        assert h in {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}[state]
        state = h
    assert state == "assistant" and text.count("<|im_end|>") == len(heads) and text.endswith("<|im_end|>\n")


def rows_of(convs):
    return [(i, t, r, f"text {t}", "k", 0) for i, roles in enumerate(convs) for t, r in enumerate(roles)]


def by_conv(found):
    out = {}
    for r in sorted(found, key=lambda r: (r["conv_id"] is not None, r["conv_id"], r["turn"])):
        out.setdefault(r["conv_id"], []).append(r)
    return out


def test_costs_are_least_and_renderings_legal(spark):
    rng = random.Random(6)
    convs = [list(c) for n in (1, 2, 3) for c in itertools.product([*ROLES, None], repeat=n)]
    convs += [[rng.choice([*ROLES, "tool", None]) for _ in range(rng.randrange(4, 7))] for _ in range(40)]
    got = by_conv(chat.repair(spark.createDataFrame(rows_of(convs), SCHEMA)).collect())
    assert len(got) == len(convs)
    for i, roles in enumerate(convs):
        assert sum(r["cost"] for r in got[i]) == best_cost(roles), roles
        assert [r["role"] for r in got[i]] == roles
        check_rendering([r["segment"] for r in got[i]])
        for r in got[i]:
            assert ("relabel" in r["action"]) == (r["new_role"] != r["role"]) and f"text {r['turn']}" in r["segment"]


def test_a_legal_conversation_stays_as_it_is(spark):
    got = chat.repair(spark.createDataFrame(rows_of([["system", "user", "assistant", "user", "assistant"]]), SCHEMA)).collect()
    assert {(r["action"], r["cost"], r["inserted"]) for r in got} == {("keep", 0, 0)}
    assert "".join(r["segment"] for r in sorted(got, key=lambda r: r["turn"])).startswith("<|im_start|>system\ntext 0<|im_end|>\n<|im_start|>user\ntext 1<|im_end|>\n")


@pytest.fixture
def many_parts(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_a_split_conversation_equals_an_unsplit_one(spark, many_parts):
    rng = random.Random(3)
    convs = [[rng.choice([*ROLES, "user", "user", None]) for _ in range(n)] for n in (3000, 2, 900, 1, 40, 7)]
    df = spark.createDataFrame(rows_of(convs), SCHEMA)
    got = by_conv(chat.repair(df).collect())
    for i, roles in enumerate(convs):
        want = chat.render([(i, t, r, f"text {t}") for t, r in enumerate(roles)])
        assert [tuple(r) for r in got[i]] == want


def test_odd_rows(spark):
    rows = [(None, 1, "user", "n", None, 1), (1, None, "user", None, None, 1), (1, 1, "assistant", "", None, 1), (2, 1, "assistant", "a", None, 1), (2, 1, "assistant", "a", None, 1), (3, 1, "user", "x" * 2_000_000, None, 1), (3, 2, "bot", "y", None, 1)]
    got = chat.repair(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    assert {(r["turn"], r["action"]) for r in got if r["conv_id"] == 1} == {(None, "keep"), (1, "keep")}
    assert sum(r["cost"] for r in got if r["conv_id"] == 2) == best_cost(["assistant"] * 2)
    assert next(r for r in got if r["turn"] == 2)["new_role"] == "assistant"
    assert [r["inserted"] for r in got if r["conv_id"] is None] == [1]
    assert chat.repair(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ties_and_equal_rows_do_not_depend_on_the_cuts(spark, many_parts):
    rng = random.Random(8)
    rows = [(1, 5, rng.choice([*ROLES, None]), rng.choice(["same text", "another", "x" * 80 + str(k % 5), None]), None, 1) for k in range(900)]
    view = lambda df: sorted((tuple(r) for r in chat.repair(df).collect()), key=repr)
    split = view(spark.createDataFrame(rows, SCHEMA))
    rng.shuffle(rows)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    assert view(spark.createDataFrame(rows, SCHEMA)) == split
