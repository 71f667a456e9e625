"""Graph operators against plain searches on random graphs."""

import random
from collections import deque

import pytest

from lorespark.operators import graph

EDGES = "src string, dst string, edge_type string, provenance string, seq long"
TYPES = ["depends_on", "extends", "references", "relates_to"]


def random_edges(seed, nodes=40, n=70):
    rng = random.Random(seed)
    return [(f"n{rng.randrange(nodes):02d}", f"n{rng.randrange(nodes):02d}", rng.choice(TYPES), rng.choice(["explicit", "derived"]), i) for i in range(n)]


def steps(edges, start, both=True, types=None):
    """Depth of every node that is reached."""
    out = {}
    for a, b, t, _, _ in edges:
        if types is None or t in types:
            if both:
                out.setdefault(a, set()).add(b)
            out.setdefault(b, set()).add(a)
    seen, queue = {start: 0}, deque([start])
    while queue:
        a = queue.popleft()
        for b in out.get(a, ()):
            if b not in seen:
                seen[b] = seen[a] + 1
                queue.append(b)
    return seen


@pytest.fixture(scope="module", params=[1, 2])
def case(spark, request):
    rows = random_edges(request.param)
    return rows, spark.createDataFrame(rows, EDGES)


def test_degrees_and_centrality(case):
    rows, df = case
    degree = {}
    for a, b, *_ in rows:
        degree[a] = degree.get(a, 0) + 1
        degree[b] = degree.get(b, 0) + 1
    assert {r["id"]: r["degree"] for r in graph.degrees(df).collect()} == degree
    weight = {"depends_on": 5, "extends": 10, "references": 1, "relates_to": 0}
    want = {}
    for _, b, t, p, _ in rows:
        want[b] = want.get(b, 0) + weight[t] * {"explicit": 1, "derived": 0.5}[p]
    assert {r["id"]: r["centrality"] for r in graph.centrality(df).collect()} == pytest.approx(want)


@pytest.mark.parametrize("depth", [1, 3, 9])
def test_subgraph_depths(case, depth):
    rows, df = case
    nodes, edges = graph.subgraph(df, rows[0][0], depth)
    want = {n: d for n, d in steps(rows, rows[0][0]).items() if d <= min(depth, 5)}
    assert {r["id"]: r["depth"] for r in nodes.collect()} == want
    assert edges.count() == sum((a in want) + (b in want and a != b) for a, b, *_ in rows)


def test_shortest_paths(case):
    rows, df = case
    start = rows[0][0]
    depth = steps(rows, start)
    for end in sorted(depth)[:4] + ["nowhere"]:
        found = graph.shortest_path(df, start, end).collect()
        if end not in depth:
            assert found == []
            continue
        hops = [h["node"] for h in found[0]["hops"]]
        assert len(hops) == depth[end] == found[0]["depth"]
        links = {(a, b) for a, b, *_ in rows} | {(b, a) for a, b, *_ in rows}
        assert all(x in links for x in zip([start, *hops], hops, strict=False))


def test_affected_follows_inbound_impact_edges(case):
    rows, df = case
    node = rows[1][1]
    want = {n: d for n, d in steps(rows, node, both=False, types={"depends_on", "extends"}).items() if 0 < d <= 10}
    assert {r["id"]: r["depth"] for r in graph.affected(df, node).collect()} == want


def reachable(rows):
    out = {}
    for a, b, *_ in rows:
        out.setdefault(a, set()).add(b)
    found = {}
    for n in out:
        seen, todo = set(), list(out[n])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out.get(x, ())
        found[n] = seen
    return found


def test_cycles_and_strong_components(case, spark):
    rows, df = case
    reach = reachable(rows)
    on_cycle = {n for n in reach if n in reach[n]}
    want = {n: frozenset(m for m in on_cycle if m == n or (m in reach[n] and n in reach[m])) for n in on_cycle}
    got = {}
    for r in graph.strong_components(df).collect():
        got.setdefault(r["component"], set()).add(r["id"])
    assert {frozenset(x) for x in got.values() if len(x) > 1} == {x for x in want.values() if len(x) > 1}
    assert graph.has_cycle(df) == bool(on_cycle)
    line = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "extends", "explicit", i) for i in range(5)], EDGES)
    assert not graph.has_cycle(line)


def test_mutual_components_and_one_way_edges(spark, monkeypatch):
    rng = random.Random(4)
    names = [f"n{i}" for i in range(40)]
    both = [(rng.choice(names), rng.choice(names)) for _ in range(18)]
    one = [(rng.choice(names), rng.choice(names)) for _ in range(30)]
    edges = both + [(b, a) for a, b in both] + one + [("n1", "n1")]
    steps = {n: {b for a, b in edges if a == n} for n in names}

    def reached(n):
        seen, front = set(), {n}
        while front:
            front = set().union(*(steps[x] for x in front)) - seen
            seen |= front
        return seen

    reach = {n: reached(n) for n in names}
    want = {n: max([m for m in names if m in reach[n] and n in reach[m]] + [n]) for n in names if any(m != n and n in reach[m] for m in reach[n])}
    got = {r["id"]: r["component"] for r in graph.strong_components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == want and len(set(want.values())) > 1
    # edges both ways are joined without colouring
    monkeypatch.setattr(graph, "_coloured", None)
    twice = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "b"), ("x", "y"), ("y", "x")]
    assert {tuple(r) for r in graph.strong_components(spark.createDataFrame(twice, "src string, dst string")).collect()} == {("a", "c"), ("b", "c"), ("c", "c"), ("x", "y"), ("y", "y")}
