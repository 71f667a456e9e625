"""Near duplicates, alignment and components against plain versions."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lorespark.llm import near_dup
from lorespark.llm.alignment import banded_distance, similar
from lorespark.llm.components import components
from lorespark.llm.words import word_hashes


def distance(a, b):
    """Plain Levenshtein distance, one row at a time."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def groups(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(x) for x in range(n)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=14), st.lists(st.integers(0, 4), max_size=14), st.integers(0, 12))
def test_banded_distance_matches_plain(a, b, limit):
    assert banded_distance(a, b, limit) == min(distance(a, b), limit + 1)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=16), st.lists(st.integers(0, 3), min_size=1, max_size=16), st.sampled_from([0.5, 0.8, 1.0]))
def test_similar_matches_plain(a, b, threshold):
    longest = max(len(a), len(b))
    assert similar(np.array(a), np.array(b), threshold) == (distance(a, b) <= int((1 - threshold) * longest + 1e-9))


def edited(words, rng, n):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[at] = f"new{rng.randrange(10**6)}"
        elif kind == 1:
            words.insert(at, f"new{rng.randrange(10**6)}")
        else:
            del words[at]
    return words


def classes_of(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string, keys int")
    return {r["doc_id"]: r for r in near_dup.classes(docs).collect()}


def test_classes_match_brute_force(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(70, 130))]
        texts += [base, base, edited(base, rng, 2), edited(base, rng, 4), rng.sample(base, len(base)), base[: len(base) // 2]]
    rng.shuffle(texts)
    rows = [(i, " ".join(w), "x", 1) for i, w in enumerate(texts)]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if distance(texts[i], texts[j]) <= int(0.2 * max(len(texts[i]), len(texts[j])) + 1e-9)]
    want = groups(len(texts), pairs)
    got = classes_of(spark, rows)
    assert [got[i]["class_id"] for i in range(len(texts))] == want
    assert {i for i, r in got.items() if r["keep"]} == set(want)


def test_a_chain_and_a_large_group_are_one_class_each(spark):
    rng = random.Random(5)
    step = [f"a{i}" for i in range(100)]
    rows = []
    for i in range(30):
        rows.append((i, " ".join(step)))
        step = edited(step, rng, 3)
    big = [f"b{i}" for i in range(200)]
    rows += [(1000 + i, " ".join(edited(big, rng, 4))) for i in range(300)]
    got = classes_of(spark, [(*r, None, None) for r in rows])
    assert {got[i]["class_id"] for i in range(30)} == {0}
    assert {got[i]["class_id"] for i in range(1000, 1300)} == {1000}


def test_recall_and_precision_near_the_threshold(spark):
    rng = random.Random(9)
    rows, pairs = [], []
    for k in range(120):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 260))]
        other = edited(base, rng, max(1, len(base) // 12))
        rows += [(2 * k, " ".join(base), None, None), (2 * k + 1, " ".join(other), None, None)]
        pairs.append(distance(base, other) <= int(0.2 * max(len(base), len(other)) + 1e-9))
    got = classes_of(spark, rows)
    found = [got[2 * k]["class_id"] == got[2 * k + 1]["class_id"] for k in range(120)]
    assert sum(f and p for f, p in zip(found, pairs, strict=True)) >= 0.95 * sum(pairs)
    assert all(r["class_id"] in (i, i - i % 2) for i, r in got.items())


def test_copies_behind_a_passage_that_strangers_share(spark):
    rng = random.Random(21)
    passage = [f"p{rng.randrange(5000)}" for _ in range(300)]
    rows, near = [], []
    for k in range(80):
        base = passage + [f"w{rng.randrange(10**6)}" for _ in range(100)]
        other = edited(base, rng, 36)
        rows += [(2 * k, " ".join(base), None, None), (2 * k + 1, " ".join(other), None, None)]
        near.append(similar(word_hashes(rows[-2][1]), word_hashes(rows[-1][1]), near_dup.THRESHOLD))
    got = classes_of(spark, rows)
    assert all(near)
    assert sum(got[2 * k]["class_id"] == got[2 * k + 1]["class_id"] for k in range(80)) >= 79
    assert all(r["class_id"] in (i, i - i % 2) for i, r in got.items())


@pytest.mark.parametrize(("low", "high", "edits"), [(0.8, 0.81, 88), (0.85, 0.86, 64), (0.9, 0.91, 42)])
def test_recall_of_long_texts_at_the_threshold(spark, low, high, edits):
    rng = random.Random(33)
    rows = []
    while len(rows) < 400:
        base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        other = edited(base, rng, edits)
        if similar(*(np.array([hash(w) for w in x]) for x in (base, other)), low) and not similar(*(np.array([hash(w) for w in x]) for x in (base, other)), high):
            rows += [(len(rows), " ".join(base), None, None), (len(rows) + 1, " ".join(other), None, None)]
    got = classes_of(spark, rows)
    found = sum(got[i]["class_id"] == got[i + 1]["class_id"] for i in range(0, 400, 2))
    print(f"recall at {low}: {found} of 200")
    assert found >= 198
    assert all(r["class_id"] in (i, i - i % 2) for i, r in got.items())


def test_nulls_empties_short_and_very_long_texts(spark):
    long = " ".join(f"w{i % 9000}" for i in range(150_000))
    rows = [(1, None), (2, ""), (3, " .,!"), (4, "one two"), (5, "One, two!"), (None, "one two"), (6, long), (7, long + " end"), (8, long), (8, long), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["class_id"], r["keep"]) for r in near_dup.classes(docs).collect()]
    assert len(got) == len(rows)
    assert sorted(x for x in got if x[0] in (1, 2, 3)) == [(1, 1, True), (2, 2, True), (3, 3, True)]
    assert {x[1] for x in got if x[0] in (4, 5)} == {4} and (None, 4, False) in got and (None, None, True) in got
    assert {x[1] for x in got if x[0] in (6, 7, 8)} == {6}


def test_deduplicate_keeps_one_of_each_class_and_all_columns(spark):
    rows = [(3, "a b c d e f g", "x", 1), (1, "a b c d e f g", "y", 2), (1, "a b c d e f g", "y", 2), (9, "", "z", 3), (8, None, "z", 3), (None, "q r s t u", "n", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root string, _node int")
    kept = near_dup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((tuple(r) for r in kept.collect()), key=str) == sorted([rows[1], rows[3], rows[4], rows[5]], key=str)
    assert near_dup.deduplicate(docs.limit(0)).count() == 0
    assert near_dup.classes(docs.select("doc_id", "text").limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1064)] + [(2000, i) for i in range(2001, 2100)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = groups(2200, edges)
    assert got == {i: r for i, r in enumerate(want) if r != i}


def test_order_and_repeats_change_the_keys():
    keys = lambda t: set(near_dup.order_keys(word_hashes(t)).tolist())
    text = " ".join(f"w{i}" for i in range(300))
    halves = text.split()
    assert len(keys(text) & keys(" ".join(halves[150:] + halves[:150]))) < len(keys(text)) * 0.6
    assert near_dup.order_keys(word_hashes("")) is None
    labelled = near_dup.labelled_kmers(word_hashes("a b " * 20), 2)
    assert len(set(labelled.tolist())) == len(labelled)


@pytest.mark.parametrize("words", [40, 200, 1000])
def test_recall_up_to_a_fifth_of_edits_with_a_family_of_copies(spark, words):
    rng = random.Random(words)
    family = [f"f{rng.randrange(10**6)}" for _ in range(words)]
    rows = [(10_000 + i, " ".join(edited(family, rng, words // 20)), None, None) for i in range(60)]
    for k in range(120):
        base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
        other = edited(base, rng, words * (5 + k % 4 * 5) // 100)
        rows += [(2 * k, " ".join(base), None, None), (2 * k + 1, " ".join(other), None, None)]
    near = [similar(word_hashes(rows[60 + 2 * k][1]), word_hashes(rows[61 + 2 * k][1]), near_dup.THRESHOLD) for k in range(120)]
    got = classes_of(spark, rows)
    found = [got[2 * k]["class_id"] == got[2 * k + 1]["class_id"] for k in range(120)]
    print(f"{words} words: {sum(found)} of {sum(near)}")
    assert not any(f and not n for f, n in zip(found, near, strict=True))
    assert sum(found) >= 0.97 * sum(near)
    assert {got[10_000 + i]["class_id"] for i in range(60)} == {10_000}


def crowd(n, share, seed=1):
    """``n`` texts of 10 of 16 shared passages in random order, and copies of some with a share of their words edited."""
    rng = random.Random(seed)
    passages = [[f"p{k}x{rng.randrange(10**6)}" for _ in range(30)] for k in range(16)]
    rows = [sum((passages[k] for k in rng.sample(range(16), 10)), []) for _ in range(n)]
    copies = n // 50
    rows += [edited(rows[i], rng, int(share * 300)) for i in range(copies)]
    near = [i for i in range(copies) if similar(word_hashes(" ".join(rows[i])), word_hashes(" ".join(rows[n + i])), near_dup.THRESHOLD)]
    return [(i, " ".join(w), None, None) for i, w in enumerate(rows)], [(i, n + i) for i in near]


@pytest.mark.parametrize(("n", "share"), [(1500, 0.15), (1500, 0.19)])
def test_copies_among_texts_of_the_same_passages(spark, n, share):
    rows, near = crowd(n, share)
    got = classes_of(spark, rows)
    found = sum(got[a]["class_id"] == got[b]["class_id"] for a, b in near)
    print(f"{n} texts, {share} edited: {found} of {len(near)}")
    assert len(near) > 20 and found >= 0.9 * len(near)


def test_pairs_of_small_buckets_by_brute_force():
    import pyarrow as pa

    rng = np.random.default_rng(6)
    member = lambda: {"id": int(rng.integers(0, 40)), "root": int(rng.integers(0, 6)), "size": int(rng.integers(20, 30)), "coarse": (np.bincount(rng.integers(0, near_dup.COARSE, 5), minlength=near_dup.COARSE) + 1).astype(np.uint8).tobytes()}
    buckets = [[member() for _ in range(rng.integers(1, 9))] for _ in range(50)]
    got = [(a, b) for r in near_dup._fitting_pairs(iter([pa.record_batch({"members": buckets})])) for a, b in zip(*r.to_pydict().values(), strict=True)]
    want = []
    for bucket in buckets:
        for i, x in enumerate(bucket):
            for y in bucket[i + 1 :]:
                diff = np.frombuffer(x["coarse"], np.uint8).astype(int) - np.frombuffer(y["coarse"], np.uint8)
                limit = int(0.2 * max(x["size"], y["size"]) + 1e-9)
                if x["root"] != y["root"] and abs(x["size"] - y["size"]) <= limit and max(np.maximum(diff, 0).sum(), np.maximum(-diff, 0).sum()) <= limit:
                    want.append((min(x["id"], y["id"]), max(x["id"], y["id"])))
    assert sorted(got) == sorted(want) and got


@pytest.mark.parametrize("best", [False, True])
def test_pairs_of_blocks_by_brute_force(best, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(near_dup, "BLOCK", 40)
    rng = np.random.default_rng(8)
    rows = []
    for i in range(300):
        size = int(rng.integers(20, 40))
        root = int(rng.integers(0, 5)) if i % 3 else 100 + i
        rows.append((int(i >= 260), i, root, size, np.bincount(rng.integers(0, 6, size), minlength=near_dup.BINS).astype(np.uint8).tobytes()))
    rows.sort(key=lambda r: (r[0], r[3]))
    batch = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["key", "id", "root", "size", "bag"])
    blocks = [b for x in near_dup._cut(iter([batch.slice(0, 70), batch.slice(70)])) for b in x.to_pylist()]
    assert [b["n"] for b in blocks] == [40] * 6 + [20, 40]
    got = []
    for i, x in enumerate(blocks):
        for y in blocks[i:]:
            if x["key"] == y["key"]:
                group = pa.Table.from_pylist([x] if x is y else [x, y])
                got += [tuple(r.values()) for r in near_dup._between(best)(group).to_pylist()]
    want = set()
    for i, (key, a, root, size, bag) in enumerate(rows):
        for other, b, its, long, bag_b in rows[i + 1 :]:
            diff = np.frombuffer(bag, np.uint8).astype(int) - np.frombuffer(bag_b, np.uint8)
            if key == other and root != its and max(np.maximum(diff, 0).sum(), np.maximum(-diff, 0).sum()) <= int(0.2 * max(size, long) + 1e-9):
                want.add((min(a, b), max(a, b)))
    root = {r[1]: r[2] for r in rows}
    roots = lambda pairs: {(min(root[a], root[b]), max(root[a], root[b])) for a, b in pairs}
    if best:
        assert set(got) <= want and roots(got) == roots(want) and len(got) < len(want)
    else:
        assert len(got) == len(want) and set(got) == want


def test_no_pair_of_a_large_bucket_is_left_out(spark):
    rng = random.Random(44)
    passage = [f"p{i}" for i in range(60)]
    rows, pairs = [], []
    for k in range(150):
        # all that copies share is in the passage, all the rest is in another order
        own = [f"w{k}x{i}" for i in range(14)]
        at = rng.randrange(60)
        base = passage[:at] + own + passage[at:]
        other = passage[:at] + [f"v{k}x{i}" if i % 5 == 0 else w for i, w in enumerate(own)] + passage[at:]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    texts = [word_hashes(t) for _, t in rows]
    keys = [set(np.concatenate([near_dup.order_keys(w), near_dup.shingle_keys(w, near_dup.SINGLES)]).tolist()) for w in texts]
    pairs = [(i, j) for i in range(300) for j in range(i) if keys[i] & keys[j] and similar(texts[i], texts[j], near_dup.THRESHOLD)]
    got = classes_of(spark, [(*r, None, None) for r in rows])
    assert [got[i]["class_id"] for i in range(300)] == groups(300, pairs)


def coded_blocks(rows):
    """Blocks of ``rows(key, id, root, words, hot)``, one after another."""
    import pyarrow as pa

    rows = sorted(rows, key=lambda r: (r[0], len(r[3]), r[1]))
    columns = [[r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [len(r[3]) for r in rows], [near_dup.word_codes(r[3]) for r in rows], [r[4] for r in rows]]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
    batch = pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["key", "id", "root", "size", "code", "hot"])
    return [b for x in near_dup._cut(iter([batch.slice(0, 50), batch.slice(50)])) for b in x.to_pylist()]


@pytest.mark.parametrize("join", [False, True])
def test_only_alike_texts_leave_blocks_and_a_pair_once(join, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(near_dup, "BLOCK_BYTES", 4000)
    rng = random.Random(12)
    passages = [[f"p{k}x{i}" for i in range(8)] for k in range(5)]
    # the same words in another order, and copies of some
    texts = [sum(rng.sample(passages, 5), []) for _ in range(60)]
    texts += [edited(t, rng, 5) for t in texts[:30]]
    words = [word_hashes(" ".join(t)) for t in texts]
    want = {(i, j) for j in range(90) for i in range(j) if similar(words[i], words[j], near_dup.THRESHOLD)}
    blocks = coded_blocks([(key, i, 1000 + i, w, [3, 7]) for key in (3, 7) for i, w in enumerate(words)])
    assert all(len(b["codes"]) <= 4000 for b in blocks) and len(blocks) >= 4
    got = []
    for i, x in enumerate(blocks):
        for y in blocks[i:]:
            if x["key"] == y["key"]:
                got += [tuple(r.values()) for r in near_dup._between(False, join)(pa.Table.from_pylist([x] if x is y else [x, y])).to_pylist()]
    assert {g[2] for g in got} == {3}
    found = [g[:2] for g in got]
    assert set(found) <= want and len(set(found)) == len(found)
    assert groups(90, found) == groups(90, want) if join else set(found) == want


def test_unlike_pairs_of_a_crowd_are_not_listed(spark, monkeypatch):
    rows, near = crowd(400, 0.15)
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string, keys int").select("doc_id", "text")
    tried, plain = [], near_dup.links
    monkeypatch.setattr(near_dup, "links", lambda texts, pairs, nodes: tried.append(pairs.count()) or plain(texts, pairs, nodes))
    nodes = near_dup.sketches(docs)
    found = {r["node"]: r["root"] for r in near_dup.all_links(docs, nodes).collect()}
    of = {r["doc_id"]: bytes(r["n"]) for r in docs.select("doc_id", near_dup.node(docs["text"]).alias("n")).collect()}
    top = lambda i: bytes(found.get(of[i], of[i]))
    assert sum(top(a) == top(b) for a, b in near) >= 0.9 * len(near) > 4
    print(tried)
    assert sum(tried[1:]) < len(rows)


def test_counts_of_two_blocks_are_compared_in_little_memory():
    import tracemalloc

    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    texts = [word_hashes(" ".join(rng.sample(words, 300))) for _ in range(560)]
    (block,) = coded_blocks([(3, i, 1000 + i, w, [3]) for i, w in enumerate(texts)])
    tracemalloc.start()
    found = near_dup._apart(near_dup._opened(block), None, False)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert found.num_rows == 560 * 559 // 2
    print(f"{peak >> 20} MB")
    assert peak < 60 << 20


def test_kept_counts_are_bounded(monkeypatch):
    monkeypatch.setattr(near_dup, "HELD", 1000)
    rng = random.Random(8)
    texts = [word_hashes(" ".join(f"w{rng.randrange(99)}" for _ in range(n))) for n in (300, 300, 400, 1500, 200)]
    (block,) = coded_blocks([(3, i, 1000 + i, w, [3]) for i, w in enumerate(texts)])
    of = near_dup._Texts(block)
    for r in (0, 1, 2, 3, 4, 0, 3, 2):
        p, q = of.counts(r)
        code = of.code(r).astype(np.uint32)
        assert (p == near_dup.told_apart(code)).all() and len(q) == len(code) - 1
        assert len(of.held_counts) == 1 or sum(len(x) for x, _ in of.held_counts.values()) <= 1000
    bags = near_dup._opened(block)["bag"]
    assert all((b == np.bincount(of.code(r) & 255, minlength=256)).all() for r, b in enumerate(bags))


def test_a_crowd_goes_through_its_blocks_once_if_words_refuse_nothing(spark, monkeypatch):
    rows, near = crowd(400, 0.15)
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string, keys int").select("doc_id", "text")
    went, plain = [], near_dup.between_blocks
    monkeypatch.setattr(near_dup, "between_blocks", lambda *a: went.append(1) or plain(*a))
    near_dup.all_links(docs, near_dup.sketches(docs))
    assert len(went) == 1


def test_components_of_many_edges_match_those_of_few(spark, monkeypatch):
    from lorespark.llm import components as module

    rng = random.Random(4)
    edges = spark.createDataFrame([(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1064)], "a long, b long")
    few = sorted(map(tuple, components(edges).collect()))
    monkeypatch.setattr(module, "TINY", 0)
    assert few == sorted(map(tuple, components(edges).collect()))


def test_shuffle_files_go_with_their_query(spark):
    import glob
    import time

    from lorespark.llm.shared import checkpointed, tidy

    of = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    files = lambda: {f for d in of for f in glob.glob(f"{d.getPath()}/*/shuffle_*.data")}
    before = files()
    with tidy(spark):
        kept = checkpointed(spark.range(10_000).groupBy("id").count())
        assert kept.count() == 10_000
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) in (None, "false")
