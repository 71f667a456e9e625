"""Containment search against sets of shingles."""

import random
import re

import pytest

from lorespark.llm import decontam

DOCS = "doc_id long, text string, leaks string, item_id int, score double"


def grams(text):
    w = re.findall("[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def plain(docs, items):
    out = []
    for d in docs:
        have = grams(d[1])
        for item_id, text in items:
            s = grams(text)
            if s and len(s & have) >= 0.8 * len(s) - 1e-9:
                out.append((d[0], item_id, len(s & have), len(s)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_words", [1_000_000, 300])
def test_leaks_match_plain_version(spark, block_words):
    rng = random.Random(4)
    words = lambda n, k=400: [f"w{rng.randrange(k)}" for _ in range(n)]
    items = [(i, " ".join(words(rng.randrange(3, 60)))) for i in range(40)]
    items += [(90, None), (91, ""), (92, "a b c d"), (93, items[5][1]), (5, items[5][1]), (None, "null id item has six words"), (94, "é ü ß ñ 日本 ok")]
    docs = []
    for i in range(80):
        body = words(rng.randrange(0, 120))
        for item_id, text in rng.sample(items[:40], 2):
            w = text.split()
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = "changed"
            at = rng.randrange(len(body) + 1)
            body[at:at] = w
        docs.append((i if i % 9 else None, " ".join(body), "old", 1, 0.5))
    docs += [docs[3], (100, None, None, None, None), (101, "", None, None, None), (102, "Null, ID item\nhas SIX words! É ü ß ñ 日本 ok", None, None, None)]
    docs.append((103, " ".join(words(200_000, 10**6)) + " " + items[7][1] + " " + " ".join(words(1000, 10**6)), None, None, None))
    df = spark.createDataFrame(docs, DOCS)
    it = spark.createDataFrame([(*x, "en") for x in items], "item_id long, text string, doc_id string")
    got = decontam.find_leaks(df, it, block_words=block_words).collect()
    assert sorted(((r["doc_id"], r["item_id"], r["shared"], r["shingles"]) for r in got), key=str) == plain(docs, items)
    assert all(r["containment"] == r["shared"] / r["shingles"] for r in got)


def test_empty_sides_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x", 2, 0.1)], DOCS)
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontam.find_leaks(docs.limit(0), items).count() == 0
    assert decontam.find_leaks(docs, items.limit(0)).count() == 0
    found = decontam.with_leaks(docs, items)
    assert found.columns == ["doc_id", "text", "item_id", "score", "leaks"]
    assert found.first()["leaks"][0]["shared"] == 2


def test_a_leaking_item_hits_its_sketch_for_certain():
    for size in range(1, 300):
        assert decontam.sketch_size(size, 0.8) > size - -(-size * 8 // 10)
