import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lorespark.llm import language_id as m
from lorespark.llm.queries import QUERIES

DE = ["Die Straße führt über den Fluß und durch den Wald.", "Wir haben schöne Bücher über das Wetter gelesen.", "Ein Hund läuft über die Brücke."]
EN = ["The quick brown fox jumps over the lazy dog.", "We have read some books about the weather.", "A dog runs across the bridge and the road."]


def plain_contexts(texts):
    """Counts of the bytes after each context, by a dictionary."""
    out = {}
    for t in texts:
        b = bytes(m.ORDER) + t.lower().encode()
        for i in range(m.ORDER, len(b)):
            for k in range(m.ORDER + 1):
                out.setdefault(b[i - k : i], Counter())[b[i]] += 1
    return out


def plain_bits(contexts, before, byte):
    """Code length of ``byte`` after ``before``, with exclusions, straight from the definition."""
    excluded, cost = set(), 0.0
    for k in range(m.ORDER, -1, -1):
        counts = {s: n for s, n in contexts.get(before[len(before) - k :], {}).items() if s not in excluded}
        if not counts:
            continue
        total, q = sum(counts.values()), len(counts)
        if byte in counts:
            return cost + math.log2((total + q) / counts[byte])
        cost += math.log2((total + q) / q)
        excluded |= set(counts)
    return cost + math.log2(max(256 - len(excluded), 1))


def plain_length(contexts, text):
    b = bytes(m.ORDER) + text.lower().encode()
    return sum(plain_bits(contexts, b[i - m.ORDER : i], b[i]) for i in range(m.ORDER, len(b)))


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)


def learned(n):
    """Ids in the learned folds."""
    return [i for i in range(10 * n) if zlib.crc32(str(i).encode()) % 3 != 1][:n]


@pytest.fixture(scope="module")
def model(spark):
    ids = learned(6)
    rows = [*zip(ids[:3], DE, ["de"] * 3, strict=True), *zip(ids[3:], EN, ["en"] * 3, strict=True)]
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 3 == 1)
    rows += [(held, "zzz zzz zzz", "zz"), (None, "yyy yyy", "yy"), (ids[0] + 10**6 * 0, None, "xx"), (ids[1], "text without a language", None)]
    return m.train(documents(spark, rows))


def test_code_lengths_by_brute_force(model):
    assert model.langs == ["de", "en"]
    trees = [plain_contexts(DE), plain_contexts(EN)]
    texts = [*DE, *EN, "Über die Brücke läuft the dog", "x", "", None, "日本語", "\0\0a\0", "the " * 500, "qqqq###§§§"]
    got = model.code_lengths(pa.array(texts)) / m.UNIT
    for j, t in enumerate(texts):
        for i in range(2):
            assert got[i, j] == pytest.approx(plain_length(trees[i], t or ""), abs=0.01 + len(t or "") * 2e-5)


def test_probabilities_sum_to_one(model):
    for before in (b"the", b"\0\0\0", b"r\xc3\xbc", b"qzx", b"e h"):
        wanted = np.array([int.from_bytes(before + bytes([b])) for b in range(256)])
        assert np.exp2(-model.trees[1].bits(wanted)).sum() == pytest.approx(1)


def test_pieces_and_batches_change_nothing(model, monkeypatch):
    texts = pa.array([*DE, None, "", *EN, "mixed Straße " * 30, "a"])
    whole = model.code_lengths(texts)
    alone = np.concatenate([model.code_lengths(texts.slice(k, 1)) for k in range(len(texts))], 1)
    assert (whole == alone).all()
    monkeypatch.setattr(m, "PIECE", 7)
    assert (model.code_lengths(texts) == whole).all()


def test_counting_in_small_pieces(spark, monkeypatch):
    docs = documents(spark, [*((i, t, "de") for i, t in enumerate(DE)), *((i, t, "en") for i, t in enumerate(EN))])
    got = {(r["lang"], r["level"], r["gram"]): r["n"] for r in m.level_counts(m.gram_counts(docs)).collect()}
    want = {}
    for lang, texts in (("de", DE), ("en", EN)):
        for before, counts in plain_contexts(texts).items():
            want |= {(lang, len(before) + 1, int.from_bytes(before + bytes([b]))): n for b, n in counts.items()}
    assert got == want
    batch = pa.record_batch({"lang": ["de"] * 3 + ["en"] * 3, "text": DE + EN})
    full = Counter()
    for b in m._count(iter([batch])):
        full.update({(r["lang"], r["gram"]): r["n"] for r in b.to_pylist()})
    monkeypatch.setattr(m, "PIECE", 5)
    monkeypatch.setattr(m, "HELD_GRAMS", 20)
    small = Counter()
    for b in m._count(iter([batch, batch.slice(0, 0)])):
        small.update({(r["lang"], r["gram"]): r["n"] for r in b.to_pylist()})
    assert full == small


def test_hash_places():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 32, 5000, dtype=np.uint32))
    places = m.Places(keys)
    assert (places.find(keys) == np.arange(len(keys))).all()
    other = np.setdiff1d(np.random.default_rng(1).integers(0, 1 << 32, 5000, dtype=np.uint32), keys)
    assert (places.find(other) == -1).all()
    assert (m.Places(keys[:0]).find(keys) == -1).all()


def test_bounded_trees_keep_whole_contexts(spark):
    docs = documents(spark, [(i, t, "de") for i, t in zip(learned(3), DE, strict=True)])
    small = m.train(docs, cells=150)
    sizes = [len(x.gram) for x in small.trees[0].levels]
    assert 0 < sum(sizes) <= 150
    assert sum(sizes) < sum(len(x.gram) for x in m.train(docs).trees[0].levels)
    wanted = np.array([int.from_bytes(b"die" + bytes([b])) for b in range(256)])
    assert np.exp2(-small.trees[0].bits(wanted)).sum() == pytest.approx(1)


def test_odd_rows_and_names(spark, model):
    docs = spark.createDataFrame([(1, None, 9.0, "a"), (2, "", 9.0, "a"), (3, "123 !?", 9.0, "a"), (4, "the dog", 9.0, "b"), (4, "the dog", 9.0, "b"), (None, "Straße", 9.0, "c")], "doc_id long, text string, score double, `my.col` string")
    out = m.predict(docs, model)
    assert sorted(out.columns) == ["doc_id", "lang_pred", "my.col", "score", "text"]
    got = sorted(((r["doc_id"] or 0, r["lang_pred"], r["score"] > 0) for r in out.collect()))
    assert got == [(0, "de", True), (1, "und", False), (2, "und", False), (3, "und", False), (4, "en", True), (4, "en", True)]


def test_nothing_learned_one_language_and_no_rows(spark):
    empty = documents(spark, [(1, "x", "en")]).where("false")
    assert m.predict(empty, m.train(empty)).count() == 0
    some = documents(spark, [(learned(1)[0], "hello", None)])
    assert [tuple(r)[-2:] for r in m.predict(some.drop("lang"), m.train(some)).collect()] == [("und", 0.0)]
    one = documents(spark, [(learned(1)[0], "hello", "en")])
    assert [tuple(r)[-2:] for r in m.predict(one.drop("lang"), m.train(one)).collect()] == [("en", 1.0)]
    tie = documents(spark, [(i, "hello", x) for i, x in zip(learned(2), ["b", "a"], strict=True)])
    assert {r["lang_pred"] for r in m.predict(tie, m.train(tie)).collect()} == {"a"}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op11_language_id"](spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text").toPandas(), on="doc_id")
    assert len(got) == 1000 and got.score.between(0, 1).all()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    held = got[got.held_out & got.lang.notna() & (got.lang_pred != "und")]
    assert (held.lang == held.lang_pred).mean() > 0.99
