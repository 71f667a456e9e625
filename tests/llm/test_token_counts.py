"""Token rollups: sums against a plain ledger, repeated and broken commits."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lorespark.llm import token_counts as tc
from lorespark.llm.shared import table

CHANGES = "op string, source string, lang string, tokenizer string, n_tokens long, old_tokens long, documents int"


def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(tc.TOKENIZERS, tc.VOCABULARY))
    t.encode_special_tokens = True
    return lambda s: len(t.encode(s or "", add_special_tokens=False).ids)


def ledger(rows):
    docs, tokens = Counter(), Counter()
    for op, source, lang, version, new, old, _ in rows:
        k, new, old = (source, lang, version), new or 0, old or 0
        docs[k] += {"insert": 1, "delete": -1, "revise": 0}[op]
        tokens[k] += {"insert": new, "delete": -new, "revise": new - old}[op]
    return {k: (docs[k], tokens[k]) for k in docs if docs[k] or tokens[k]}


def totals(rollup):
    return {(r["source"], r["lang"], r["tokenizer"]): (r["documents"], r["tokens"]) for r in rollup.totals().collect()}


def names(rollup):
    return {r["batch"] for r in rollup.batches().collect()}


def test_signed_changes_match_a_ledger(spark, tmp_path):
    rng = random.Random(1)
    rollup, seen = tc.Rollup(spark, f"file://{tmp_path}/r"), []
    assert totals(rollup) == {}
    for b in range(5):
        rows = [(rng.choice(["insert", "insert", "delete", "revise"]), rng.choice(["a", "b", None]), rng.choice(["en", None]), "v1", rng.choice([None, 5, 70]), rng.choice([None, 3]), 9) for _ in range(60)]
        rows += rows[:5]
        seen += rows
        df = spark.createDataFrame(rows, CHANGES)
        assert rollup.commit(f"b{b}", df) and not rollup.commit(f"b{b}", df)
        assert totals(rollup) == ledger(seen)
        if b in (1, 3):
            rollup.compact()
            assert totals(rollup) == ledger(seen) and not rollup.commit("b0", df)
    assert rollup.commit("empty", spark.createDataFrame([], CHANGES)) and totals(rollup) == ledger(seen)
    assert names(rollup) == {*(f"b{b}" for b in range(5)), "empty"}


def test_a_failed_batch_changes_nothing_and_can_come_again(spark, tmp_path):
    rollup = tc.Rollup(spark, f"file://{tmp_path}/r")
    bad = spark.createDataFrame([("insert", "a", "en", "v1", 5, None, 1), ("upsert", "a", "en", "v1", 5, None, 1)], CHANGES)
    with pytest.raises(Exception, match="unknown op"):
        rollup.commit("b", bad)
    assert totals(rollup) == {}
    # a writer that died left files without a marker
    os.makedirs(tmp_path / "r/batches/b", exist_ok=True)
    assert rollup.commit("b", bad.where("op = 'insert'")) and totals(rollup) == {("a", "en", "v1"): (1, 5)}


def test_parts_add_up_to_the_whole_text(spark):
    rng = random.Random(2)
    count = tokenizer()
    texts = [None, "", " ", "a" * 3000, " \n ".join(rng.choice(["word", "Ünï", "x1", "日本", "..", "  "]) for _ in range(2000)), "<|endoftext|> no special token"]
    assert [sum(count(p) for p in tc.parts(t or "", 100)) for t in texts] == [count(t) for t in texts]
    assert "".join(tc.parts(texts[4], 50)) == texts[4]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(tc.counter()(F.col("text"))).collect()] == [count(t) for t in texts]


def test_query_against_plain_totals(spark, sf):
    count = tokenizer()
    docs = table(spark, sf, "documents").collect()
    first = {}
    for r in docs:
        key = (r["source"] is not None, r["source"], r["lang"] is not None, r["lang"], r["doc_id"])
        first[r["text"] or ""] = min(first.get(r["text"] or "", key), key)
    want: dict = {}
    for source, lang, text in {(k[1], k[3], t) for t, k in first.items()}:
        n, m = want.get((source, lang), (0, 0))
        want[source, lang] = n + 1, m + count(text)
    got = {(r["source"], r["lang"]): (r["documents"], r["tokens"]) for r in tc.query(spark, sf).collect()}
    assert got == want


def test_a_batch_that_comes_while_another_process_compacts_counts_once(spark, tmp_path, monkeypatch):
    rollup = tc.Rollup(spark, f"file://{tmp_path}/r")
    one = lambda n: spark.createDataFrame([("insert", "a", "en", "v1", n, None, 1)], CHANGES)
    rollup.commit("b0", one(5))
    state = rollup._state

    def late():
        found = state()
        tc.Rollup(spark, f"file://{tmp_path}/r").commit("b1", one(7))
        return found

    monkeypatch.setattr(rollup, "_state", late)
    rollup.compact()
    monkeypatch.undo()
    assert totals(rollup) == {("a", "en", "v1"): (2, 12)} and names(rollup) == {"b0", "b1"}


def test_the_later_of_two_writers_of_one_name_loses(spark, tmp_path, monkeypatch):
    first, second = (tc.Rollup(spark, f"file://{tmp_path}/r") for _ in range(2))
    one = lambda n: spark.createDataFrame([("insert", "a", "en", "v1", n, None, 1)], CHANGES)
    answers = iter([False, False])
    known = second.committed
    monkeypatch.setattr(second, "committed", lambda b: next(answers, None) is not False and known(b))
    assert first.commit("b", one(5)) and not second.commit("b", one(7))
    assert totals(first) == {("a", "en", "v1"): (1, 5)}


def test_query_on_an_empty_table(spark, sf, tmp_path):
    table(spark, sf, "documents").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert tc.query(spark, str(tmp_path)).collect() == []


def test_a_batch_that_cannot_be_moved_is_not_committed(spark, tmp_path, monkeypatch):
    rollup = tc.Rollup(spark, f"file://{tmp_path}/r")
    df = spark.createDataFrame([("insert", "a", "en", "v1", 5, None, 1)], CHANGES)

    class Store:
        def rename(self, a, b):
            return False

        def __getattr__(self, name):
            return getattr(real, name)

    real = rollup._fs
    monkeypatch.setattr(rollup, "_fs", Store())
    with pytest.raises(OSError, match="could not be moved"):
        rollup.commit("b", df)
    monkeypatch.undo()
    assert totals(rollup) == {} and not rollup.committed("b") and not os.listdir(tmp_path / "r/pending")
    assert rollup.commit("b", df) and totals(rollup) == {("a", "en", "v1"): (1, 5)}


def test_words_add_up_to_the_whole_text(spark, monkeypatch):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tc.TOKENIZERS}/{tc.VOCABULARY}")
    t.encode_special_tokens = True
    texts = ["", " ", "a", " a  b ", "it 's 'll a.b . c", "x  y z", "<|endoftext|> a <|endoftext|>", "a\x1c \x1fb", "Grüße, ça va ? \n\n  ja", "日本 語 a", "w " * 300 + "z" * 300, "1 2 $ 3%"]
    whole = [len(t.encode(x, add_special_tokens=False).ids) for x in texts]
    assert [sum(len(t.encode(w, add_special_tokens=False).ids) for w in tc.words(x)) for x in texts] == whole
    assert all("".join(tc.words(x)) == x for x in texts) and len(tc.words("a b. c")) == 3
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    assert [r[0] for r in df.select(tc.counter()(F.col("text"))).collect()] == whole
