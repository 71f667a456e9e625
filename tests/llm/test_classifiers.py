"""Quality and toxicity: plain versions, held-out accuracy, odd rows."""

import math
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lorespark.llm import quality, toxicity
from lorespark.llm.shared import table

BIG = "/root/testdata/sf0.1"


def plain_ftrl(rows, labels, alpha, beta, l1, epochs):
    """One coordinate at a time, in dictionaries."""
    z, n, zb, nb = {}, {}, 0.0, 0.0

    def weight(i):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha)

    for _ in range(epochs):
        for x, y in zip(rows, labels, strict=True):
            bias = -zb / ((beta + math.sqrt(nb)) / alpha)
            w = {i: weight(i) for i in x}
            g = 1 / (1 + math.exp(-(sum(w.values()) + bias))) - y
            for i in x:
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / alpha * bias
            nb += g * g
    return {i: weight(i) for i in z if weight(i)}, -zb / ((beta + math.sqrt(nb)) / alpha)


def test_ftrl_matches_plain_version():
    rng = random.Random(2)
    rows = [np.unique(np.array([rng.randrange(60) for _ in range(9)], np.int32)) for _ in range(150)]
    y = np.array([float(3 in x or rng.random() < 0.1) for x in rows])
    got = toxicity.fit(rows, y, bits=10, epochs=2, alpha=0.7, beta=1.0, l1=0.5)
    want, bias = plain_ftrl([x.tolist() for x in rows], y, 0.7, 1.0, 0.5, 2)
    assert dict(zip(got.index.tolist(), got.weight.tolist(), strict=True)) == pytest.approx(want, rel=1e-4, abs=1e-6)
    assert got.bias == pytest.approx(bias) and 0 < len(got.index) < 60


def test_features_are_words_pairs_and_skips():
    count = lambda t: len(toxicity.features(t))
    assert [count(t) for t in (None, "", "a", "a b", "a b c", "a a a")] == [0, 0, 1, 3, 6, 3]
    assert np.intersect1d(toxicity.features("you x fool"), toxicity.features("you y fool")).size == 3


def auc(y, s):
    rank = pd.Series(s).rank().to_numpy()
    p, q = y.sum(), (1 - y).sum()
    return (rank[y == 1].sum() - p * (p + 1) / 2) / (p * q)


@pytest.mark.parametrize(("module", "label", "least", "recall", "wrong"), [(quality, "quality", 0.98, 0.97, 0.1), (toxicity, "toxic", 0.96, 0.8, 0.01)])
def test_held_out_accuracy(spark, module, label, least, recall, wrong):
    got = module.query(spark, BIG)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    known = got.join(table(spark, BIG, "labels").select("doc_id", label), "doc_id").where("held_out").toPandas()
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in known["doc_id"])
    y = known[label].to_numpy()
    assert known["score"].between(0, 1).all()
    assert auc(y, known["score"]) >= least
    assert known["predicted"][y == 1].mean() >= recall
    assert known["predicted"][y == 0].mean() <= wrong


@pytest.mark.parametrize("module", [quality, toxicity])
def test_held_out_labels_and_other_columns_are_no_inputs(spark, module):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    labels = table(spark, "/root/testdata/sf0.001", "labels")
    turned = labels.select("doc_id", *[F.when(toxicity.fold(F.col("doc_id")) == 0, 1 - F.col(c)).otherwise(F.col(c)).alias(c) for c in ("quality", "toxic")])
    other = docs.withColumns({"lang": F.lit("zz"), "source": F.lit("s"), "n_chars": F.lit(1)})
    a, b = (module.score(d, module.train(d, x)).select("doc_id", "score").orderBy("doc_id").collect() for d, x in ((docs, labels), (other, turned)))
    assert a == b


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_rows(spark, module):
    text = "good words of a fine text " * 30
    rows = [(1, text, "x", 0.5), (2, None, "x", None), (3, "", None, 1.0), (4, " \n\t", "x", 2.0), (None, text, "x", 3.0), (1, text, "x", 0.5), (5, "w" * 2_000_000, "x", 1.0), (6, "a é " * 400_000, "x", 1.0), (7, "\x00�", "x", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string, score double")
    label = "quality" if module is quality else "toxic"
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (6, 0, 0), (None, 1, 1), (3, None, None), (7, 0, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = module.score(docs, module.train(docs, labels))
    assert got.columns == ["doc_id", "text", "_id", "score"]
    found = got.select("doc_id", "score").collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    assert len({r["score"] for r in found if r["doc_id"] in (1, None)}) == 1
    assert len({r["score"] for r in found if r["doc_id"] in (2, 3)}) == 1
    # no labels, one label only, no documents
    assert {r["score"] for r in module.score(docs, module.train(docs, labels.limit(0))).collect()} == {0.5}
    ones = labels.select("doc_id", F.lit(1).alias(label))
    assert len({r["score"] for r in module.score(docs, module.train(docs, ones)).collect()}) == 1
    assert module.score(docs.limit(0), module.train(docs.limit(0), labels)).count() == 0


def test_running_softmax_matches_the_whole_bag():
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcdefg.É1") for _ in range(rng.randrange(1, 9))) for _ in range(130_000))
    blocks = list(quality.passage_vectors(text))
    assert len(blocks) > 1
    model = quality.Model().fit([b[:5] for b in blocks] * 4, np.array([0.0, 1.0] * 2 * len(blocks)), epochs=2)
    h, _, _, e = model.encode((np.concatenate(blocks) - model.mean) * model.scale)
    a = np.exp(e - e.max())
    want = 1 / (1 + np.exp(-((a / a.sum()) @ h @ model.p["c"] + model.p["d"][0])))
    assert model.score(text) == pytest.approx(want, rel=1e-5)


def test_attention_finds_the_deciding_passage():
    rng = np.random.default_rng(0)
    bags, y = [], []
    for k in range(400):
        x = rng.normal(0, 1, (rng.integers(2, 8), quality.WIDTH)).astype(np.float32)
        if k % 2:
            x[rng.integers(len(x)), :8] += 3
        bags.append(x)
        y.append(float(k % 2))
    model = quality.Model().fit(bags[:300], np.array(y[:300]))
    hits = 0
    for x, want in zip(bags[300:], y[300:], strict=True):
        h, _, _, e = model.encode((x - model.mean) * model.scale)
        a = np.exp(e - e.max())
        p = 1 / (1 + np.exp(-((a / a.sum()) @ h @ model.p["c"] + model.p["d"][0])))
        hits += (p >= 0.5) == want
    assert hits >= 90


def test_the_learner_sees_every_passage_of_a_long_text(spark):
    plain_, deciding = "the quiet river runs along the old stone wall ", "zq9x ##7! zq9x ##7! kk0 "
    far = plain_ * 150 + deciding * 20 + plain_ * 150
    x = quality.train_vectors(far)
    assert len(x) == sum(len(v) for v in quality.passage_vectors(far)) > 25
    assert abs(x - quality.train_vectors(plain_ * 300)[: len(x)].mean(0)).max() > 0.2
    docs = spark.createDataFrame([(i, (far if i % 2 else plain_ * 320) + str(i)) for i in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert min(s for i, s in scores.items() if i % 2) > max(s for i, s in scores.items() if not i % 2)


def test_the_sample_ends_at_the_first_document_that_does_not_fit(spark):
    assert [quality.fitting([3, 50, 4, 2, 9], n) for n in (2, 3, 52, 53, 68, 100)] == [0, 1, 1, 2, 5, 5]
    docs = spark.createDataFrame([(i, "some words " * (10 + 400 * (i % 5 == 0)) + str(i)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    order = [r["doc_id"] for r in toxicity.labelled(docs, labels, "toxic", 100).orderBy("rank", "doc_id").collect()]
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    total, first = 0, []
    for i in order:
        total += len(toxicity.features(text[i]))
        if total > 400:
            break
        first.append(i)
    assert 0 < len(first) < len(order)
    want = toxicity.fit([toxicity.features(text[i]) for i in first], np.array([float(i % 2) for i in first]))
    got = toxicity.train(docs, labels, coordinates=400)
    assert got.bias == want.bias and (got.index == want.index).all() and (got.weight == want.weight).all()


def test_gradients_by_finite_differences():
    rng = np.random.default_rng(3)
    model = quality.Model()
    bags = [rng.normal(0, 1, (n, quality.WIDTH)) for n in (1, 4, 2)]
    y = np.array([0.0, 1.0, 1.0])

    def loss():
        out = 0.0
        for x, want in zip(bags, y, strict=True):
            h, _, _, e = model.encode(x)
            a = np.exp(e - e.max())
            q = 1 / (1 + np.exp(-((a / a.sum()) @ h @ model.p["c"] + model.p["d"][0])))
            out -= np.log(q if want else 1 - q) / len(bags)
        return out

    grads = model.gradients(bags, y)
    for k, p in model.p.items():
        for at in {tuple(rng.integers(0, n) for n in p.shape) for _ in range(8)}:
            old = p[at]
            p[at] = old + 1e-5
            up = loss()
            p[at] = old - 1e-5
            down = loss()
            p[at] = old
            assert grads[k][at] == pytest.approx((up - down) / 2e-5, rel=1e-4, abs=1e-9)
