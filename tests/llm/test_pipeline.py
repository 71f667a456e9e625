"""The corpus pipeline against a plain version of every stage, each on its own input."""

import hashlib
import re
from collections import Counter

import corpus_pipeline
import numpy as np
from lorespark.llm import mixing, near_dup, quality, toxicity
from lorespark.llm.alignment import similar
from lorespark.llm.shared import table
from lorespark.llm.words import word_hashes

from test_decontam import grams
from test_native import plain_targets
from test_near_dup import groups


def stages(spark, sf):
    docs = table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        yield name, docs, out
        docs = spark.createDataFrame(out.collect(), out.schema)


def test_stages_match_plain_versions(spark, sf):
    labels = table(spark, sf, "labels")
    items = table(spark, sf, "benchmark").collect()
    columns = table(spark, sf, "documents").columns
    for name, docs, out in stages(spark, sf):
        before, after = docs.collect(), out.collect()
        ids = sorted(r["doc_id"] for r in after)
        if name != "mix":
            assert out.columns == columns
            assert not Counter(after) - Counter(before)
        if name == "quality":
            model = quality.train(docs, labels)
            assert ids == sorted(r["doc_id"] for r in before if model.score(r["text"]) >= 0.3)
            assert len(ids) >= len(before) * 0.6
        elif name == "toxicity":
            model = toxicity.train(docs, labels)
            w = model.dense()
            assert ids == sorted(r["doc_id"] for r in before if w[toxicity.features(r["text"])].sum() + model.bias < 0)
        elif name == "near_duplicates":
            rows = [(r["doc_id"], (word_hashes(r["text"]) >> np.uint64(32)).astype("<u4")) for r in before]
            worded = [r for r in rows if len(r[1])]
            pairs = [(i, j) for i, a in enumerate(worded) for j, b in enumerate(worded[:i]) if similar(a[1], b[1], near_dup.THRESHOLD)]
            root = groups(len(worded), pairs)
            least = {r: min(worded[i][0] for i in range(len(worded)) if root[i] == r) for r in set(root)}
            assert ids == sorted([*least.values(), *(r[0] for r in rows if not len(r[1]))])
        elif name == "decontamination":
            shingles = [s for s in (grams(x["text"]) for x in items) if s]
            assert ids == sorted(r["doc_id"] for r in before if not any(len(s & grams(r["text"])) >= 0.8 * len(s) - 1e-9 for s in shingles))
        else:
            size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
            totals: Counter = Counter()
            for r in before:
                totals[r["source"]] += size(r["text"])
            targets = plain_targets(dict(totals))
            copies = Counter(r["doc_id"] for r in after)
            for r in before:
                rate = targets[r["source"]] / totals[r["source"]] if totals[r["source"]] else 0
                draw = int(hashlib.md5(f"{mixing.SEED}:{r['doc_id']}".encode()).hexdigest()[:13], 16) / 2**52
                assert copies[r["doc_id"]] == int(rate) + (draw < rate - int(rate))


def test_run_is_the_stages_in_a_row_and_repeats(spark, sf):
    want = None
    for _, _, out in stages(spark, sf):
        want = Counter(out.collect())
    assert Counter(corpus_pipeline.run(spark, sf).collect()) == want


def test_stages_take_empty_tables(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    for name in ("documents", "labels", "benchmark"):
        table(spark, source, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
