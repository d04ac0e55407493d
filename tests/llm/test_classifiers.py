import zlib

import numpy as np
from forumlens.llm import ftrl, quality_classifier, queries, toxicity
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_ftrl_learns_what_plain_updates_learn():
    model = ftrl.FTRL(4, alpha=0.5, beta=1.0, l1=0.0, l2=0.0)
    w, n = np.zeros(4), np.zeros(4)
    rng = np.random.default_rng(0)
    for _ in range(200):
        index = rng.choice(4, 2, replace=False)
        value, label = np.array([1.0, 0.5]), int(rng.random() < 0.5 or 0 in index)
        # without L1 and L2 the closed form equals per-coordinate gradient steps
        z, m = model.z.copy(), model.n.copy()
        before = model._solve(z, m)
        g = (ftrl.sigmoid(before[index] @ value) - label) * value
        model.learn(index, value, label)
        assert np.allclose(model.n[index], m[index] + g * g)
    assert model.weights()[0] > max(model.weights()[1:])


def test_l1_gives_zeros():
    model = ftrl.FTRL(3, alpha=0.5, beta=1.0, l1=50.0, l2=0.0)
    model.learn(np.array([0, 2]), np.ones(2), 1)
    assert not model.weights().any()


def _held_out(spark, name, label):
    rows = {r.doc_id: r for r in queries.QUERIES[name](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    assert all(0 <= r.score <= 1 for r in rows.values())
    truth = spark.read.parquet(f"{SF}/labels.parquet").collect()
    return [(rows[t.doc_id].predicted, t[label]) for t in truth if rows[t.doc_id].held_out]


def test_held_out_quality(spark):
    pairs = _held_out(spark, "op2_quality_classifier", "quality")
    assert sum(p == y for p, y in pairs) / len(pairs) >= 0.95


def test_held_out_toxicity(spark):
    pairs = _held_out(spark, "op4_toxicity", "toxic")
    assert sum(p == y for p, y in pairs) / len(pairs) >= 0.9


def test_edges(spark):
    docs = spark.createDataFrame(
        [(1, None, 9.0), (2, "", 9.0), (None, "good words here", 9.0), (3, "bad " * 5000, 9.0), (3, "x", 9.0)],
        "doc_id long, text string, score double",
    )
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    for module in (quality_classifier, toxicity):
        w = module.fit(docs, none, F.lit(True), label="quality")
        scores = [r.s for r in docs.select(module.score(spark, F.col("text"), w).alias("s")).collect()]
        empty = 0.0 if module is quality_classifier else 0.5
        assert scores == [empty, empty, 0.5, 0.5, 0.5]
        empty = docs.limit(0)
        assert empty.select(module.score(spark, F.col("text"), w).alias("s")).count() == 0
    both = spark.createDataFrame([(2, 1), (3, 0), (3, 0)], "doc_id long, toxic int")
    assert toxicity.fit(docs, both, F.lit(True)) is not None


def test_scores_are_plain_dot_products():
    texts = ["One two, two!! three", "", "One"]
    weights = np.random.default_rng(1).normal(size=1 << quality_classifier.BITS).astype(np.float32)
    index, value, at = quality_classifier.features(texts)
    for i, s in enumerate(quality_classifier.score_texts(texts, weights)):
        if not texts[i]:  # no words, no quality
            assert s == 0
            continue
        assert np.isclose(s, ftrl.sigmoid(float(weights[index[at == i]] @ value[at == i])), atol=1e-5)
    dense = np.where(np.random.default_rng(2).random(1 << toxicity.BITS) < 0.5, 0, 0.7).astype(np.float32)
    index, value, at = toxicity.features(texts)
    for i, s in enumerate(toxicity.Weights(dense).score(texts)):
        assert np.isclose(s, ftrl.sigmoid(float(dense[index[at == i]] @ value[at == i])), atol=1e-5)


def test_copies_of_an_id_count_once(spark):
    rows = [(1, "the first text")] * 300 + [(1, "another text"), (2, "more words"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1)], "doc_id long, quality int")
    got = ftrl.training_rows(docs, labels, "quality", "doc_id", "text", F.lit(True), 10).collect()
    assert sorted((r.id, r.text, r.label) for r in got) == [(1, "another text", 1), (2, None, 0)]
