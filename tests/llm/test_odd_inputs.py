"""A slow dense fit of the classifier, bounds that hold with repeated ids, clashing columns in stages, very long texts."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as pipe
from provark.llm import ngram_join, quality, secret_scan


def dense_fit(x, grades, n_grades, epochs, rate, l1, balance):
    """The same descent over a dense matrix, its gradient by central differences of the likelihood."""
    n, k = x.shape
    share = (n / (n_grades * np.maximum(np.bincount(grades, minlength=n_grades), 1)))[grades] ** balance

    def loss(p):
        cuts = np.concatenate([p[k : k + 1], p[k] + np.cumsum(np.exp(p[k + 1 :]))])
        edge = np.concatenate([[-40.0], cuts, [40.0]])
        at = lambda c: 1 / (1 + np.exp(-np.clip(c - x @ p[:k], -40, 40)))
        return float(np.mean(-np.log(np.maximum(at(edge[grades + 1]) - at(edge[grades]), 1e-9)) * share))

    p = np.concatenate([np.zeros(k), [-1.0], np.full(n_grades - 2, np.log(2 / (n_grades - 2)))])
    past = np.full(len(p), 1e-6)
    for _ in range(epochs):
        g = np.array([(loss(p + d) - loss(p - d)) / 2e-5 for d in np.eye(len(p)) * 1e-5])
        past += g * g
        step = rate / np.sqrt(past)
        p = p - step * g
        p[:k] = np.sign(p[:k]) * np.maximum(0, np.abs(p[:k]) - step[:k] * l1 / np.sqrt(n))
    return p[:k], np.concatenate([p[k : k + 1], p[k] + np.cumsum(np.exp(p[k + 1 :]))])


def test_sparse_fit_equals_a_dense_one():
    rng = np.random.default_rng(12)
    for n_grades, balance in ((3, 0.0), (4, 0.5)):
        x = (rng.random((80, 9)) < 0.4).astype(float)
        grades = np.clip((x @ np.linspace(-1, 1, 9) + rng.normal(0, 0.5, 80) + 1.2).astype(int), 0, n_grades - 1)
        model = quality.fit([np.flatnonzero(r) * 11 for r in x], grades, n_grades, epochs=40, rate=0.3, l1=0.03, balance=balance, least_docs=1)
        weights, cuts = dense_fit(x, grades, n_grades, 40, 0.3, 0.03, balance)
        assert np.allclose(model.weights[np.arange(9) * 11], weights, atol=2e-3) and np.allclose(model.cuts, cuts, atol=2e-3)
        score = x @ weights
        dense = np.array([[1 / (1 + np.exp(-(c - s))) for c in cuts] for s in score])
        own = quality.OrdinalModel(model.weights, model.cuts)
        assert np.allclose(own.expected(x @ model.weights[np.arange(9) * 11]), (1 - dense).sum(1), atol=1e-2)
        assert np.allclose(own.tail(x @ model.weights[np.arange(9) * 11], n_grades - 1), 1 - dense[:, n_grades - 2], atol=1e-2)


def test_repeated_ids_stay_within_the_bound(spark, monkeypatch):
    seen, fit = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda rows, *a, **k: (seen.append(len(rows)), fit(rows, *a, **k))[1])
    docs = spark.createDataFrame([(i % 2, f"word{i} and more") for i in range(400)], "doc_id long, text string")
    ratings = spark.createDataFrame([(0, 2), (1, 0), (2, 1)], "doc_id long, grade int")
    quality.train(docs, ratings, max_rows=2)
    quality.train(docs, ratings)
    assert seen[0] <= 2 and seen[1] == 2


def test_stages_with_clashing_and_missing_columns(spark, tmp_path):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, words, 5, "a"), (2, words + " ", 6, "b"), (3, words + " more", 7, "c"), (None, "password: hunter22hunter", 8, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_key int, ROW_KEY_ string").withColumn("group", F.lit(1)).withColumn("rank", F.lit("x"))
    exact = pipe.drop_copies(spark, docs, str(tmp_path))
    assert exact.columns == docs.columns and sorted(r.row_key for r in exact.collect()) == [6, 7, 8]
    near = pipe.drop_near_copies(spark, docs, str(tmp_path))
    assert near.columns == docs.columns and sorted(r.row_key for r in near.collect()) == [5, 8]
    masked = pipe.mask_secrets(spark, docs, str(tmp_path))
    assert masked.columns == docs.columns and not any("hunter22" in r.text for r in masked.collect())


def test_a_block_of_very_long_texts(spark):
    rnd = random.Random(3)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(60_000)]
    docs = []
    for i in range(10):
        own = list(base) if i % 2 else [f"v{rnd.randrange(10**6)}" for _ in range(60_000)]
        for _ in range(200):
            own[rnd.randrange(len(own))] = "changed"
        docs.append((i, " ".join(own)))
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_components(spark.createDataFrame(docs, "doc_id long, text string"), k=3, percent=90).collect()}
    assert got == {i: 1 if i % 2 else i for i in range(10)}


def test_a_very_long_text_is_masked(spark):
    text = "plain words " * 100_000 + "password: hunter22hunter" + " more words" * 100_000 + " token=abcdef123456"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (row,) = secret_scan.redact(docs).collect()
    assert "hunter22" not in row.text and "abcdef123456" not in row.text and row.text.startswith("plain words plain")
