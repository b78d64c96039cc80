"""Toxicity scores: held-out accuracy, unseen word endings, edge rows, independence of labels and language."""

import os
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from haulcast.llm import toxicity

sys.path.insert(0, os.path.dirname(__file__))
from learning import auc  # noqa: E402

SF = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def model(tables):
    return toxicity.fit_toxicity(*tables)


def test_held_out_accuracy(tables, model):
    docs, labels = tables
    scored = toxicity.score_toxicity(docs, model)
    assert scored.columns == ["doc_id", "held_out", "score", "predicted", "lang_threshold", "toxic"]
    assert scored.count() == docs.count()
    rows = scored.join(labels.withColumnRenamed("toxic", "label"), "doc_id").filter("held_out").collect()
    assert auc([r.label for r in rows], [r.score for r in rows]) > 0.8
    assert np.mean([r.predicted for r in rows if r.label == 0]) < 0.03


def test_language_and_held_out_labels_change_nothing(tables, model):
    docs, labels = tables
    other = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.fit_toxicity(docs, other)
    assert (again.net.output == model.net.output).all() and again.share == model.share
    score = lambda d: {r.doc_id: r.score for r in toxicity.score_toxicity(d, model).collect()}
    assert score(docs.withColumn("lang", F.lit("xx"))) == score(docs)


def test_planted_words_with_unseen_endings():
    rng = np.random.default_rng(0)
    plain = lambda n: [f"{a}{b}" for a, b in zip(rng.choice(list("bcdfg"), n), rng.integers(0, 400, n))]
    texts, labels, langs = [], [], []
    for k in range(600):
        words = plain(60)
        if k % 3 == 0:
            words[int(rng.integers(60))] = f"nasty{rng.integers(10_000)}"
        texts.append(" ".join(words))
        labels.append(int(k % 3 == 0))
        langs.append("en" if k % 2 else None)
    model = toxicity.fit_toxicity_texts(texts, labels, langs, 1 / 3)
    scorer = toxicity.Scorer(model.net)
    bad, good = model.probability([scorer.logit(" ".join([*plain(200), "Nastyfresh", *plain(200)])), scorer.logit(" ".join(plain(400)))])
    assert bad > 0.5 > good


def test_scorer_forgets_and_chunks(model, monkeypatch):
    text = " ".join(f"word{k % 900} idiot" for k in range(3_000))
    whole = toxicity.Scorer(model.net).logit(text)
    monkeypatch.setattr(toxicity, "_CHUNK", 50)
    monkeypatch.setattr(toxicity, "_CACHED_WORDS", 60)
    assert toxicity.Scorer(model.net).logit(text) == pytest.approx(whole, abs=1e-4)


def test_thresholds():
    score = np.array([0.1] * 98 + [0.6, 0.95] + [0.9])
    got = toxicity.language_thresholds(score, np.array([0] * 100 + [1]), ["en"] * 101, 0.01)
    assert got == {"en": pytest.approx(0.6, abs=1e-4)}
    assert toxicity.language_thresholds(score[:10], np.zeros(10), [None] * 10) == {}


def test_edges(spark, model):
    texts = {1: None, 2: "", 3: "the " * 100_000, 4: "\x00\n!", 5: "ü"}
    docs = spark.createDataFrame([(k, t, None, 1.0) for k, t in texts.items()], "doc_id long, text string, lang string, score double")
    rows = {r.doc_id: r for r in toxicity.score_toxicity(docs.unionAll(docs), model).collect()}
    assert rows[1].score == rows[2].score == rows[4].score and rows[1].lang_threshold == 0.5
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_few_or_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b", "en"), (2, "c d", "en"), (None, "e", None)], "doc_id long, text string, lang string")
    for labels, score in (([], 0.0), ([(1, 1, 1), (2, 1, 1), (None, 0, 0), (2, None, None)], 1.0)):
        fitted = toxicity.fit_toxicity(docs, spark.createDataFrame(labels, LABELS))
        assert {r.score for r in toxicity.score_toxicity(docs, fitted).collect()} == {score}
    empty = docs.filter("doc_id > 9")
    assert toxicity.score_toxicity(empty, toxicity.fit_toxicity(empty, spark.createDataFrame([], LABELS))).count() == 0
