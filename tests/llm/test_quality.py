"""Quality scores: held-out accuracy, edge rows, independence of labels."""

import os
import sys
import zlib

import pytest
from pyspark.sql import functions as F

from haulcast.llm import quality

sys.path.insert(0, os.path.dirname(__file__))
from learning import auc  # noqa: E402

SF = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def model(tables):
    return quality.fit_quality(*tables)


def test_held_out_accuracy(tables, model):
    docs, labels = tables
    scored = quality.score_quality(docs, model)
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"] and scored.count() == docs.count()
    rows = scored.join(labels, "doc_id").filter("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    assert auc([r.quality for r in rows], [r.score for r in rows]) > 0.93
    good = [r.predicted for r in rows if r.quality == 1]
    assert sum(good) / len(good) > 0.97


def test_learns_from_the_other_folds_only(tables, model):
    docs, labels = tables
    hidden = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.fit_quality(docs, hidden) == model


def test_edges(spark, model):
    texts = {1: None, 2: "", 3: "the " * 100_000, 4: "\x00\n", 5: "ü"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("*", "1 as score", "'x' as held_out")
    rows = {r.doc_id: r for r in quality.score_quality(docs.unionAll(docs), model).collect()}
    assert rows[1].score == rows[2].score == model.share
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert quality.keep_good(docs, model).columns == docs.columns


def test_few_or_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d"), (None, "e")], "doc_id long, text string")
    for labels, score in (([], 0.5), ([(1, 1, 0), (2, 1, 0), (None, 0, 0), (2, None, 1)], 1.0)):
        fitted = quality.fit_quality(docs, spark.createDataFrame(labels, LABELS))
        assert {r.score for r in quality.score_quality(docs, fitted).collect()} == {score}
    empty = docs.filter("doc_id > 9")
    assert quality.score_quality(empty, quality.fit_quality(empty, spark.createDataFrame([], LABELS))).count() == 0
