"""The threshold and the bands of near deduplication: the stage drops pairs at 0.8, op10 at 0.85."""

import random

import numpy as np
import pytest

import corpus_pipeline
from haulcast.llm import near_dedup

WORDS = 204


def pairs(tails, rng):
    """A text of 200 shingles and its copy with another end, for each number of changed words."""
    texts, seen = [], iter(range(10**9))
    fresh = lambda n: [f"w{next(seen)}" for _ in range(n)]
    for tail in tails:
        base = fresh(WORDS)
        texts += [base, base[: WORDS - tail] + fresh(tail)]
    ids = rng.sample(range(10_000), len(texts))
    return [(d, " ".join(t)) for d, t in zip(ids, texts)]


@pytest.fixture(scope="module")
def docs(spark):
    # similarity (200 - tail) / (200 + tail): 0.852, 0.843, 0.818, 0.802, 0.794
    data = pairs([16, 17, 20, 22, 23] * 12, random.Random(8))
    return spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in data],
                                 "doc_id long, text string, lang string, source string, n_chars int"), data


def dropped(data, percent):
    """The larger id of each pair that is similar enough."""
    out = set()
    for (a, x), (b, y) in zip(data[::2], data[1::2]):
        tail = sum(v != w for v, w in zip(x.split(), y.split()))
        if 100 * (200 - tail) >= percent * (200 + tail):
            out.add(max(a, b))
    return out


def test_stage_drops_at_80(spark, docs):
    table, data = docs
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    after = stage(spark, table, None)
    assert after.columns == table.columns
    assert {d for d, _ in data} - {r.doc_id for r in after.collect()} == dropped(data, 80)
    assert len(dropped(data, 80)) == 48


def test_default_stays_at_85(docs):
    table, data = docs
    groups = near_dedup.near_duplicate_groups(table)
    assert {r.doc_id for r in groups.filter("not kept").collect()} == dropped(data, 85)
    assert len(dropped(data, 85)) == 12


@pytest.mark.parametrize("percent, bands, rows", [
    (near_dedup.PERCENT, near_dedup.BANDS, near_dedup.ROWS),
    (corpus_pipeline.NEAR_PERCENT, corpus_pipeline.NEAR_BANDS, corpus_pipeline.NEAR_ROWS)])
def test_bands_and_batches_keep_the_threshold(percent, bands, rows):
    assert (1 - (percent / 100) ** rows) ** bands < 1.1e-5
    rng, n = np.random.default_rng(6), 20_000
    shape = (n, bands * rows)
    left = rng.integers(0, 256, shape, dtype=np.uint8)
    right = np.where(rng.random(shape) < percent / 100, left, rng.integers(0, 256, shape, dtype=np.uint8))
    assert near_dedup.may_be_similar(left, right, near_dedup.Limits(percent, bands, rows).least()).mean() >= 0.9999
