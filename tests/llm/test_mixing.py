"""Mixing: targets, quotas, the limit of use, permutations, and texts."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from haulcast.llm import mixing

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, target string"


def words(text):
    return re.findall(mixing.WORD, text or "")


@pytest.mark.parametrize("shard_slots", [50, 1 << 16])
def test_whole_table(spark, shard_slots):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: (r.source, len(words(r.text))) for r in docs.collect()}
    got = mixing.mixed_sizes(docs, shard_slots=shard_slots).collect()
    assert {r.doc_id: r.size for r in got} == {d: n for d, (_, n) in texts.items()}
    sizes, taken, targets = Counter(), Counter(), {}
    for r in got:
        source = texts[r.doc_id][0]
        assert 0 <= r.taken <= 2 * r.size
        sizes[source] += r.size
        taken[source] += r.taken
        targets[source] = r.target
    names = sorted(sizes)
    want = mixing.water_fill([sizes[s] for s in names], [(3, 1, 2)[k % 3] for k in range(len(names))])
    for s, target in zip(names, want):
        assert targets[s] == pytest.approx(target)
        assert abs(taken[s] - target) <= mixing.BLOCK_WORDS
    again = mixing.mixed_sizes(docs.repartition(5), shard_slots=shard_slots)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got))


def test_targets():
    sizes = [100, 1000, 10, 0, 500]
    got = mixing.water_fill(sizes, [3, 1, 2, 3, 1])
    assert got.sum() == pytest.approx(1.5 * sum(sizes)) and (got <= 2 * np.array(sizes) + 1e-9).all()
    assert got[0] == 200 and got[2] == 20 and got[3] == 0 and got[4] == 1000 and got[1] == pytest.approx(1195)


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 16, 17, 63, 64, 65, 1000])
def test_permutation(size):
    for seed in range(3):
        got = mixing.permuted(np.arange(size), np.full(size, size), np.full(size, seed))
        assert sorted(got) == list(range(size))


def test_runs():
    assert mixing.runs([(0, 5), (5, 5), (20, 3), (0, 5), (5, 5)]) == [(0, 10), (0, 10), (20, 23)]


def test_mixed_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("_extra", F.lit(1))
    taken = {r.doc_id: r.taken for r in mixing.mixed_sizes(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = defaultdict(int)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    for r in mixed.collect():
        assert r.text in texts[r.doc_id] and r.n_chars == len(r.text)
        got[r.doc_id] += len(words(r.text))
    assert got == {d: n for d, n in taken.items() if n}


def test_edges(spark):
    data = [(1, None, "x", "a", 0, 1, "t"), (2, "", None, None, 0, 1, "t"), (None, "w " * 30_000, None, None, 0, 1, "t"),
            (4, "one two", None, "a", 0, 1, "t"), (4, "one two", None, "a", 0, 1, "t"), (5, "three", None, "é", 0, 1, "t")]
    docs = spark.createDataFrame(data, SCHEMA)
    got = mixing.mixed_sizes(docs).collect()
    assert len(got) == 6 and sum(r.size for r in got) == 30_005
    assert all(r.taken <= 2 * r.size for r in got)
    assert {r.source_size for r in got if r.doc_id in (1, 4)} == {4}
    assert mixing.mixed_documents(docs).columns == docs.columns
    none = spark.createDataFrame([], SCHEMA)
    assert mixing.mixed_sizes(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    blank = spark.createDataFrame(data[:2], SCHEMA)
    assert [r.taken for r in mixing.mixed_sizes(blank).collect()] == [0, 0]


def test_small_batches(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted(map(tuple, mixing.mixed_sizes(docs).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(tuple, mixing.mixed_sizes(docs).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_inverse_permutation():
    for size in (1, 2, 5, 64, 1000):
        for seed in (0, 9, 2**40):
            places = mixing.permuted(np.arange(size), size, seed)
            assert (mixing.permuted(places, size, seed, back=True) == np.arange(size)).all()


@pytest.mark.parametrize("size, target", [(130, 108), (129, 216), (201, 167), (1, 2), (5, 7), (64, 100), (6_401, 9_000), (70, 3)])
def test_words_drawn_come_near_the_target(size, target):
    """Half a block from the target at most, whichever pass draws the short last block."""
    for seed in range(20):
        sources = mixing.Sources.of(["0a"], [size], [1], target / size, 2, mixing.BLOCK_WORDS, seed)
        block, blocks, slots = (int(x[0]) for x in (sources.block, sources.blocks, sources.slots))
        words = 0
        for nth in range(slots):
            at = int(mixing.permuted(nth % blocks, blocks, mixing.pass_seed(seed, 0, nth // blocks))[0])
            words += min(block, size - at * block)
        assert abs(words - min(target, 2 * size)) <= block / 2 and slots <= 2 * blocks
