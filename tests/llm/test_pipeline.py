"""Every stage of the pipeline against a plain version, on what the stage before it kept."""

import os
import sys
from collections import Counter

import pytest

import corpus_pipeline
from haulcast.llm import mixing, quality

sys.path.insert(0, os.path.dirname(__file__))
from test_mixing import words  # noqa: E402
from test_near_dedup import brute  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before and after each stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF)
        rows = after.collect()
        out[name] = docs.collect(), rows
        docs = spark.createDataFrame(rows, after.schema)
    return out


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "source_mix", "packing"]


def test_quality(spark, stages):
    before, after = stages["quality"]
    model = quality.fit_quality(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert Counter(after) == Counter(r for r in before if model.of(r.text) >= 0.3)
    assert len(after) < len(before)


def test_exact(stages):
    before, after = stages["exact_dedup"]
    best = {}
    for r in before:
        key = (r.text or "").encode().lower()
        best[key] = max(best.get(key, r), r, key=lambda x: x.doc_id)
    assert Counter(after) == Counter(best.values())


def test_near(stages):
    before, after = stages["near_dedup"]
    groups = brute([(r.doc_id, r.text) for r in before], corpus_pipeline.NEAR_PERCENT)
    assert Counter(after) == Counter(r for r in before if groups[r.doc_id][1] == r.doc_id)


def test_mix(stages):
    before, after = stages["source_mix"]
    size = {r.doc_id: len(words(r.text)) for r in before}
    text = {r.doc_id: r.text for r in before}
    taken, by_source, sizes = Counter(), Counter(), Counter()
    for r in before:
        sizes[r.source] += size[r.doc_id]
    for r in after:
        assert r.text in text[r.doc_id] and r.n_chars == len(r.text)
        taken[r.doc_id] += len(words(r.text))
        by_source[r.source] += len(words(r.text))
    assert all(taken[d] <= 2 * n for d, n in size.items())
    names = sorted(sizes)
    targets = mixing.water_fill([sizes[s] for s in names], [(3, 1, 2)[k % 3] for k in range(len(names))])
    assert all(abs(by_source[s] - t) <= mixing.BLOCK_WORDS for s, t in zip(names, targets))


def test_packing(stages):
    before, after = stages["packing"]
    tokens = {}
    for r in after:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
    assert set(tokens) == {r.doc_id for r in before}
    # ids repeat after mixing, so pieces are checked on documents with one text
    once = {d for d, n in Counter(r.doc_id for r in before).items() if n == 1}
    sequences = {}
    for r in after:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    whole = [r for r in before if r.doc_id in once]
    assert all(tokens[r.doc_id] > 1 for r in whole if words(r.text))


def test_whole_run(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == len(stages["packing"][1])


HELPERS = ("_digest _maybe _word _bits _row_word _did _thash _row _spans _doc _part _s _block _length _taken _key c0 c1 w t fp key "
           "comp band n size").split()


def test_clashing_columns_pass_through(spark):
    """Columns named like any helper come out of the document stages as they went in."""
    base = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    texts = base.selectExpr("*", *[f"concat('{h}', doc_id) AS {h}" for h in HELPERS])
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stages = [corpus_pipeline.exact_duplicates, corpus_pipeline.near_duplicates, corpus_pipeline.source_mix]
    for stage in [lambda s, d, f: quality.keep_good(d, quality.fit_quality(d, labels)), *stages]:
        kept = stage(spark, texts, SF)
        rows = kept.collect()
        assert kept.columns == texts.columns and rows
        assert all(r[h] == f"{h}{r.doc_id}" for r in rows for h in HELPERS)


@pytest.mark.parametrize("data", [
    [], [(7, "one two three", "en", "a", 13)],
    [(None, None, None, None, None), (1, "", "en", None, 0), (1, "a b c d e f", "en", "x", 11), (1, "a b c d e f", "en", "x", 11),
     (2, "word " * 30_000, None, "y", 150_000), (3, "A B c d e f", "de", "x", 11)]])
def test_edge_tables_run_through(spark, tmp_path, data):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert bool(pieces) == bool(data) and all(0 < p.length <= 2048 for p in pieces)
