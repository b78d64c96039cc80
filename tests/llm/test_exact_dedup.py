"""Exact duplicates: edge rows, hot groups, the way beyond the broadcast limit, and a plan without Python."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from haulcast.llm import exact_dedup
from haulcast.operators import keyed

SCHEMA = "doc_id long, text string, digest string, kept int"


def brute(data):
    groups = defaultdict(list)
    for doc_id, text in data:
        groups[(text or "").encode().lower()].append(doc_id)
    out = []
    for text, ids in groups.items():
        largest = max((i for i in ids if i is not None), default=None)
        out += [(i, largest, len(ids), hashlib.sha256(text).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def frame(spark, data):
    return spark.createDataFrame([(i, t, "x", 7) for i, t in data], SCHEMA)


@pytest.mark.parametrize("small", [True, False])
def test_groups(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(exact_dedup, "BROADCAST_WORDS", 0)
        monkeypatch.setattr(keyed, "BROADCAST_KEYS", 2)
        monkeypatch.setattr(keyed, "HOT_KEYS", 5)
    data = [(k, f"text {k % 97}") for k in range(300)] + [(1_000 + k, "Hot TEXT") for k in range(400)]
    data += [(5_000, None), (5_001, ""), (None, "hot text"), (5_002, "É"), (5_003, "é"), (5_004, "long " * 50_000),
             (5_005, "LONG " * 50_000), (6_000, "same"), (6_000, "same"), (None, "alone"), (None, "nobody"), (None, "nobody")]
    rows = exact_dedup.duplicate_groups(frame(spark, data)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows), key=repr) == brute(data)
    kept = defaultdict(list)
    for r in rows:
        kept[r.text_sha256].append((r.kept, r.doc_id, r.keep_id))
    for group in kept.values():
        assert [(d, k) for stays, d, k in group if stays] == [(group[0][2], group[0][2])]


def test_kept_rows(spark):
    data = [(1, "a"), (2, "A"), (3, "b"), (4, None), (5, ""), (None, "c"), (6, "d"), (6, "d")]
    df = frame(spark, data).withColumn("extra", F.struct("doc_id"))
    out = exact_dedup.drop_duplicates(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in out.filter("doc_id is not null").collect()) == [(2, "A"), (3, "b"), (5, ""), (6, "d")]
    assert out.filter("doc_id is null").count() == 1


def test_empty_table(spark):
    none = frame(spark, [])
    assert exact_dedup.duplicate_groups(none).count() == 0 and exact_dedup.drop_duplicates(none).count() == 0


def test_no_python_in_the_plan(spark):
    df = frame(spark, [(k, f"t{k % 3}") for k in range(20)])
    for out in (exact_dedup.duplicate_groups(df), exact_dedup.drop_duplicates(df)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_unique_rows_mostly_pass_the_filter(spark):
    hashes = spark.range(20_000).select(exact_dedup.text_hash(F.col("id").cast("string")).alias("digest"))
    words = 20_000 * exact_dedup.BITS_PER_ROW // 64
    flagged = exact_dedup.flag_possible_repeats(hashes, "digest", exact_dedup.repeated_bits(hashes, words), words)
    assert flagged.filter("_maybe").count() < 600
