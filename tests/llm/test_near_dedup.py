"""Near duplicates against brute force, with hot groups, chains and edge rows."""

import random
import re

import numpy as np
import pytest

from haulcast.llm import near_dedup
from haulcast.operators import keyed

SCHEMA = "doc_id long, text string, n int, comp string"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))
    return {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(data, percent=85):
    """component of each id, by all pairs."""
    sets = [(d, shingles(t)) for d, t in data]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {d: (len(s), find(d)) for d, s in sets}


def run(spark, data):
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in data], SCHEMA)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicate_groups(docs).collect()}, docs


def word(rng):
    return f"w{rng.randrange(5_000)}"


def changed(words, rng, share):
    return [word(rng) if rng.random() < share else w for w in words]


@pytest.mark.parametrize("block", [3, 500])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK_ASKERS", block)
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", block)
    if block == 3:  # tables of keys are too large to broadcast
        monkeypatch.setattr(keyed, "BROADCAST_KEYS", 5)
        monkeypatch.setattr(keyed, "HOT_KEYS", 20)
    rng = random.Random(3)
    data = []
    for _ in range(12):  # groups of copies around a base
        base = [word(rng) for _ in range(rng.randrange(20, 300))]
        data += [changed(base, rng, rng.choice([0, 0.004, 0.01, 0.02, 0.05])) for _ in range(rng.randrange(1, 8))]
    base = [word(rng) for _ in range(200)]  # one large group, far ones included
    data += [changed(base, rng, rng.choice([0.005, 0.01, 0.02])) for _ in range(60)]
    chain = [word(rng) for _ in range(200)]  # neighbours are linked, ends are not
    for _ in range(25):
        chain = chain[8:] + [word(rng) for _ in range(8)]
        data.append(chain)
    data += [[word(rng) for _ in range(n)] for n in (1, 2, 4, 5, 6, 50)]
    rng.shuffle(data)
    data = [(10 * k + 7, " ".join(w)) for k, w in enumerate(data)]
    got, docs = run(spark, data)
    assert got == brute(data)
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, c in got.values()}


def test_edges(spark):
    long = "v " + " ".join(f"x{k}" for k in range(30_000))
    data = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One  TWO"), (6, "one two three"), (7, long), (8, long + " y"),
            (9, "É a b c d e"), (10, "é a b c d e"), (11, "a b")]
    got, _ = run(spark, data)
    assert got == brute(data)
    assert got[1] == (0, 1) and got[2] == (0, 2) and got[5] == (1, 4) and got[8] == (29_998, 7) and got[10][1] == 10


def test_repeated_and_null_ids(spark):
    text = "a b c d e f g"
    docs = spark.createDataFrame([(None, text), (5, text), (5, text), (3, text.upper()), (None, "z"), (None, None)],
                                 "doc_id long, text string")
    rows = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicate_groups(docs).collect()), key=repr)
    assert rows == sorted([(None, 3, False), (5, 3, False), (5, 3, False), (3, 3, True), (None, None, True), (None, None, True)],
                          key=repr)
    none = docs.limit(0)
    assert near_dedup.near_duplicate_groups(none).count() == 0 and near_dedup.drop_near_duplicates(none).count() == 0


def test_posterior_bounds_keep_similar_pairs():
    least, rng = near_dedup.least_matches(), np.random.default_rng(5)
    assert (np.diff(least) > 0).all()
    n = 20_000
    for similarity, low, high in ((0.85, 0.9999, 1), (0.5, 0, 0.001)):
        left = rng.integers(0, 256, (n, 288), dtype=np.uint8)
        right = np.where(rng.random((n, 288)) < similarity, left, rng.integers(0, 256, (n, 288), dtype=np.uint8))
        assert low <= near_dedup.may_be_similar(left, right, least).mean() <= high


def test_signatures_estimate_similarity():
    words = [f"t{k}" for k in range(1_000)]
    x, y = (near_dedup.shingle_hashes(" ".join(w)) for w in (words[:800], words[200:]))
    true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    got = (near_dedup.minhash(x) == near_dedup.minhash(y)).mean()
    assert abs(got - true) < 0.12
