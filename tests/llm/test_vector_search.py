"""Search against brute force: clustered and shifted clouds, ties, edge rows, small blocks."""

import math

import numpy as np
import pandas as pd
import pytest

from haulcast.llm import vector_search

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def brute(rows, every=50, k=5):
    scaled = []
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            scaled.append((i, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for n, (q, a) in enumerate(scaled):
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for m, (i, b) in enumerate(scaled) if m != n)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)
    return sorted(map(tuple, vector_search.top_products(df, **options).collect()))


@pytest.mark.parametrize("shift", [0, 1_000])
def test_clusters(spark, shift):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 3, (6, 8))
    rows = [(k, (centres[k % 6] + rng.normal(0, 0.2, 8) + shift).tolist()) for k in range(600)]
    assert run(spark, rows, pivots=6, rings=4, block_rows=50, sample=100) == brute(rows)


def test_ties_and_small_chunks(spark, monkeypatch):
    rows = [(k, [float(k % 3), 1.0]) for k in range(300)]
    assert run(spark, rows, pivots=4, rings=3, block_rows=40) == brute(rows)
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)
    index = vector_search.build_index(df.selectExpr("vec_id as id", "transform(embedding, x -> bigint(256 * x)) as vector"), pivots=3)
    from pyspark.sql import functions as F
    got = vector_search.search(index, F.col("id") % 50 == 0, 5, df, rounds=(1, 2, None), chunk_queries=2)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, [0.0, 0.0]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (None, [9.0, 9.0]),
            (5, [-1.0, 0.004]), (6, [1e6, -1e6]), (100, [nan]), (7, [1.0, 2.0])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [(0, [1.0])]) == [] and run(spark, [(1, None)]) == [] and run(spark, []) == []
    assert run(spark, [(0, [1.0]), (0, [2.0])]) == [(0, 1, 0, 131072), (0, 1, 0, 131072)]
    assert run(spark, [(0, []), (1, [3.0])]) == [(0, 1, 1, 0)]


def test_large_products_stay_exact():
    a = np.array([[1 << 30, 3, 1]], np.int64)
    assert vector_search.products(a, a)[0, 0] == (1 << 60) + 10


def test_worst_score_stays_an_integer(spark):
    """Scores above 2^53 that differ by one: a worst score kept as a double would drop or add ties."""
    big = 1 << 20
    rows = [(k, [float(big), float(1 + k % 7) / 256]) for k in range(120)]
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, score string")
    index = vector_search.build_index(df.select(F.col("vec_id").alias("id"), vector_search.scaled().alias("vector")),
                                      pivots=3, rings=4, block_rows=16)
    got = vector_search.search(index, F.col("id") % 50 == 0, 5, df, rounds=(1, 2, 4, None), chunk_queries=1)
    whole = [(i, [big * 256, 1 + i % 7]) for i, _ in rows]
    want = []
    for q, a in whole[::50]:
        scores = sorted((-(a[0] * b[0] + a[1] * b[1]), i) for i, b in whole if i != q)
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:5])]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_bounds_hold_and_prune(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 20, (8, 6))
    rows = [(k, (centres[k % 8] + rng.normal(0, 0.1, 6)).tolist()) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    from pyspark.sql import functions as F
    index = vector_search.build_index(df.select("id", vector_search.scaled("vector").alias("vector")), pivots=8, rings=2)
    stored = index.vectors.toPandas()
    points = vector_search.matrix(stored["vector"], index.rings.width)
    lifted = vector_search.lifted(points, index.rings.longest)
    bounds = index.rings.bounds(points)
    own = np.column_stack([points.astype(float), np.zeros(len(points))])
    true = ((own[:, None, :] - lifted[None, :, :]) ** 2).sum(axis=2)
    assert (bounds[:, stored["ring"]] <= true * (1 + 1e-9) + 1e-6).all()
    asks = stored[stored["id"] % 50 == 0].rename(columns={"_row": "_query"})
    fifth = np.sort(points @ points[asks.index].T, axis=0)[-6]
    visit = vector_search._visits(index.rings, 0, None)
    visited = pd.concat(visit(iter([asks.assign(worst=fifth)])))
    assert len(visited) < len(asks) * len(index.rings.blocks) / 2
