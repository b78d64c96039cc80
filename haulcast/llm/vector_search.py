"""Exact search for the highest inner products with a pivot-distance index.

Vectors of integers get one more coordinate that brings all of them to the same
length. In that space the highest inner product with a query is the smallest
distance to it. Every vector is keyed by its nearest pivot and its distance from
that pivot, and the distances around a pivot are cut into rings (annuli). For each
ring the index holds the interval of its vectors' distances from every pivot. By
the triangle inequality nothing in a ring is nearer to a query than the difference
between the query's distance from any pivot and that interval; the largest of these
differences is the bound. Queries visit rings in the order of their bounds, in
rounds of growing size, and stop at the first ring that cannot hold a score as high
as the worst of their best.

Rings are cut into blocks, and the visitors of a block into chunks, so a task meets
a bounded number of either and returns at most k rows per query. A block is copied
once for each chunk of its visitors, and not at all where no query visits it.

Edge cases: vectors that are null, hold null or non-finite components, or have a
null id take no part. Shorter vectors count as filled with zeros. Rows may repeat:
a query leaves out its own row only. With fewer than k candidates all are returned.
An empty table gives an empty result. Columns besides id and vector are ignored.
Scores are exact while they are below 2^63.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulcast.session import materialise

#: Pivots are chosen from a sample of this many vectors; the index holds all of them.
SAMPLE = 4_000
PIVOTS, RINGS = 64, 8
BLOCK_ROWS, CHUNK_QUERIES = 8_192, 4_096
#: Stands for the worst score of a query that has fewer than k so far.
NO_SCORE = -(1 << 63)
#: Rings a query visits up to the end of each round; the last round takes all that the bound leaves.
ROUNDS = (8, 64, None)
SEED = 5


def scaled(vector: str | Column = "embedding", scale: int = 256) -> Column:
    """floor(scale * x) of each component; null for vectors that take no part."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.when(F.forall(vector, lambda x: F.coalesce(finite(x.cast("double")), F.lit(False))),
                  F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Rows of equal length, in floats where these are exact."""
    out = np.zeros((len(vectors), width), np.int64)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of all rows; by floating point where no sum can lose a digit."""
    if not len(left) or not len(right):
        return np.zeros((len(left), len(right)), np.int64)
    top = lambda m: max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0))))
    if top(left) * top(right) * left.shape[1] < 1 << 53:
        return (left.astype(float) @ right.astype(float).T).astype(np.int64)
    return left @ right.T


@dataclass
class Rings:
    """Pivots, and for each ring its number of blocks and its smallest and largest distance from every pivot.

    The intervals are matrices of rings (rows) and pivots (columns), of pivots * rings rows at most.
    """

    width: int
    longest: float
    pivots: np.ndarray
    inner: np.ndarray
    outer: np.ndarray
    blocks: np.ndarray

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Smallest possible squared distance of each query (row) to each ring (column)."""
        d = distances(np.column_stack([queries.astype(float), np.zeros(len(queries))]), self.pivots)
        gap = np.zeros((len(queries), len(self.blocks)))
        for p in range(len(self.pivots)):
            to_pivot = d[:, p, None]
            np.maximum(gap, np.maximum(to_pivot - self.outer[:, p], self.inner[:, p] - to_pivot), out=gap)
        return gap ** 2


@dataclass
class PivotIndex:
    """``vectors``: _row, id, vector, ring, block."""

    vectors: DataFrame
    rings: Rings


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    out = np.empty((len(points), len(pivots)))
    for k, p in enumerate(pivots):
        out[:, k] = np.sqrt(((points - p) ** 2).sum(axis=1))
    return out


def lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with the coordinate that brings their squared length to ``longest``."""
    v = vectors.astype(float)
    return np.column_stack([v, np.sqrt(np.maximum(0, longest - (v * v).sum(axis=1)))])


def choose_pivots(points: np.ndarray, count: int = PIVOTS, seed: int = SEED, steps: int = 5) -> np.ndarray:
    """Centres of a few steps of k-means over the sample."""
    rng = np.random.default_rng(seed)
    centres = points[rng.permutation(len(points))[:count]].copy()
    for _ in range(steps):
        near = distances(points, centres).argmin(axis=1)
        for k in np.unique(near):
            centres[k] = points[near == k].mean(axis=0)
    return centres


def build_index(vectors: DataFrame, pivots: int = PIVOTS, rings: int = RINGS, block_rows: int = BLOCK_ROWS,
                sample: int = SAMPLE) -> PivotIndex | None:
    """Index (id, vector) rows; None without vectors."""
    spark = vectors.sparkSession
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    rows = materialise(vectors.filter("id is not null and vector is not null").select(
        F.monotonically_increasing_id().alias("_row"), "id", "vector", norm.alias("_norm")), "vectors")
    facts = rows.agg(F.max(F.size("vector")).alias("width"), F.max("_norm").alias("longest")).first()
    if facts["longest"] is None:
        return None
    width, longest = facts["width"], facts["longest"]
    seen = rows.orderBy(F.xxhash64("id"), "id", "_row").limit(sample).select("vector").toPandas()["vector"]
    centres = choose_pivots(lifted(matrix(seen, width), longest), pivots)

    def key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            d = distances(lifted(matrix(b["vector"], width), longest), centres)
            near = d.argmin(axis=1)
            yield b[["_row", "id", "vector"]].assign(pivot=near.astype(np.int32), dist=d[np.arange(len(b)), near])

    keyed = materialise(rows.mapInPandas(key, "_row long, id long, vector array<long>, pivot int, dist double"), "keyed")
    cuts = [k / rings for k in range(1, rings)]
    edges = {r["pivot"]: r["edges"] for r in keyed.groupBy("pivot").agg(
        F.percentile_approx("dist", cuts, 1_000).alias("edges")).collect()}  # at most ``pivots`` rows
    table = spark.createDataFrame([(p, list(map(float, e))) for p, e in edges.items()], "_pivot int, _edges array<double>")
    ringed = keyed.join(F.broadcast(table), F.col("pivot") == F.col("_pivot"))
    number = F.size(F.filter("_edges", lambda e: e < F.col("dist")))
    ringed = ringed.select("_row", "id", "vector", "dist", (F.col("pivot") * rings + number).alias("_slot"))
    slots = sorted(map(tuple, ringed.groupBy("_slot").count().collect()))  # at most pivots * rings rows
    blocks = -(-np.array([n for _, n in slots]) // block_rows)
    numbers = spark.createDataFrame([(s, k, int(b)) for k, ((s, _), b) in enumerate(zip(slots, blocks))], "_s int, ring int, _b int")
    placed = materialise(ringed.join(F.broadcast(numbers), F.col("_slot") == F.col("_s")).select(
        "_row", "id", "vector", "ring", F.pmod(F.xxhash64("_row"), F.col("_b")).cast("int").alias("block")), "placed")
    inner, outer = _intervals(placed, width, longest, centres, len(slots))
    return PivotIndex(placed, Rings(width, longest, centres, inner, outer, blocks))


def _intervals(placed: DataFrame, width: int, longest: float, centres: np.ndarray, rings: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest distance of each ring's vectors (rows) from each pivot (columns)."""

    def widen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        inner, outer = np.full((rings, len(centres)), np.inf), np.full((rings, len(centres)), -np.inf)
        for b in batches:
            d, ring = distances(lifted(matrix(b["vector"], width), longest), centres), b["ring"].to_numpy()
            np.minimum.at(inner, ring, d)
            np.maximum.at(outer, ring, d)
        met = np.flatnonzero(outer[:, 0] >= 0)
        yield pd.DataFrame({"ring": np.repeat(met, len(centres)), "pivot": np.tile(np.arange(len(centres)), len(met)),
                            "low": inner[met].ravel(), "high": outer[met].ravel()})

    found = placed.select("ring", "vector").mapInPandas(widen, "ring int, pivot int, low double, high double")
    # one row for each ring and pivot, so at most pivots * pivots * rings
    rows = found.groupBy("ring", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high")).toPandas()
    inner, outer = np.zeros((rings, len(centres))), np.zeros((rings, len(centres)))
    inner[rows["ring"], rows["pivot"]] = rows["low"]
    outer[rows["ring"], rows["pivot"]] = rows["high"]
    return inner, outer


def _visits(rings: Rings, begin: int, end: int | None) -> Callable:
    """Rings that each query visits in this round, a row for each block of a ring."""
    slack = 1e-6 * (1 + rings.longest)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for start in range(0, len(whole), 256):
                b = whole.iloc[start: start + 256]
                q = matrix(b["vector"], rings.width)
                bound = rings.bounds(q)
                norm = (q.astype(float) ** 2).sum(axis=1) + rings.longest
                worst = b["worst"].to_numpy()
                reach = np.where(worst == NO_SCORE, np.inf, norm - 2.0 * worst) + slack
                order = np.argsort(bound, axis=1, kind="stable")[:, begin:end]
                rows, cols = np.nonzero(np.take_along_axis(bound, order, axis=1) <= reach[:, None])
                ring = order[rows, cols]
                rows = np.repeat(rows, rings.blocks[ring])
                block = np.concatenate([np.arange(n) for n in rings.blocks[ring]] or [np.zeros(0, int)])
                ring = np.repeat(ring, rings.blocks[ring])
                picked = b.iloc[rows]
                yield pd.DataFrame({
                    "_query": picked["_query"].to_numpy(), "ring": ring.astype(np.int32), "block": block.astype(np.int32)})

    return run


def _meet(width: int, k: int) -> Callable:
    """Scores of a block's vectors for a chunk of queries: the best k of each that are not below its worst."""

    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        names = ["_query", "_row", "vec_id", "score"]
        if vectors.empty or queries.empty:
            return pd.DataFrame(columns=names)
        ids, rows = vectors["id"].to_numpy(), vectors["_row"].to_numpy()
        order = np.lexsort((rows, ids))
        ids, rows, stored = ids[order], rows[order], matrix(vectors["vector"].iloc[order], width)
        worst, asks = queries["worst"].to_numpy(), queries["_query"].to_numpy()
        out = []
        for start in range(0, len(queries), 256):
            part = slice(start, start + 256)
            score = products(matrix(queries["vector"].iloc[part], width), stored)
            for i, (ask, least) in enumerate(zip(asks[part], worst[part])):
                fit = np.flatnonzero((score[i] >= least) & (rows != ask))
                best = fit[np.argsort(-score[i, fit], kind="stable")[:k]]
                out.append(pd.DataFrame({"_query": ask, "_row": rows[best], "vec_id": ids[best], "score": score[i, best]}))
        return pd.concat(out)[names]

    return run


def search(index: PivotIndex | None, is_query: Column, k: int, empty: DataFrame, rounds: tuple = ROUNDS,
           chunk_queries: int = CHUNK_QUERIES) -> DataFrame:
    """The best ``k`` rows for each indexed row that ``is_query`` picks: query_id, rank, vec_id, score."""
    schema = "query_id long, rank int, vec_id long, score long"
    if index is None:
        return empty.sparkSession.createDataFrame([], schema)
    asked = materialise(index.vectors.filter(is_query).select(F.col("_row").alias("_query"), F.col("id").alias("query_id"), "vector"), "queries")
    best, begin, rank = None, 0, Window.partitionBy("_query").orderBy(F.desc("score"), "vec_id", "_row")
    for end in rounds:
        state = asked.withColumn("worst", F.lit(NO_SCORE))
        if best is not None:
            worst = best.groupBy("_query").agg(F.when(F.count("*") >= k, F.min("score")).alias("_worst"))
            state = asked.join(worst, "_query", "left").withColumn("worst", F.coalesce("_worst", F.lit(NO_SCORE)))
        state = materialise(state.select("_query", "worst", "vector"), "state")
        visits = materialise(state.mapInPandas(_visits(index.rings, begin, end), "_query long, ring int, block int"), "visits")
        # a row for each visited block
        chunks = materialise(visits.groupBy("ring", "block").agg(
            F.ceil(F.count("*") / F.lit(float(chunk_queries))).cast("int").alias("_chunks")), "chunks")
        asking = visits.join(chunks, ["ring", "block"]).select(
            "_query", "ring", "block", F.pmod(F.xxhash64("_query"), F.col("_chunks")).cast("int").alias("chunk")).join(state, "_query")
        stored = index.vectors.join(chunks, ["ring", "block"]).select(
            "ring", "block", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("chunk"), "_row", "id", "vector")
        keys = ["ring", "block", "chunk"]
        found = stored.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInPandas(
            _meet(index.rings.width, k), "_query long, _row long, vec_id long, score long")
        found = found if best is None else best.unionAll(found)
        best = materialise(found.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)
                           .select("_query", "_row", "vec_id", "score"), "best")
        begin = end
    ranked = best.withColumn("rank", F.row_number().over(rank))
    return ranked.join(asked.select("_query", "query_id"), "_query").select("query_id", "rank", "vec_id", "score")


def top_products(table: DataFrame, every: int = 50, k: int = 5, scale: int = 256, **options) -> DataFrame:
    """The ``k`` highest integer inner products of each row whose id is divisible by ``every``, against all rows."""
    index = build_index(table.select(F.col("vec_id").cast("long").alias("id"), scaled("embedding", scale).alias("vector")), **options)
    return search(index, F.col("id") % every == 0, k, table)
