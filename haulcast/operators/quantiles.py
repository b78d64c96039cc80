"""Exact quantiles without gathering a column in one task.

The built-in exact percentile keeps every distinct value of a column in a single
task. Here the wanted order statistics are located by counting rows between
approximate splitters, and only the few buckets that hold them are ranked. The
narrow projection that the passes read is cached, and may spill to disk.
Buckets that are still too large are split again, so the work per task stays
bounded for any number of rows and any share of repeated values. Quantiles
interpolate linearly between neighbouring values.
"""

from __future__ import annotations

import bisect
import math
from collections import defaultdict
from collections.abc import Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulcast.operators.stats import by_key

MAX_BUCKET_ROWS = 1_000_000
ACCURACY = 10_000
EVEN_CUTS = 257
SKETCHES = 64
FEW_PROBS = 16


def quantile(df: DataFrame, col: str, p: float) -> float | None:
    """One exact quantile of one column."""
    return quantiles(df, [col], [p])[None, col][0]


def median(df: DataFrame, col: str) -> float | None:
    return quantile(df, col, 0.5)


def medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    found = quantiles(df, cols, [0.5])
    return {c: found[None, c][0] for c in cols}


def lookup(values: dict, key: str, col: str, position: int = 0) -> Column:
    """Column that picks a fitted quantile of ``col`` by the row's ``key``."""
    return by_key(key, {g: v[position] for (g, c), v in values.items() if c == col})


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: str | None = None,
              leave_out: bool = False, max_bucket_rows: int | None = None) -> dict:
    """Exact quantiles as ``{(group, column): [value per prob]}``.

    ``by`` names a frame or fold column with few values. With ``leave_out`` the
    entry of a fold describes the rows outside that fold. Nulls and NaN are ignored; an
    empty group gives ``None``. Only counts of buckets and the wanted values
    reach the driver.
    """
    cols, probs = list(cols), [float(p) for p in probs]
    data = df.select((F.col(by) if by else F.lit(None).cast("int")).alias("g"),
                     *[_number(c).alias(f"x{i}") for i, c in enumerate(cols)])
    if by:
        data = data.filter(F.col("g").isNotNull())
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _quantiles(data, cols, probs, by, leave_out, max_bucket_rows or MAX_BUCKET_ROWS)
    finally:
        data.unpersist()


def _number(col: str) -> Column:
    """The column as double, NaN taken as null."""
    x = F.col(col).cast("double")
    return F.when(~F.isnan(x), x)


def _quantiles(data: DataFrame, cols: list[str], probs: list[float], by, leave_out: bool, max_bucket_rows: int) -> dict:
    grid = _Grid(probs)
    counted = _sizes(data, len(cols))
    rows = [sum(n for (i, _, _), (n, _, _) in counted.items() if i == c) for c in range(len(cols))]
    splits: list[list[float]] = [[] for _ in cols]
    if len(probs) > FEW_PROBS or max(rows, default=0) > max_bucket_rows:
        splits = _first_splitters(data, len(cols), grid)
        counted = _bucket_counts(data, splits)
    while True:
        targets = sorted({g for _, g, _ in counted}) if by else [None]
        known, wanted = _locate(counted, targets, probs, leave_out)
        sizes = defaultdict(int)
        for (i, _, b), (n, _, _) in counted.items():
            sizes[i, b] += n
        heavy = {(i, b) for i, _, b, _, _ in wanted if sizes[i, b] > max_bucket_rows}
        if not heavy:
            break
        _add_splitters(data, splits, heavy, grid)
        counted = _bucket_counts(data, splits)
    known.update(_rank_buckets(data, splits, wanted, targets, leave_out))

    out = {}
    for t, i in ((t, i) for t in targets for i in range(len(cols))):
        n = sum(c for (j, g, _), (c, _, _) in counted.items() if j == i and _counts_for(g, t, leave_out))
        values = []
        for p in probs:
            if n == 0:
                values.append(None)
                continue
            h = p * (n - 1)
            low, high = known[i, t, math.floor(h)], known[i, t, math.ceil(h)]
            # at an infinite value the difference would be NaN
            values.append(low if low == high or h == math.floor(h) else low + (high - low) * (h - math.floor(h)))
        out[t, cols[i]] = values
    return out


class _Grid:
    """Probabilities asked of the sketches: an even grid, and close brackets around the wanted ones."""

    def __init__(self, probs: list[float]):
        self.even = np.linspace(0, 1, EVEN_CUTS).tolist()
        self.low = [max(0.0, p - 2 / ACCURACY) for p in probs]
        self.high = [min(1.0, p + 2 / ACCURACY) for p in probs]
        self.asked = sorted({*self.even, *self.low, *self.high})
        self.place = {p: k for k, p in enumerate(self.asked)}

    def sketch(self, x: Column) -> Column:
        return F.percentile_approx(x, self.asked, ACCURACY)

    def cuts(self, sketches: list[tuple[int, list[float]]]) -> set[float]:
        """Cut points from the (rows, values) of one column's sketches.

        The even cuts are quantiles of the pooled sketches; a repeated one is
        also cut off above, to stand alone. The brackets reach over all sketches.
        """
        values = np.array([v for _, v in sketches])
        points = values[:, [self.place[p] for p in self.even]]
        weights = np.repeat([n for n, _ in sketches], points.shape[1])
        order = np.argsort(points, axis=None, kind="stable")
        reached = np.cumsum(weights[order])
        at = np.searchsorted(reached, np.array(self.even) * reached[-1]).clip(max=len(order) - 1)
        even = points.ravel()[order][at].tolist()
        cuts = set(even)
        cuts.update(float(np.nextafter(v, math.inf)) for k, v in enumerate(even) if k == 0 or even[k - 1] == v)
        cuts.update(values[:, [self.place[p] for p in self.low]].min(0).tolist())
        cuts.update(values[:, [self.place[p] for p in self.high]].max(0).tolist())
        return cuts


def _in_parts(data: DataFrame) -> DataFrame:
    """Deal the input partitions out to a few sketches, so that no task merges those of all partitions."""
    return data.withColumn("part", F.spark_partition_id() % SKETCHES)


def _sizes(data: DataFrame, width: int) -> dict:
    """Count and range of every column per group, all in one bucket; fills the cache."""
    x = [F.col(f"x{i}") for i in range(width)]
    rows = data.groupBy("g").agg(*[
        F.struct(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).alias(f"s{i}")
        for i, v in enumerate(x)]).collect()
    return {(i, row["g"], 0): tuple(row[f"s{i}"]) for row in rows for i in range(width) if row[f"s{i}"]["n"]}


def _first_splitters(data: DataFrame, width: int, grid: _Grid) -> list[list[float]]:
    """Splitters of every column from sketches per group, in one aggregation."""
    x = [F.col(f"x{i}") for i in range(width)]
    rows = _in_parts(data).groupBy("g", "part").agg(*[
        F.struct(F.count(v).alias("n"), grid.sketch(v).alias("q")).alias(f"s{i}") for i, v in enumerate(x)]).collect()
    sketches = defaultdict(list)
    for row in rows:
        for i in range(width):
            if row[f"s{i}"]["n"]:
                sketches[i, row["g"]].append(tuple(row[f"s{i}"]))
    splits = [set() for _ in x]
    for (i, _), found in sketches.items():
        splits[i] |= grid.cuts(found)
    return [sorted(c) for c in splits]


def _counts_for(group, target, leave_out: bool) -> bool:
    return group != target if leave_out else group == target


def _long(data: DataFrame, splits: list[list[float]]) -> DataFrame:
    """Rows (column number i, group g, bucket b, value x), nulls dropped."""
    split_cols = [i for i, s in enumerate(splits) if s]
    if split_cols:
        data = Bucketizer(
            inputCols=[f"x{i}" for i in split_cols], outputCols=[f"b{i}" for i in split_cols],
            splitsArray=[[-math.inf, *[v for v in splits[i] if math.isfinite(v)], math.inf] for i in split_cols],
            handleInvalid="keep").transform(data)
    cells = [F.struct(F.lit(i).alias("i"),
                      (F.col(f"b{i}").cast("int") if splits[i] else F.lit(0)).alias("b"),
                      F.col(f"x{i}").alias("x")) for i in range(len(splits))]
    if len(cells) == 1:
        rows = data.select("g", cells[0].alias("cell")).select("g", "cell.i", "cell.b", "cell.x")
    else:
        rows = data.select("g", F.inline(F.array(*cells)))
    return rows.filter(F.col("x").isNotNull())


def _bucket_counts(data: DataFrame, splits) -> dict:
    rows = (_long(data, splits).groupBy("i", "g", "b")
            .agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect())
    return {(r["i"], r["g"], r["b"]): (r["n"], r["lo"], r["hi"]) for r in rows}


def _locate(counted, targets, probs, leave_out) -> tuple[dict, list]:
    """Order statistics already settled, and the open ones as (column, target, bucket, rank, rank inside)."""
    known, wanted = {}, []
    for t in targets:
        per_col = defaultdict(lambda: defaultdict(list))
        for (i, g, b), cell in counted.items():
            if _counts_for(g, t, leave_out):
                per_col[i][b].append(cell)
        for i, buckets in per_col.items():
            order = sorted(buckets)
            ends = np.cumsum([sum(n for n, _, _ in buckets[b]) for b in order]).tolist()
            total = ends[-1]
            ranks = {r for p in probs for r in (math.floor(p * (total - 1)), math.ceil(p * (total - 1)))}
            for rank in ranks:
                k = bisect.bisect_right(ends, rank)
                lo, hi = min(c[1] for c in buckets[order[k]]), max(c[2] for c in buckets[order[k]])
                if lo == hi:
                    known[i, t, rank] = lo
                else:
                    wanted.append((i, t, order[k], rank, rank - (ends[k - 1] if k else 0)))
    return known, wanted


def _add_splitters(data: DataFrame, splits, heavy: set, grid: _Grid) -> None:
    """Cut each heavy bucket at its own approximate quantiles."""
    codes = [i * 1_000_000 + b for i, b in sorted(heavy)]
    rows = (_in_parts(_long(data, splits).filter((F.col("i") * 1_000_000 + F.col("b")).isin(codes)))
            .groupBy("i", "b", "part").agg(F.count("*").alias("n"), grid.sketch(F.col("x")).alias("q")).collect())
    sketches = defaultdict(list)
    for row in rows:
        sketches[row["i"], row["b"]].append((row["n"], row["q"]))
    for (i, _), found in sketches.items():
        splits[i] = sorted(set(splits[i]) | grid.cuts(found))


def _rank_buckets(data: DataFrame, splits, wanted, targets, leave_out) -> dict:
    """Rank the values of the open buckets and pick the wanted ones."""
    if not wanted:
        return {}
    spark = data.sparkSession
    codes = sorted({i * 1_000_000 + b for i, _, b, _, _ in wanted})
    number = {t: k for k, t in enumerate(targets)}
    counts = (_long(data, splits).filter((F.col("i") * 1_000_000 + F.col("b")).isin(codes))
              .groupBy("i", "g", "b", "x").agg(F.count("*").alias("n")))
    if leave_out:
        others = F.array(*[F.struct(F.lit(number[t]).alias("t"), F.lit(t).alias("value")) for t in targets])
        counts = counts.select("i", "b", "x", "n", F.explode(
            F.filter(others, lambda o: o["value"] != F.col("g"))["t"]).alias("t"))
    elif targets == [None]:
        counts = counts.withColumn("t", F.lit(0))
    else:
        pairs = [F.lit(v) for t in targets for v in (t, number[t])]
        counts = counts.withColumn("t", F.create_map(*pairs)[F.col("g")])
    counts = counts.groupBy("i", "b", "t", "x").agg(F.sum("n").alias("n"))
    bucket = Window.partitionBy("i", "b", "t").orderBy("x")
    ranked = counts.withColumn("stop", F.sum("n").over(bucket)).withColumn("start", F.col("stop") - F.col("n"))

    # at most two rows per column, group and probability
    asked = [(i, b, number[t], inside, rank) for i, t, b, rank, inside in wanted]
    asked_df = spark.createDataFrame(asked, "wi int, wb int, wt int, inside long, rank long")
    picked = ranked.join(
        F.broadcast(asked_df),
        (F.col("i") == F.col("wi")) & (F.col("b") == F.col("wb")) & (F.col("t") == F.col("wt"))
        & (F.col("inside") >= F.col("start")) & (F.col("inside") < F.col("stop")))
    return {(r["i"], targets[r["t"]], r["rank"]): r["x"] for r in picked.select("i", "t", "rank", "x").collect()}
