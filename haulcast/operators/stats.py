"""Fitted statistics.

A fit is one aggregation, whose single row (or one row per frame or fold) comes
to the driver and is applied as literals: one action to fit, none to apply, and
the applied plan stays a plain projection over the scan. Statistics per entity
or category, whose number grows with the data, live in ``keyed`` instead.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fit(df: DataFrame, aggs: Mapping[str, Column]) -> dict[str, Column]:
    """Aggregates over all rows of ``df`` as literal columns usable on any frame."""
    fitted = df.agg(*[a.alias(n) for n, a in aggs.items()])
    row = fitted.first()
    return {f.name: F.lit(row[f.name]).cast(f.dataType) for f in fitted.schema.fields}


def by_key(key: str, values: Mapping) -> Column:
    """Literal lookup by the row's frame or fold; null where the key or its value is unknown."""
    known = {k: float(v) for k, v in values.items() if k is not None and v is not None}
    if not known:
        return F.lit(None).cast("double")
    return F.create_map(*[F.lit(x) for pair in known.items() for x in pair])[F.col(key)]


def fit_by(df: DataFrame, key: str, aggs: Mapping[str, Column]) -> dict[str, Column]:
    """Aggregates per value of ``key``, looked up by the row's own key.

    ``key`` must be a frame tag or a fold number: one row per value is collected.
    """
    rows = df.groupBy(key).agg(*[a.alias(n) for n, a in aggs.items()]).collect()
    return {n: by_key(key, {row[key]: row[n] for row in rows}) for n in aggs}


def moments_excluding(df: DataFrame, fold: str, cols: Sequence[str]) -> dict:
    """``{(fold, column): (n, mean, population deviation)}`` over the rows outside each fold.

    One pass gives the moments per fold; those of a complement are combined from
    its folds, which loses no digits to subtraction.
    """
    rows = df.filter(F.col(fold).isNotNull()).groupBy(fold).agg(*[
        F.struct(F.count(c).alias("n"), F.avg(c).alias("mean"), F.var_pop(c).alias("var")).alias(c)
        for c in cols]).collect()
    out = {}
    for c in cols:
        for own in rows:
            parts = [row[c] for row in rows if row[fold] != own[fold] and row[c]["n"]]
            n = sum(p["n"] for p in parts)
            if not n:
                out[own[fold], c] = (0, None, None)
                continue
            mean = math.fsum(p["n"] * p["mean"] for p in parts) / n
            spread = math.fsum(p["n"] * (p["var"] + (p["mean"] - mean) ** 2) for p in parts) / n
            out[own[fold], c] = (n, mean, math.sqrt(spread))
    return out


def fit_excluding(df: DataFrame, fold: str, cols: Sequence[str]) -> Callable[..., Column]:
    """Moments outside the row's fold as columns: look up with ``(column, 'n' | 'mean' | 'sd')``.

    A third argument names one fold to look up on all rows, for training the
    model of that fold or scoring with it.
    """
    moments = moments_excluding(df, fold, cols)
    place = {"n": 0, "mean": 1, "sd": 2}

    def look_up(name: str, moment: str, at=None) -> Column:
        if at is not None:
            return F.lit(moments[at, name][place[moment]]).cast("double")
        return by_key(fold, {f: m[place[moment]] for (f, c), m in moments.items() if c == name})

    return look_up


def mean_where(condition: Column, x: Column) -> Column:
    """Aggregate: mean of ``x`` over the rows that satisfy ``condition``."""
    return F.avg(F.when(condition, x))


def most_frequent(df: DataFrame, cols: Sequence[str]) -> dict[str, str | None]:
    """Most frequent value per column as text, ties to the smallest, nulls not counted.

    Values are counted in a shuffle first, so no task holds all of a column's
    distinct values.
    """
    cells = [F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in cols]
    counts = (df.select(F.inline(F.array(*cells))).filter(F.col("value").isNotNull())
              .groupBy("name", "value").count())
    best = counts.groupBy("name").agg(F.min_by("value", F.struct(-F.col("count"), F.col("value"))).alias("value"))
    found = {row["name"]: row["value"] for row in best.collect()}
    return {c: found.get(c) for c in cols}
