"""Scaling numeric columns and expanding them to products."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations, combinations_with_replacement

from pyspark.ml.feature import PolynomialExpansion
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulcast.operators.quantiles import quantiles
from haulcast.operators.stats import fit, fit_excluding


def _unit_if_zero(width: Column) -> Column:
    return F.when(width == 0, F.lit(1.0)).otherwise(width)


def scale_standard(df: DataFrame, cols: Sequence[str], where: Column | None = None, suffix: str = "") -> DataFrame:
    """(x - mean) / population deviation over the rows ``where`` holds; a constant column becomes 0."""
    rows = df if where is None else df.filter(where)
    s = fit(rows, {f"{c}_{m}": a for c in cols
                   for m, a in (("mean", F.avg(c)), ("sd", F.stddev_pop(c)))})
    return df.withColumns({c + suffix: (F.col(c) - s[f"{c}_mean"]) / _unit_if_zero(s[f"{c}_sd"]) for c in cols})


def scale_standard_by_fold(df: DataFrame, cols: Sequence[str], fold: str = "fold", at: int | None = None,
                           suffix: str = "") -> DataFrame:
    """Scale with the moments outside the row's fold, or outside fold ``at`` on every row."""
    moment = fit_excluding(df, fold, cols)
    return df.withColumns({
        c + suffix: (F.col(c) - moment(c, "mean", at)) / _unit_if_zero(moment(c, "sd", at)) for c in cols})


def scale_robust(df: DataFrame, cols: Sequence[str], where: Column | None = None, suffix: str = "") -> DataFrame:
    """(x - median) / (third - first quartile); a column without spread is only centred."""
    rows = df if where is None else df.filter(where)
    q = quantiles(rows, cols, [0.25, 0.5, 0.75])
    new = {}
    for c in cols:
        low, middle, high = q[None, c]
        new[c + suffix] = (F.col(c) - F.lit(middle)) / F.lit(high - low or 1.0 if middle is not None else None)
    return df.withColumns(new)


def interactions(df: DataFrame, cols: Sequence[str], squares: bool = False) -> tuple[DataFrame, list[str]]:
    """Products ``{a}_x_{b}`` of all pairs, with squares if asked for; returns all degree-2 feature names."""
    pairs = combinations_with_replacement(cols, 2) if squares else combinations(cols, 2)
    new = {f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in pairs}
    return df.withColumns(new), [*cols, *new]


def poly_vector(df: DataFrame, vector: str, out: str = "poly") -> DataFrame:
    """All terms of degree 1 and 2 of a vector column, squares included, as one vector.

    Of a sparse vector only the products of its nonzero elements are stored, so a row costs by its
    labels and not by all labels there are. Of (a, b, c) the order is a, aa, b, ab, bb, c, ac, bc, cc.
    """
    return PolynomialExpansion(degree=2, inputCol=vector, outputCol=out).transform(df)
