"""Repairing and transforming the target."""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulcast.functions.values import log_cost, not_below
from haulcast.operators.quantiles import quantile, quantiles
from haulcast.operators.stats import fit, mean_where


def _fit_rows(df: DataFrame, where: Column | None) -> DataFrame:
    return df if where is None else df.filter(where)


def nonpositive_to_positive_mean(df: DataFrame, col: str, where: Column | None = None) -> DataFrame:
    """Negatives and zeros become the mean of the positives; nulls stay."""
    x = F.col(col)
    mean = fit(_fit_rows(df, where), {"mean": mean_where(x > 0, x)})["mean"]
    return df.withColumn(col, F.when(x <= 0, mean).otherwise(x))


def negative_or_null_to_positive_mean(df: DataFrame, col: str, where: Column | None = None) -> DataFrame:
    """Negatives and nulls become the mean of the positives; zeros stay."""
    x = F.col(col)
    mean = fit(_fit_rows(df, where), {"mean": mean_where(x > 0, x)})["mean"]
    return df.withColumn(col, F.when((x < 0) | x.isNull(), mean).otherwise(x))


def negative_or_null_to_positive_median(df: DataFrame, col: str, where: Column | None = None) -> DataFrame:
    """Negatives and nulls become the median of the positives; zeros stay."""
    x = F.col(col)
    middle = median_positive(_fit_rows(df, where), col)
    return df.withColumn(col, F.when((x < 0) | x.isNull(), F.lit(middle)).otherwise(x))


def median_positive(df: DataFrame, col: str) -> float | None:
    return quantile(df.filter(F.col(col) > 0), col, 0.5)


def clip_lower(df: DataFrame, col: str, floor: float = 0.0) -> DataFrame:
    """Values below the floor become the floor; nulls stay."""
    return df.withColumn(col, not_below(F.col(col), floor))


def fill_median(df: DataFrame, col: str, where: Column | None = None) -> DataFrame:
    """Nulls become the median."""
    return df.withColumn(col, F.coalesce(F.col(col), F.lit(quantile(_fit_rows(df, where), col, 0.5))))


def below_quantile(df: DataFrame, col: str, p: float = 0.995, where: Column | None = None) -> DataFrame:
    """Keep rows strictly below the p-quantile of the column."""
    return df.filter(F.col(col) < F.lit(quantile(_fit_rows(df, where), col, p)))


def log_target(df: DataFrame, col: str, out: str) -> DataFrame:
    return df.withColumn(out, log_cost(F.col(col)))


def log_target_guarded(df: DataFrame, col: str, out: str) -> DataFrame:
    """log(1 + y) with 0 where the logarithm does not exist."""
    return df.withColumn(out, F.coalesce(log_cost(F.col(col)), F.lit(0.0)))


def outside_iqr(df: DataFrame, col: str, factor: float = 1.5) -> Column:
    """True for values beyond ``factor`` interquartile ranges from the quartiles."""
    q1, q3 = quantiles(df, [col], [0.25, 0.75])[None, col]
    reach = factor * (q3 - q1)
    return (F.col(col) < q1 - reach) | (F.col(col) > q3 + reach)


def outside_zscore(df: DataFrame, col: str, limit: float = 3.0) -> Column:
    """True for values more than ``limit`` standard deviations from the mean."""
    s = fit(df, {"mean": F.avg(col), "sd": F.stddev_pop(col)})
    return F.abs(F.col(col) - s["mean"]) > limit * s["sd"]


def clip_to_quantiles(df: DataFrame, col: str, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """Move values outside two quantiles onto them; nulls stay."""
    a, b = quantiles(df, [col], [low, high])[None, col]
    x = F.col(col)
    return df.withColumn(col, F.when(x < a, F.lit(a)).when(x > b, F.lit(b)).otherwise(x))


# The published coefficients of the normal quantile's rational approximation (Wichura 1988, AS 241),
# highest power first, for its central, middle and tail range.
CENTRAL = ((2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457,
            13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608),
           (5226.495278852545925, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867,
            5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0))
MIDDLE = ((7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258,
           3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734),
          (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459,
           0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0))
TAIL = ((2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093,
         0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772),
        (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4,
         0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0))


# terms of the series and of the continued fraction of the normal distribution function
SERIES_TERMS, FRACTION_TERMS = 40, 40


def _ratio(x: Column, coefficients: tuple[tuple[float, ...], tuple[float, ...]]) -> Column:
    """Quotient of two polynomials, highest power first."""
    top, bottom = (reduce(lambda value, c: value * x + c, values[1:], F.lit(values[0])) for values in coefficients)
    return top / bottom


def normal_quantile(p: Column) -> Column:
    """Quantile of the standard normal for 0 < p < 1 in column arithmetic, to about 15 digits."""
    off = p - 0.5
    central = off * _ratio(F.lit(0.180625) - off * off, CENTRAL)
    far = F.sqrt(-F.ln(F.least(p, 1 - p)))
    outer = F.when(far <= 5, _ratio(far - 1.6, MIDDLE)).otherwise(_ratio(far - 5, TAIL))
    return F.when(F.abs(off) <= 0.425, central).otherwise(F.signum(off) * outer)


def normal_share(z: Column) -> Column:
    """Share of the standard normal at or below z: a series near 0, a continued fraction in the tails."""
    square, x = z * z, F.abs(z)
    density = F.exp(-square / 2) / math.sqrt(2 * math.pi)
    # sum of z^(2k+1) / (1 3 5 ... (2k+1)), nested from the last term; below 3.5 the rest is under 1e-16
    series = reduce(lambda inner, k: 1 + square / (2 * k + 1) * inner, range(SERIES_TERMS, 0, -1), F.lit(1.0))
    tail = density / reduce(lambda inner, k: x + k / inner, range(FRACTION_TERMS, 0, -1), x)
    return F.when(x < 3.5, F.lit(0.5) + density * z * series).when(z > 0, 1 - tail).otherwise(tail)


class QuantileNormal:
    """Map a column to a standard normal through its quantiles, and back, in column arithmetic.

    ``fit`` finds the quantile grid with exact distributed quantiles. Applying it looks the
    neighbouring grid points up in a sorted array of literals and interpolates between them.
    """

    # distance kept from 0 and 1 so that the normal quantile stays finite
    EDGE = 1e-7

    def __init__(self, grid: list[float]):
        self.grid = [float(g) for g in grid]
        self.levels = np.linspace(0.0, 1.0, len(grid)).tolist()

    @classmethod
    def fit(cls, df: DataFrame, col: str, n: int = 1000) -> "QuantileNormal":
        return cls(quantiles(df, [col], np.linspace(0.0, 1.0, n).tolist())[None, col])

    def uniform(self, x: Column) -> Column:
        """Share of the distribution at or below x, ties placed in the middle of their range."""
        bounds: dict[float, list[float]] = {}
        for point, level in zip(self.grid, self.levels):
            bounds.setdefault(point, [level, level])[1] = level
        points = sorted(bounds)
        lows, highs = _array(bounds[p][0] for p in points), _array(bounds[p][1] for p in points)
        known, listed = x.cast("double"), _array(points)

        def between(at: Column) -> Column:
            left, right = F.get(listed, at), F.get(listed, at + 1)
            rising = (known - left) / (right - left) * (F.get(lows, at + 1) - F.get(highs, at))
            return F.when(known == left, (F.get(lows, at) + F.get(highs, at)) / 2).otherwise(F.get(highs, at) + rising)

        found = F.transform(F.array(_place(points, known)), between)[0]
        return (F.when(known.isNull() | F.isnan(known), F.lit(None).cast("double")).when(known < points[0], self.levels[0])
                .when(known > points[-1], self.levels[-1]).otherwise(found))

    def forward(self, x: Column) -> Column:
        kept = lambda u: F.when(u.isNotNull(), F.least(F.greatest(u, F.lit(self.EDGE)), F.lit(1 - self.EDGE)))
        return F.transform(F.array(self.uniform(x)), lambda u: normal_quantile(kept(u)))[0]

    def backward(self, z: Column) -> Column:
        grid = _array(self.grid)

        def between(place: Column) -> Column:
            at = F.least(F.floor(place), F.lit(len(self.grid) - 2)).cast("int")
            return F.get(grid, at) + (place - at) * (F.get(grid, at + 1) - F.get(grid, at))

        known = z.cast("double")
        found = F.transform(F.array(normal_share(known) * (len(self.grid) - 1)), between)[0]
        return F.when(known.isNotNull() & ~F.isnan(known), found)


def _array(values: Iterable[float]) -> Column:
    """A constant array; as one text it is one node of the plan until it is folded."""
    return F.expr("cast(split('" + ",".join(repr(float(v)) for v in values) + "', ',') AS array<double>)")


def _place(points: list[float], x: Column) -> Column:
    """Place, from 0, of the last of the ascending points that is not above x; -1 below the first.

    The search halves the points at each of log2(n) steps.
    """
    listed, steps = _array(points), [1 << k for k in reversed(range(len(points).bit_length()))]
    reach = lambda low, step: F.when((low + step < len(points)) & (F.get(listed, low + step) <= x), low + step).otherwise(low)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(-1), reach)
