"""Preprocessing fitted anew on the rows outside each fold, from sums taken once.

A null number counts as 0 beside a column that marks it, and a label becomes 0/1 columns
with one for null. Mean imputing, scaling to unit deviation, mode imputing and one-hot
columns of any set of rows are then linear in these raw columns. So their sums of products
per fold give, for each complement, its means, deviations, modes and vocabulary, the sums
of its preprocessed design, and the error of a model on the fold left out: one pass over
the rows for all folds and penalties. The solutions are found in tasks, one for each fold and
ratio of the penalties, going down the penalties from the last solution.

Labels become columns of a dense table of sums: for columns of many labels take counts or
target means.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulcast.operators.encode import category_lists
from haulcast.operators.linear import Penalty, collect_sums, solve, squared_error

TRIAL = "trial int, kind string, alpha double, l1_ratio double, score double"


@dataclass
class RawSums:
    """Sums of products per fold of (1, numbers, their null marks, labels, their null marks, target)."""

    numeric: list[str]
    labels: dict[str, list[str]]
    centre: dict[str, float]
    by_fold: dict[int, np.ndarray]

    def outside(self, fold: int | None) -> np.ndarray:
        return sum(s for f, s in self.by_fold.items() if f != fold)


def raw_sums(df: DataFrame, numeric: Sequence[str], labels: Sequence[str], target: str, fold: str = "fold") -> RawSums:
    """Two passes: means to centre by, then the products. Rows without target or fold are left out."""
    known = df.filter(F.col(target).isNotNull() & F.col(fold).isNotNull())
    means = known.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in [*numeric, target]]).first()
    centre = {c: means[c] or 0.0 for c in [*numeric, target]}
    lists = category_lists(known, labels) if labels else {}
    away = lambda c: F.col(c).cast("double") - F.lit(centre[c])
    columns = [F.coalesce(away(c), F.lit(0.0)) for c in numeric]
    columns += [F.col(c).isNull().cast("double") for c in numeric]
    for c in labels:
        text = F.col(c).cast("string")
        columns += [F.coalesce((text == v).cast("double"), F.lit(0.0)) for v in lists[c]] + [text.isNull().cast("double")]
    names = [f"r{k}" for k in range(len(columns))]
    raw = known.select(F.col(fold).alias("f"), *[x.alias(n) for x, n in zip(columns, names)], away(target).alias("y"))
    sums = collect_sums(raw, names, "y", "f")
    # back from the shifted columns of the sums
    back = np.eye(len(names) + 2)
    back[1:, 0] = sums.shift
    return RawSums(list(numeric), lists, centre, {f: back @ s @ back.T for f, s in sums.by_fold.items()})


@dataclass
class Preprocessing:
    """What some rows teach: centred means and deviations of the numbers, modes and seen labels, as a linear map."""

    raw: RawSums
    means: np.ndarray
    deviations: np.ndarray
    modes: dict[str, str | None]
    matrix: np.ndarray

    @classmethod
    def fit(cls, raw: RawSums, sums: np.ndarray) -> "Preprocessing":
        n, k = sums[0, 0], len(raw.numeric)
        x, m = np.arange(1, k + 1), np.arange(k + 1, 2 * k + 1)
        known = n - sums[0, m]
        means = np.divide(sums[0, x], known, out=np.zeros(k), where=known > 0)
        # imputed values add nothing to the spread around the mean
        spread = np.sqrt(np.maximum((sums[x, x] - known * means ** 2) / n, 0.0))
        spread[spread <= 1e-12 * np.sqrt(np.maximum(sums[x, x] / n, 1e-300))] = 1.0
        rows = []
        for i in range(k):
            row = np.zeros(len(sums))
            row[[0, x[i], m[i]]] = np.array([-means[i], 1.0, means[i]]) / spread[i]
            rows.append(row)
        modes, at = {}, 2 * k + 1
        for c, values in raw.labels.items():
            counts = sums[0, at: at + len(values)]
            best = int(np.argmax(np.rint(counts))) if len(values) and counts.max() > 0.5 else None
            modes[c] = None if best is None else values[best]
            for j in range(len(values)):
                row = np.zeros(len(sums))
                if counts[j] > 0.5:
                    row[at + j] = 1.0
                    row[at + len(values)] = float(j == best)
                rows.append(row)
            at += len(values) + 1
        one, y = np.eye(len(sums))[[0, -1]]
        return cls(raw, means, spread, modes, np.vstack([one, *rows, y]))

    def sums(self, raw_sums: np.ndarray) -> np.ndarray:
        """Sums of products of the preprocessed design on some rows."""
        return self.matrix @ raw_sums @ self.matrix.T


@dataclass
class FoldwiseModel:
    """A linear model over the preprocessed design, applied to raw columns in one projection."""

    steps: Preprocessing
    coefficients: np.ndarray
    intercept: float
    penalty: Penalty

    def expression(self, target_centre: float) -> Column:
        raw, out = self.steps.raw, F.lit(self.intercept + target_centre)
        for c, w, mean, sd in zip(raw.numeric, self.coefficients, self.steps.means, self.steps.deviations):
            if w:
                out = out + F.coalesce(F.col(c).cast("double") - F.lit(raw.centre[c] + float(mean)), F.lit(0.0)) * float(w / sd)
        at = len(raw.numeric)
        for c, values in raw.labels.items():
            weights = {v: float(w) for v, w in zip(values, self.coefficients[at: at + len(values)]) if w}
            at += len(values)
            if weights:
                pairs = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
                out = out + F.coalesce(pairs[F.coalesce(F.col(c).cast("string"), F.lit(self.steps.modes[c]))], F.lit(0.0))
        return out

    def predict(self, df: DataFrame, target: str, out: str = "prediction") -> DataFrame:
        return df.withColumn(out, self.expression(self.steps.raw.centre[target]))


def fold_errors(df: DataFrame, raw: RawSums, penalties: Sequence[Penalty]) -> DataFrame:
    """Rows (trial, fold, mse): held-out squared error, everything fitted outside the fold.

    A task solves the penalties of one fold, kind and ratio, warm along falling alphas. The
    driver sends it the sums, whose size depends on the columns, not on the rows.
    """
    units: dict[tuple, list[int]] = {}
    for i, p in enumerate(penalties):
        for f in raw.by_fold:
            units.setdefault((f, p.kind, p.l1_ratio), []).append(i)
    listed = [(f, sorted(trials, key=lambda i: -penalties[i].alpha)) for (f, _, _), trials in units.items()]

    def solve_units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for f, trials in zip(b["fold"], b["trials"]):
                outside = raw.outside(int(f))
                steps = Preprocessing.fit(raw, outside)
                train, held, warm, errors = steps.sums(outside), steps.sums(raw.by_fold[int(f)]), None, []
                for i in trials:
                    warm, intercept = solve(train, penalties[i], warm)
                    errors.append(squared_error(held, warm, intercept))
                yield pd.DataFrame({"trial": list(trials), "fold": int(f), "mse": errors})

    spark = df.sparkSession
    rows = spark.createDataFrame(listed, "fold int, trials array<int>").repartition(len(listed))
    return rows.mapInPandas(solve_units, "trial int, fold int, mse double")


def search_foldwise(df: DataFrame, numeric: Sequence[str], labels: Sequence[str], target: str,
                    penalties: Sequence[Penalty], fold: str = "fold", metric: str = "rmse") -> tuple[DataFrame, FoldwiseModel]:
    """Mean held-out error of every penalty with all preprocessing fitted per fold, and the best one refitted on all rows."""
    raw = raw_sums(df, numeric, labels, target, fold)
    found: dict[int, list[float]] = {}
    for r in fold_errors(df, raw, penalties).orderBy("trial", "fold").collect():  # one number per trial and fold
        found.setdefault(r["trial"], []).append(math.sqrt(r["mse"]) if metric == "rmse" else r["mse"])
    scores = [float(np.mean(found[i])) for i in range(len(penalties))]
    rows = [(i, p.kind, float(p.alpha), float(p.l1_ratio), s) for i, (p, s) in enumerate(zip(penalties, scores))]
    return df.sparkSession.createDataFrame(rows, TRIAL), fit_foldwise(raw, penalties[int(np.argmin(scores))])


def fit_foldwise(raw: RawSums, penalty: Penalty, without: int | None = None) -> FoldwiseModel:
    """A model and its preprocessing, fitted on all folds or on all but one."""
    sums = raw.outside(without)
    steps = Preprocessing.fit(raw, sums)
    w, intercept = solve(steps.sums(sums), penalty)
    return FoldwiseModel(steps, w, intercept, penalty)
