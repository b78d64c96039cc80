"""Linear models fitted from distributed sums.

One pass (two for many columns) adds up the products of all pairs of columns,
per fold. Everything after that (solving for any penalty, leaving a fold out, the squared error of a
held-out fold) needs those sums only, so a whole path of penalties over all
folds costs no further pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IN_ENGINE_FEATURES = 8


@dataclass(frozen=True)
class Penalty:
    """Penalty of a linear model.

    ``ridge``: squared error + alpha * |w|^2. Others: mean squared error / 2 +
    alpha * l1_ratio * |w|_1 + alpha * (1 - l1_ratio) * |w|^2 / 2.
    """

    kind: str = "ols"
    alpha: float = 0.0
    l1_ratio: float = 1.0


@dataclass
class LinearModel:
    features: list[str]
    coefficients: np.ndarray
    intercept: float
    penalty: Penalty

    def expression(self) -> Column:
        terms = [F.col(c) * float(w) for c, w in zip(self.features, self.coefficients) if w != 0]
        return reduce(lambda a, b: a + b, terms, F.lit(float(self.intercept)))

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return df.withColumn(out, self.expression())

    def table(self, spark) -> DataFrame:
        """Rows (term, coefficient)."""
        rows = [("intercept", float(self.intercept))]
        rows += [(c, float(w)) for c, w in zip(self.features, self.coefficients)]
        return spark.createDataFrame(rows, "term string, coefficient double")


@dataclass
class FoldModels:
    """One model per fold, each fitted on the other folds."""

    models: dict[int, LinearModel]

    def predict_oof(self, df: DataFrame, fold: str = "fold", out: str = "prediction") -> DataFrame:
        """Predict each row by the model that has not seen its fold, in one projection."""
        first = next(iter(self.models.values()))
        pick = lambda value: F.create_map(*[F.lit(x) for f, m in self.models.items()
                                            for x in (f, float(value(m)))])[F.col(fold)]
        terms = [F.col(c) * pick(lambda m, i=i: m.coefficients[i]) for i, c in enumerate(first.features)]
        return df.withColumn(out, reduce(lambda a, b: a + b, terms, pick(lambda m: m.intercept)))

    def average(self) -> LinearModel:
        """The model whose prediction is the mean of the fold models' predictions."""
        models = list(self.models.values())
        return LinearModel(models[0].features, np.mean([m.coefficients for m in models], axis=0),
                           float(np.mean([m.intercept for m in models])), models[0].penalty)


class Sums:
    """Sums of products of (1, features, target), per fold.

    Columns are shifted by their overall means first: sums of large, nearly
    constant columns would leave no digits for their spread.
    """

    def __init__(self, features: Sequence[str], by_fold: dict[int, np.ndarray], shift: np.ndarray):
        self.features = list(features)
        self.by_fold = by_fold
        self.shift = shift
        self.total = sum(by_fold.values())

    def model(self, sums: np.ndarray, penalty: Penalty) -> LinearModel:
        """The model fitted on some of the sums, in terms of the unshifted columns."""
        w, b = solve(sums, penalty)
        return LinearModel(self.features, w, float(b + self.shift[-1] - self.shift[:-1] @ w), penalty)

    def outside(self, fold: int) -> np.ndarray:
        return sum(m for f, m in self.by_fold.items() if f != fold)


def collect_sums(df: DataFrame, features: Sequence[str], target: str, fold: str | None = None) -> Sums:
    """Add up the products; rows with a null feature, target or fold are left out."""
    features = list(features)
    names = [f"z{i}" for i in range(1, len(features) + 2)]
    data = df.select((F.col(fold) if fold else F.lit(0)).cast("int").alias("fold"),
                     *[F.col(c).cast("double").alias(z) for z, c in zip(names, [*features, target])])
    data = data.dropna(subset=names)
    if len(features) <= IN_ENGINE_FEATURES:
        return Sums(features, *_moments_in_engine(data, names))
    shift = np.array(data.agg(*[F.avg(z) for z in names]).first(), dtype=float)
    centred = data.select("fold", *[(F.col(z) - F.lit(float(m))).alias(z) for z, m in zip(names, shift)])
    return Sums(features, _sums_in_arrow(centred, names), shift)


def _moments_in_engine(data: DataFrame, names: list[str]) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """One aggregation of means and covariances per fold, for few columns."""
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    rows = data.groupBy("fold").agg(
        F.count("*").alias("n"), *[F.avg(z).alias(z) for z in names],
        *[F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs]).collect()
    rows = [row for row in rows if row["fold"] is not None]
    means = {row["fold"]: np.array([row[z] for z in names]) for row in rows}
    shift = sum(row["n"] * means[row["fold"]] for row in rows) / sum(row["n"] for row in rows)
    out = {}
    for row in rows:
        away = np.concatenate([[1.0], means[row["fold"]] - shift])
        sums = row["n"] * np.outer(away, away)
        for i, j in pairs:
            sums[i + 1, j + 1] += row["n"] * row[f"c{i}_{j}"]
            sums[j + 1, i + 1] = sums[i + 1, j + 1]
        out[row["fold"]] = sums
    return out, shift


def _sums_in_arrow(data: DataFrame, names: list[str]) -> dict[int, np.ndarray]:
    """Products added up by tasks in Arrow batches, then across tasks as vectors, for many columns."""
    width = len(names) + 1

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[int, np.ndarray] = {}
        for pdf in batches:
            z = np.column_stack([np.ones(len(pdf)), pdf[names].to_numpy(dtype=float)])
            folds = pdf["fold"].to_numpy()
            for f in np.unique(folds[~pd.isna(folds)]):
                rows = z[folds == f]
                acc[int(f)] = acc.get(int(f), 0) + rows.T @ rows
        for f, m in acc.items():
            yield pd.DataFrame({"fold": f, "i": range(width), "v": list(m)})

    parts = data.mapInPandas(partial, "fold int, i int, v array<double>")
    rows = (parts.select("fold", "i", array_to_vector("v").alias("v"))
            .groupBy("fold", "i").agg(Summarizer.sum(F.col("v")).alias("v")).collect())
    out: dict[int, np.ndarray] = {}
    for r in rows:
        out.setdefault(r["fold"], np.zeros((width, width)))[r["i"]] = r["v"].toArray()
    return out


def solve(sums: np.ndarray, penalty: Penalty, start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Coefficients and intercept that minimise the penalised error, from sums of products."""
    n = sums[0, 0]
    mean = sums[0, 1:] / n
    centred = sums[1:, 1:] - n * np.outer(mean, mean)
    xx, xy = centred[:-1, :-1], centred[:-1, -1]
    if penalty.kind == "ols":
        w = np.linalg.lstsq(xx, xy, rcond=None)[0]
    elif penalty.kind == "ridge":
        w = np.linalg.solve(xx + penalty.alpha * np.eye(len(xy)), xy)
    else:
        w = _soft_descent(xx, xy, n * penalty.alpha * penalty.l1_ratio,
                          n * penalty.alpha * (1 - penalty.l1_ratio), start)
    return w, float(mean[-1] - mean[:-1] @ w)


def _soft_descent(xx: np.ndarray, xy: np.ndarray, l1: float, l2: float, start: np.ndarray | None,
                  rounds: int = 20_000, tolerance: float = 1e-9) -> np.ndarray:
    """Minimise w'xx w/2 - xy'w + l1 |w|_1 + l2 |w|^2/2 one coordinate at a time.

    Sweeps over the nonzero coordinates until they settle, then over all, until a
    sweep over all changes nothing any more.
    """
    w = np.zeros(len(xy)) if start is None else start.copy()
    diagonal = np.diag(xx).copy()
    scale = np.sqrt(diagonal)
    live = np.nonzero(diagonal > 0)[0]
    residual = xy - xx @ w

    def sweep(coordinates: np.ndarray) -> bool:
        moved = 0.0
        for j in coordinates:
            pull = residual[j] + diagonal[j] * w[j]
            new = (pull - l1 if pull > l1 else pull + l1 if pull < -l1 else 0.0) / (diagonal[j] + l2)
            change = new - w[j]
            if change:
                residual[:] -= xx[j] * change
                w[j] = new
                moved = max(moved, abs(change) * scale[j])
        return moved > tolerance * max(1.0, float(np.max(np.abs(w) * scale)))

    for _ in range(rounds):
        if not sweep(live):
            break
        for _ in range(rounds):
            if not sweep(np.nonzero(w)[0]):
                break
    return w


def squared_error(sums: np.ndarray, w: np.ndarray, b: float) -> float:
    """Mean squared error of a linear model on the rows behind the sums."""
    v = np.concatenate([[b], w, [-1.0]])
    return float(v @ sums @ v / sums[0, 0])


def fit_linear(df: DataFrame, features: Sequence[str], target: str, penalty: Penalty = Penalty()) -> LinearModel:
    """Fit one linear model in one pass."""
    sums = collect_sums(df, features, target)
    return sums.model(sums.total, penalty)


def fit_linear_by_fold(df: DataFrame, features: Sequence[str], target: str, penalty: Penalty = Penalty(),
                       fold: str = "fold") -> FoldModels:
    """One model per fold, all from one pass."""
    sums = collect_sums(df, features, target, fold)
    return FoldModels({f: sums.model(sums.outside(f), penalty) for f in sorted(sums.by_fold)})


def default_path(sums: np.ndarray, points: int = 100, shrink: float = 1e-3) -> list[float]:
    """Penalties from the smallest that zeroes every coefficient down to ``shrink`` times it."""
    n = sums[0, 0]
    mean = sums[0, 1:] / n
    top = float(np.max(np.abs(sums[1:-1, -1] - n * mean[:-1] * mean[-1]))) / n
    return np.geomspace(top, top * shrink, points).tolist()


def fold_errors(sums: Sums, penalties: Sequence[Penalty]) -> list[tuple[Penalty, int, float]]:
    """Held-out mean squared error for every penalty and fold, from the sums alone."""
    out = []
    for f, held in sorted(sums.by_fold.items()):
        train, warm = sums.outside(f), None
        for p in sorted(penalties, key=lambda p: -p.alpha):
            w, b = solve(train, p, warm)
            warm = w
            out.append((p, f, squared_error(held, w, b)))
    return out


def fit_path_cv(df: DataFrame, features: Sequence[str], target: str, alphas: Sequence[float] | None = None,
                fold: str = "fold", l1_ratio: float = 1.0) -> tuple[LinearModel, DataFrame]:
    """Choose alpha by cross-validation and refit on all rows.

    The largest of equally good alphas is taken. Returns the model and the table
    (alpha, mse): mean over folds of the held-out error.
    """
    sums = collect_sums(df, features, target, fold)
    alphas = list(alphas) if alphas is not None else default_path(sums.total)
    penalties = [Penalty("elastic_net", a, l1_ratio) for a in alphas]
    errors: dict[float, list[float]] = {}
    for p, _, e in fold_errors(sums, penalties):
        errors.setdefault(p.alpha, []).append(e)
    path = [(float(a), float(np.mean(errors[a]))) for a in alphas]
    best = Penalty("elastic_net", min(path, key=lambda r: (r[1], -r[0]))[0], l1_ratio)
    return sums.model(sums.total, best), df.sparkSession.createDataFrame(path, "alpha double, mse double")


def fit_vector_ols(df: DataFrame, vector: str, target: str, rounds: int = 300) -> LinearRegressionModel:
    """Least squares over a vector column of any width, by limited-memory quasi-Newton steps from zero.

    No table of products is built. Terms that never occur keep a zero, and of dependent terms the
    steps come near the solution of least norm. Rows without a target are left out; ``rounds`` bounds the steps.
    """
    learner = LinearRegression(featuresCol=vector, labelCol=target, predictionCol="prediction", regParam=0.0,
                               standardization=False, solver="l-bfgs", maxIter=rounds, tol=1e-9)
    return learner.fit(df.dropna(subset=[target]))


def fit_wide(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], target: str,
             penalty: Penalty = Penalty()) -> PipelineModel:
    """Linear model over sparse one-hot vectors, for more features than fit a dense matrix.

    Null and unseen categories give all zeros. The solver scales the target by
    its deviation, so ridge-type penalties are divided by it here to keep their
    meaning.
    """
    index = [f"{c}_idx" for c in categorical]
    hot = [f"{c}_hot" for c in categorical]
    stages = []
    if categorical:
        stages = [StringIndexer(inputCols=list(categorical), outputCols=index, handleInvalid="keep",
                                stringOrderType="alphabetAsc"),
                  OneHotEncoder(inputCols=index, outputCols=hot, dropLast=True, handleInvalid="error")]
    stages.append(VectorAssembler(inputCols=[*numeric, *hot], outputCol="features"))
    known = df.dropna(subset=[target, *numeric])
    reg, ratio, solver = 0.0, 0.0, "auto"
    if penalty.kind != "ols":
        s = known.agg(F.count("*").alias("n"), F.stddev_pop(target).alias("sd")).first()
        if penalty.kind == "ridge":
            reg, ratio, solver = penalty.alpha * s["sd"] / s["n"], 0.0, "normal"
        else:
            l1, l2 = penalty.alpha * penalty.l1_ratio, penalty.alpha * (1 - penalty.l1_ratio) * s["sd"]
            reg = l1 + l2
            ratio = l1 / reg if reg else 0.0
    stages.append(LinearRegression(featuresCol="features", labelCol=target, predictionCol="prediction",
                                   regParam=reg, elasticNetParam=ratio, standardization=False, solver=solver,
                                   maxIter=1000, tol=1e-10))
    return Pipeline(stages=stages).fit(known)
