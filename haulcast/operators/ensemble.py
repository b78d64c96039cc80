"""Out-of-fold predictions and models stacked on them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulcast.operators import metrics
from haulcast.operators.blend import blend, inverse_rmse_weights
from haulcast.operators.linear import LinearModel, Penalty, fit_linear
from haulcast.session import materialise

Fitter = Callable[[DataFrame, DataFrame], object]


def fit_folds(df: DataFrame, k: int, fitter: Fitter, fold: str = "fold") -> dict[int, object]:
    """One model per fold: ``fitter(train rows, held-out rows)`` returns a model with ``predict``."""
    return {f: fitter(df.filter(F.col(fold) != f), df.filter(F.col(fold) == f)) for f in range(k)}


def oof_predictions(df: DataFrame, models: Mapping[int, object], fold: str = "fold",
                    out: str = "prediction") -> DataFrame:
    """Each row predicted by the model that was not trained on its fold."""
    parts = [m.predict(df.filter(F.col(fold) == f), out) for f, m in models.items()]
    return reduce(DataFrame.unionByName, parts)


def score_predictions(df: DataFrame, models: Mapping[int, object], out: str = "prediction",
                      back: Callable[[Column], Column] = lambda p: p) -> DataFrame:
    """Mean over the fold models, side by side on the same row, so without a shuffle.

    ``back`` takes each fold's prediction to the original scale before the mean.
    """
    names = []
    for f, m in models.items():
        names.append(f"_p{f}")
        df = m.predict(df, names[-1])
    mean = reduce(lambda a, b: a + b, [back(F.col(n)) for n in names]) / len(names)
    return df.withColumn(out, mean).drop(*names)


def fit_meta(oof: DataFrame, cols: Sequence[str], target: str, alpha: float = 0.01) -> LinearModel:
    """Lasso over out-of-fold prediction columns."""
    return fit_linear(oof, cols, target, Penalty("lasso", alpha))


def blend_with_meta(oof: DataFrame, score: DataFrame, cols: Sequence[str], target: str, alpha: float = 0.01,
                    out: str = "prediction") -> DataFrame:
    """Half inverse-RMSE blend, half meta model, in log space; then back to the original scale."""
    meta = fit_meta(oof, cols, target, alpha)
    mixed = blend(score, inverse_rmse_weights(oof, target, cols), "_blend")
    return (mixed.withColumn(out, F.expm1(0.5 * F.col("_blend") + 0.5 * meta.expression()))
            .drop("_blend"))


def oof_table(train: DataFrame, score: DataFrame, k: int, bases: Mapping[str, Fitter], row_id: str, target: str,
              fold: str = "fold") -> DataFrame:
    """Rows (row_id, model, fold, held, target, prediction) of every base, fitted once for each fold.

    A training row appears once per base, predicted by the model that has not seen its fold
    (``held`` true); a score row once per base and fold (``held`` false, null target). Each fit
    writes its rows before the next one starts, so no later step fits or scores a model again.
    """
    parts = []
    for name, fitter in bases.items():
        for f, model in ((f, fitter(train.filter(F.col(fold) != f), train.filter(F.col(fold) == f))) for f in range(k)):
            sides = [(train.filter(F.col(fold) == f), F.lit(True), F.col(target).cast("double")),
                     (score, F.lit(False), F.lit(None).cast("double"))]
            found = [model.predict(rows, "_prediction").select(
                F.col(row_id), F.lit(name).alias("model"), F.lit(f).alias("fold"), held.alias("held"), y.alias("target"),
                F.col("_prediction").alias("prediction")) for rows, held, y in sides]
            parts.append(materialise(found[0].unionByName(found[1]), "oof"))
    return reduce(DataFrame.unionByName, parts)


def fold_scores(table: DataFrame, back: Callable[[Column], Column] = lambda p: p) -> DataFrame:
    """(model, fold, rows, mae, rmse) of the held-out rows of ``oof_table``; ``back`` leads to the original scale."""
    y, p = back(F.col("target")), back(F.col("prediction"))
    return table.filter("held AND target IS NOT NULL").groupBy("model", "fold").agg(
        F.count("*").alias("rows"), metrics.mae(y, p).alias("mae"), metrics.rmse(y, p).alias("rmse"))


def base_columns(table: DataFrame, row_id: str, names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The table with a column per base: (row_id, target, bases) of training rows, (row_id, bases) of score rows.

    One shuffle by row each. Score rows get the mean over the fold models.
    """
    columns = [F.avg(F.when(F.col("model") == n, F.col("prediction"))).alias(n) for n in names]
    train = table.filter("held").groupBy(row_id).agg(F.max("target").alias("target"), *columns)
    return train, table.filter("not held").groupBy(row_id).agg(*columns)


class Pipelined:
    """A fitted pipeline as a base: its prediction under a name of choice, helper columns left out."""

    def __init__(self, model):
        self.model = model

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return self.model.transform(df).select(*df.columns, F.col("prediction").alias(out))
