"""Regression metrics as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulcast.functions.values import unlog_cost


def mse(y: Column, p: Column) -> Column:
    return F.avg((y - p) * (y - p))


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(mse(y, p))


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def r2(y: Column, p: Column) -> Column:
    """1 - SSE/SST over the rows where both are known; null when y does not vary."""
    both = F.when(p.isNotNull(), y)
    return 1 - F.try_divide(mse(y, p), F.var_pop(both))


def mae_original_scale(y: Column, log_p: Column) -> Column:
    """MAE of predictions made for log(1 + y)."""
    return mae(y, unlog_cost(log_p))


METRICS = {"mse": mse, "rmse": rmse, "mae": mae, "r2": r2, "mae_original_scale": mae_original_scale}


def score(df: DataFrame, target: str, prediction: str, metrics: Sequence[str] = ("mse", "rmse", "mae", "r2"),
          by: Sequence[str] = ()) -> DataFrame:
    """Metrics over all rows, or per group of ``by``."""
    aggs = [METRICS[m](F.col(target), F.col(prediction)).alias(m) for m in metrics]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def fold_summary(df: DataFrame, target: str, prediction: str, metric: str = "mae", fold: str = "fold") -> DataFrame:
    """Mean and population spread of the per-fold metric, folds counting alike."""
    per_fold = score(df, target, prediction, [metric], [fold])
    return per_fold.agg(F.count("*").alias("folds"), F.avg(metric).alias(f"{metric}_mean"),
                        F.stddev_pop(metric).alias(f"{metric}_std"))
