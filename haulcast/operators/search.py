"""Parameter searches that return their trials as a table."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import replace
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulcast.operators.linear import LinearModel, Penalty, collect_sums, fold_errors
from haulcast.operators.metrics import METRICS
from haulcast.operators.trees import TreeConfig, fit_boosted, tree_features

TRIAL = "trial int, parameters string, score double"


def grid(**values: Sequence) -> list[dict]:
    """All combinations of the given parameter values."""
    return [dict(zip(values, combo)) for combo in product(*values.values())]


def log_spaced(low: float, high: float, points: int) -> list[float]:
    return np.geomspace(low, high, points).tolist()


def evenly_spaced(low: float, high: float, points: int) -> list[float]:
    return np.linspace(low, high, points).tolist()


def describe(parameters: Mapping) -> str:
    return ", ".join(f"{k}={v:.6g}" if isinstance(v, float) else f"{k}={v}" for k, v in parameters.items())


def best_trial(trials: DataFrame) -> DataFrame:
    """The trial with the lowest score, the earliest on ties."""
    return trials.orderBy(F.asc_nulls_last("score"), "trial").limit(1)


def search_linear(df: DataFrame, features: Sequence[str], target: str, penalties: Sequence[Penalty],
                  fold: str = "fold", metric: str = "mse") -> tuple[DataFrame, LinearModel]:
    """Score linear models by the mean of their held-out fold errors; refit the best on all rows.

    Squared errors come from the sums of the single fitting pass. Absolute errors
    take one more pass that scores all trials side by side.
    """
    sums = collect_sums(df, features, target, fold)
    if metric in ("mse", "rmse"):
        found: dict[Penalty, list[float]] = {}
        for p, _, e in fold_errors(sums, penalties):
            found.setdefault(p, []).append(e if metric == "mse" else math.sqrt(e))
        scores = [float(np.mean(found[p])) for p in penalties]
    else:
        scores = _scores_by_rows(df, sums, penalties, target, fold, metric)
    rows = [(i, describe({"kind": p.kind, "alpha": p.alpha, "l1_ratio": p.l1_ratio}), s)
            for i, (p, s) in enumerate(zip(penalties, scores))]
    best = penalties[int(np.argmin(scores))]
    return df.sparkSession.createDataFrame(rows, TRIAL), sums.model(sums.total, best)


# errors per row of the metrics that sums of products cannot give
ROW_ERRORS = {"mae": lambda y, p: np.abs(y - p), "mae_original_scale": lambda y, p: np.abs(y - np.expm1(p))}


def _scores_by_rows(df, sums, penalties, target, fold, metric) -> list[float]:
    """Mean held-out metric per trial: every batch is scored by all trials of its fold at once."""
    models = {f: [sums.model(sums.outside(f), p) for p in penalties] for f in sums.by_fold}
    weights = {f: np.column_stack([m.coefficients for m in ms]) for f, ms in models.items()}
    intercepts = {f: np.array([m.intercept for m in ms]) for f, ms in models.items()}
    names, errors = [f"z{i}" for i in range(len(sums.features))], ROW_ERRORS[metric]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for f, rows in pdf.groupby("fold"):
                p = rows[names].to_numpy(dtype=float) @ weights[int(f)] + intercepts[int(f)]
                e = errors(rows["y"].to_numpy(dtype=float)[:, None], p)
                yield pd.DataFrame({"fold": int(f), "trial": range(e.shape[1]), "e": e.sum(0), "n": len(rows)})

    data = df.select(F.col(fold).cast("int").alias("fold"), F.col(target).cast("double").alias("y"),
                     *[F.col(c).cast("double").alias(z) for z, c in zip(names, sums.features)])
    parts = data.dropna(subset=["y", *names]).mapInPandas(partial, "fold int, trial int, e double, n long")
    per_fold = parts.groupBy("trial", "fold").agg((F.sum("e") / F.sum("n")).alias("m"))
    scored = {r["trial"]: r["s"] for r in per_fold.groupBy("trial").agg(F.avg("m").alias("s")).collect()}
    return [scored[i] for i in range(len(penalties))]


def search_trees(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], target: str, base: TreeConfig,
                 trials: Sequence[Mapping], k: int, fold: str = "fold", metric: str = "mse",
                 patience: int | None = None, original: str | None = None) -> DataFrame:
    """Mean held-out metric of boosted trees for every parameter set.

    The rows outside a fold are binned once, and one stage grows the trees of all trials
    over them; one pass over the fold scores them all.
    ``original`` names the untransformed target for metrics on its own scale.
    """
    known = df.dropna(subset=[target])
    assembler, bins, _ = tree_features(known, numeric, categorical)
    truth = original or target
    configs = [replace(base, **t) for t in trials]
    sizes = {r[0]: r[1] for r in known.groupBy(fold).agg(F.count("*")).collect()}
    found: dict[int, list[float]] = {i: [] for i in range(len(trials))}
    for f in range(k):
        train, held = known.filter(F.col(fold) != f), known.filter(F.col(fold) == f)
        rows = sum(n for g, n in sizes.items() if g is not None and g != f)
        models = {}
        # trials with as many bins share the cuts
        for some in {c.bins: [i for i, d in enumerate(configs) if d.bins == c.bins] for c in configs}.values():
            fits = fit_boosted(assembler, train, target, [configs[i] for i in some], bins, rows,
                               held if patience else None, patience, sum(sizes.values()))
            models |= dict(zip(some, fits))
        scored = held
        for i, model in models.items():
            scored = model.predict(scored, f"_p{i}")
        scores = scored.agg(*[METRICS[metric](F.col(truth), F.col(f"_p{i}")).alias(f"_p{i}") for i in models]).first()
        for i in models:
            found[i].append(scores[f"_p{i}"])
    # a trial is ranked by all folds or by none
    rows = [(i, describe(p), None if None in found[i] else float(np.mean(found[i]))) for i, p in enumerate(trials)]
    return df.sparkSession.createDataFrame(rows, TRIAL)


def draws(ranges: Mapping[str, tuple], count: int, seed: int = 42) -> list[dict]:
    """Random parameter sets; trial t always gets the same values.

    A range is (low, high) for a float, (low, high, 'log') for a log-uniform
    float and (low, high, 'int') for an integer with both ends included.
    """
    trials = []
    for t in range(count):
        values = {}
        for name, (low, high, *kind) in ranges.items():
            digest = hashlib.md5(f"{seed}|{t}|{name}".encode()).hexdigest()
            u = int(digest[:12], 16) / 16 ** 12
            if kind == ["log"]:
                values[name] = math.exp(math.log(low) + u * (math.log(high) - math.log(low)))
            elif kind == ["int"]:
                values[name] = int(low + math.floor(u * (high - low + 1)))
            else:
                values[name] = low + u * (high - low)
        trials.append(values)
    return trials
