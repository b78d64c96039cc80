"""Preprocessing per fold from sums against fitting every step on the rows outside the fold."""

import numpy as np
import pandas as pd
import pytest

from haulcast.operators import foldwise
from haulcast.operators.linear import Penalty, solve, squared_error

PENALTIES = [Penalty(), Penalty("ridge", 3.0), Penalty("lasso", 0.05), Penalty("elastic_net", 0.1, 0.3)]


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(7)
    n = 300
    pdf = pd.DataFrame({"id": range(n), "fold": rng.integers(0, 4, n), "a": rng.normal(1e6, 3, n), "b": rng.exponential(2, n),
                        "c": rng.choice(["p", "q", "r"], n), "d": rng.choice(["u", "v"], n)})
    pdf["y"] = 100 + 0.5 * (pdf.a - 1e6) - pdf.b + (pdf.c == "q") * 2 + rng.normal(size=n)
    pdf.loc[rng.random(n) < 0.2, "a"] = None
    pdf.loc[rng.random(n) < 0.1, "c"] = None
    pdf.loc[(pdf.fold == 2) & (pdf.index % 3 == 0), "d"] = "only in one fold"
    pdf["constant"] = 4.0
    return pdf


def step_by_step(rows, train):
    """The design of ``rows`` with every statistic taken from ``train``."""
    out = []
    for c in ("a", "b", "constant"):
        mean = train[c].mean()
        sd = train[c].fillna(mean).std(ddof=0)
        out.append((rows[c].fillna(mean) - mean) / (sd if sd > 1e-9 else 1.0))
    for c in ("c", "d"):
        seen = train[c].value_counts()
        mode = sorted(seen.index, key=lambda v: (-seen[v], v))[0]
        out += [(rows[c].fillna(mode) == v).astype(float) for v in sorted(seen.index)]
    return np.column_stack(out)


def sums(x, y):
    z = np.column_stack([np.ones(len(y)), x, y])
    return z.T @ z


def frame(spark, table):
    clean = table.astype(object).where(table.notna(), None)
    schema = "id int, fold int, a double, b double, c string, d string, y double, constant double"
    return spark.createDataFrame([tuple(r) for r in clean[["id", "fold", "a", "b", "c", "d", "y", "constant"]].values.tolist()], schema)


def test_errors_equal_refitted_steps(spark, table):
    df = frame(spark, table)
    raw = foldwise.raw_sums(df, ["a", "b", "constant"], ["c", "d"], "y")
    found = {(r.trial, r.fold): r.mse for r in foldwise.fold_errors(df, raw, PENALTIES).collect()}
    assert len(found) == 4 * len(PENALTIES)
    for f in range(4):
        train, held = table[table.fold != f], table[table.fold == f]
        x, v = step_by_step(train, train), step_by_step(held, train)
        middle = train.y.mean()
        for i, p in enumerate(PENALTIES):
            w, b = solve(sums(x, train.y - middle), p)
            want = squared_error(sums(v, held.y - middle), w, b)
            assert found[i, f] == pytest.approx(want, rel=1e-5)


def test_best_model_predicts_raw_rows(spark, table):
    df = frame(spark, table)
    trials, model = foldwise.search_foldwise(df, ["a", "b", "constant"], ["c", "d"], "y", PENALTIES[1:])
    scores = [r.score for r in trials.orderBy("trial").collect()]
    assert model.penalty == PENALTIES[1 + int(np.argmin(scores))]
    x = step_by_step(table, table)
    w, b = solve(sums(x, table.y - table.y.mean()), model.penalty)
    got = {r.id: r.prediction for r in model.predict(df, "y").collect()}
    assert [got[i] for i in table.id] == pytest.approx((x @ w + b + table.y.mean()).tolist(), rel=1e-6)
    strange = spark.createDataFrame([(1, 0, None, None, "new", None, None, None)], df.schema)
    assert model.predict(strange, "y").first().prediction is not None


def test_columns_without_values(rows):
    df = rows([(0, None, None, 1.0), (1, None, None, 3.0), (1, None, None, 5.0), (None, 1.0, "x", 9.0), (0, None, None, None)],
              "fold int, a double, c string, y double")
    raw = foldwise.raw_sums(df, ["a"], ["c"], "y")
    errors = {r.fold: r.mse for r in foldwise.fold_errors(df, raw, [Penalty("ridge", 1.0)]).collect()}
    assert errors == pytest.approx({0: 9.0, 1: 10.0})
