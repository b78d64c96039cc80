"""Models against closed forms, brute force and planted signals."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from haulcast.operators import ensemble, folds, search, trees
from haulcast.operators import linear as lm
from haulcast.operators.knn import knn_predict, nearest_rows
from haulcast.operators.linear import Penalty


def sample(spark, n=400, p=4, seed=1, noise=0.5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) * np.arange(1, p + 1) + 3
    y = x @ np.arange(p, 0, -1) + 5 + noise * rng.normal(size=n)
    names = [f"x{i}" for i in range(p)]
    pdf = pd.DataFrame(x, columns=names).assign(y=y, id=range(n))
    df = folds.assign_folds(spark.createDataFrame(pdf).repartition(4), "id", 5)
    return df, names, x, y


def loss(x, y, w, b, p: Penalty):
    e = y - x @ w - b
    return (e @ e) / (2 * len(y)) + p.alpha * (p.l1_ratio * np.abs(w).sum() + (1 - p.l1_ratio) * w @ w / 2)


@pytest.mark.parametrize("in_engine", [True, False])
def test_ols_and_ridge_closed_forms(spark, monkeypatch, in_engine):
    monkeypatch.setattr(lm, "IN_ENGINE_FEATURES", 8 if in_engine else 0)
    df, names, x, y = sample(spark)
    xc, yc = x - x.mean(0), y - y.mean()
    for alpha in (0.0, 7.0):
        m = lm.fit_linear(df, names, "y", Penalty("ridge", alpha) if alpha else Penalty())
        w = np.linalg.solve(xc.T @ xc + alpha * np.eye(4), xc.T @ yc)
        assert np.allclose(m.coefficients, w) and m.intercept == pytest.approx(y.mean() - x.mean(0) @ w)


@pytest.mark.parametrize("penalty", [Penalty("lasso", 1.5), Penalty("elastic_net", 2.0, 0.3)])
def test_l1_models_are_minima(spark, penalty):
    df, names, x, y = sample(spark)
    m = lm.fit_linear(df, names, "y", penalty)
    best = loss(x, y, m.coefficients, m.intercept, penalty)
    rng = np.random.default_rng(0)
    for _ in range(50):
        w = m.coefficients + 1e-3 * rng.normal(size=4)
        assert loss(x, y, w, y.mean() - x.mean(0) @ w, penalty) >= best - 1e-12


@pytest.mark.parametrize("penalty", [Penalty(), Penalty("ridge", 20.0), Penalty("lasso", 0.7),
                                     Penalty("elastic_net", 0.9, 0.4)])
def test_wide_model_agrees(spark, penalty):
    df, names, _, _ = sample(spark)
    wide = lm.fit_wide(df, names, [], "y", penalty).stages[-1]
    dense = lm.fit_linear(df, names, "y", penalty)
    assert np.allclose(wide.coefficients.toArray(), dense.coefficients, atol=2e-4)


def test_wide_model_takes_unseen_and_null_categories(rows):
    df = rows([(1.0, "a", 1.0), (2.0, "b", 2.5), (3.0, None, 3.0), (4.0, "a", 4.2)], "x double, c string, y double")
    out = lm.fit_wide(df, ["x"], ["c"], "y").transform(rows([(1.0, "new", 0.0), (1.0, None, 0.0)],
                                                           "x double, c string, y double"))
    assert len({round(r["prediction"], 6) for r in out.collect()}) == 1


def test_sums_survive_large_offsets(spark):
    df, names, x, y = sample(spark)
    far = df.withColumns({c: F.col(c) + 1e7 for c in names})
    assert np.allclose(lm.fit_linear(far, names, "y").coefficients, lm.fit_linear(df, names, "y").coefficients, atol=1e-5)


def test_null_rows_are_left_out(spark):
    df, names, x, y = sample(spark)
    holed = df.withColumn("x0", F.when(F.col("id") % 7 != 0, F.col("x0"))).withColumn(
        "y", F.when(F.col("id") % 11 != 0, F.col("y")))
    full = df.filter("id % 7 <> 0 and id % 11 <> 0")
    assert np.allclose(lm.fit_linear(holed, names, "y").coefficients, lm.fit_linear(full, names, "y").coefficients)


def test_fold_models_and_errors_from_sums(spark):
    df, names, _, _ = sample(spark)
    pdf = df.toPandas()
    sums = lm.collect_sums(df, names, "y", "fold")
    errors = {f: e for _, f, e in lm.fold_errors(sums, [Penalty()])}
    oof = lm.fit_linear_by_fold(df, names, "y").predict_oof(df).toPandas()
    for f in range(5):
        rest, held = pdf[pdf.fold != f], oof[oof.fold == f]
        a = np.column_stack([np.ones(len(rest)), rest[names]])
        w = np.linalg.lstsq(a, rest.y, rcond=None)[0]
        assert np.allclose(held.prediction, w[0] + held[names].to_numpy() @ w[1:])
        assert errors[f] == pytest.approx(((held.y - held.prediction) ** 2).mean())


def test_average_model_is_the_mean_prediction(spark):
    df, names, _, _ = sample(spark)
    models = lm.fit_linear_by_fold(df, names, "y")
    each = [m.predict(df).toPandas().set_index("id").prediction for m in models.models.values()]
    mean = models.average().predict(df).toPandas().set_index("id").prediction
    assert np.allclose(mean.sort_index(), sum(e.sort_index() for e in each) / 5)


def test_path_prefers_larger_alpha_on_ties_and_finds_signal(spark):
    df, names, _, _ = sample(spark)
    flat, _ = lm.fit_path_cv(df, names, "y", [1e6, 1e5])
    assert flat.penalty.alpha == 1e6 and not flat.coefficients.any()
    model, path = lm.fit_path_cv(df, names, "y")
    assert path.count() == 100 and np.allclose(model.coefficients, [4, 3, 2, 1], atol=0.1)


def test_search_scores_match_rows(spark):
    df, names, _, _ = sample(spark)
    penalties = [Penalty("ridge", 5.0), Penalty("lasso", 2.0)]
    for metric in ("mse", "mae"):
        trials, best = search.search_linear(df, names, "y", penalties, metric=metric)
        scores = {r["trial"]: r["score"] for r in trials.collect()}
        for i, p in enumerate(penalties):
            oof = lm.fit_linear_by_fold(df, names, "y", p).predict_oof(df).toPandas()
            e = (oof.y - oof.prediction).abs() if metric == "mae" else (oof.y - oof.prediction) ** 2
            assert scores[i] == pytest.approx(e.groupby(oof.fold).mean().mean())
        assert search.best_trial(trials).first()["trial"] == min(scores, key=scores.get)
        assert best.penalty == penalties[min(scores, key=scores.get)]


def test_grid_and_draws():
    assert len(search.grid(a=[1, 2], b=[3, 4, 5])) == 6
    ranges = {"rate": (0.01, 0.1, "log"), "depth": (2, 5, "int"), "share": (0.6, 1.0)}
    trials = search.draws(ranges, 200)
    assert trials == search.draws(ranges, 200) and trials != search.draws(ranges, 200, seed=1)
    assert {t["depth"] for t in trials} == {2, 3, 4, 5}
    assert all(0.01 <= t["rate"] <= 0.1 and 0.6 <= t["share"] <= 1 for t in trials)
    assert np.median([t["rate"] for t in trials]) == pytest.approx(0.0316, rel=0.2)


def brute(train, query, k):
    out = {}
    for q in query.itertuples():
        d = np.round(np.sqrt(((np.stack(train.v) - q.v) ** 2).sum(1)), 9)
        near = train.assign(d=d).sort_values(["d", "id"]).head(k)
        out[q.id] = near.y.mean()
    return out


@pytest.mark.parametrize("cells, block", [(1, 20_000), (16, 20_000), (16, 25)])
def test_knn_equals_brute_force(spark, cells, block):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 3)) * 10
    v = np.concatenate([centres[rng.integers(0, 8, 300)] + rng.normal(size=(300, 3)), np.zeros((150, 3))])
    pdf = pd.DataFrame({"id": range(450), "v": list(v), "y": rng.normal(size=450)})
    df = spark.createDataFrame(pdf.assign(v=pdf.v.map(list)))
    train, query = df.filter("id % 4 <> 0"), df.filter("id % 4 = 0")
    found = knn_predict(train, query, "v", "y", "id", 5, cells, block).toPandas().set_index("id").prediction
    expected = brute(pdf[pdf.id % 4 != 0], pdf[pdf.id % 4 == 0], 5)
    assert set(found.index) == set(expected)
    assert all(found[i] == pytest.approx(e) for i, e in expected.items())


def test_knn_with_fewer_rows_than_neighbours(rows):
    train = rows([(1, [0.0], 2.0), (2, [1.0], 4.0), (3, [5.0], None)], "id int, v array<double>, y double")
    query = rows([(9, [0.1]), (10, None), (11, [None])], "id int, v array<double>")
    assert sorted(map(tuple, knn_predict(train, query, "v", "y", "id", 5).collect())) == [(9, 3.0), (10, None), (11, None)]
    assert nearest_rows(train, query, "v", "y", "id", 1).first()["tkey"] == 1
    nothing = knn_predict(train.filter("id = 3"), query, "v", "y", "id", 5)
    assert {r.prediction for r in nothing.collect()} == {None} and nothing.count() == 3


@pytest.mark.parametrize("shift", [0.0, 1e8])
def test_knn_far_from_the_origin_with_incomplete_rows(spark, shift):
    rng = np.random.default_rng(8)
    # steps of 1/8 stay exact after the shift
    pdf = pd.DataFrame({"id": range(400), "v": list(rng.integers(0, 80, (400, 3)) / 8 + shift), "y": rng.normal(size=400)})
    expected = brute(pdf[pdf.id % 4 != 0], pdf[pdf.id % 4 == 0], 5)
    table = [(int(i), v.tolist(), float(y)) for i, v, y in pdf.itertuples(index=False)]
    df = spark.createDataFrame(table, "id int, v array<double>, y double")
    broken = spark.createDataFrame([(1001, [None, shift, shift], 9e9), (1002, [shift, float("nan"), shift], 9e9)], df.schema)
    found = knn_predict(df.filter("id % 4 <> 0").union(broken), df.filter("id % 4 = 0"), "v", "y", "id", 5, 20, 50).toPandas()
    found = found.set_index("id").prediction
    assert set(found.index) == set(expected) and all(found[i] == pytest.approx(e) for i, e in expected.items())


def planted(spark, n=2000):
    df = spark.range(n).select(
        "id", (F.col("id") * 7919 % 100).cast("double").alias("a"),
        F.element_at(F.array(*[F.lit(c) for c in "pqr"]), (F.col("id") % 3 + 1).cast("int")).alias("c"))
    signal = F.when(F.col("a") > 50, 10.0).otherwise(0.0) + F.when(F.col("c") == "q", 5.0).otherwise(0.0)
    return folds.assign_folds(df.withColumn("y", signal), "id", 2)


def test_boosting_learns_and_loss_variants(spark):
    df = planted(spark)
    spread = df.agg(F.var_pop("y")).first()[0]
    for config in (trees.with_rounds(trees.BOOSTED, 10), trees.with_rounds(trees.LEAFWISE_SHALLOW, 10)):
        model = trees.fit_gbt(df, ["a"], ["c"], "y", config)
        out = model.predict(df)
        assert out.columns == [*df.columns, "prediction"]
        assert out.agg(F.avg((F.col("y") - F.col("prediction")) ** 2)).first()[0] < 0.2 * spread


def test_early_stopping_keeps_best_round(spark):
    df = planted(spark)
    model = trees.fit_gbt(df.filter("fold = 0"), ["a"], ["c"], "y", trees.with_rounds(trees.BOOSTED, 6),
                          df.filter("fold = 1"), 3)
    assert model.rounds == trees.best_round(model.errors, 3) and model.model.getNumTrees == model.rounds


def test_best_round_rule():
    assert trees.best_round([5, 4, 3, 3, 2]) == 5
    assert trees.best_round([5, 4, 4.5, 4.6, 1], patience=2) == 2
    assert trees.best_round([1, 1, 1]) == 1


def test_tree_and_forest(spark):
    df = planted(spark)
    for model in (trees.fit_tree(df, ["a"], ["c"], "y", depth=3), trees.fit_forest(df, ["a"], ["c"], "y", 8, 5)):
        error = model.predict(df).agg(F.avg((F.col("y") - F.col("prediction")) ** 2)).first()[0]
        assert error < 5


def test_trees_take_wide_categories(spark):
    df = planted(spark).withColumn("wide", (F.col("id") % 1_001).cast("string"))
    model = trees.fit_tree(df, ["a"], ["wide"], "y", 2)
    assert model.predict(df).filter("prediction is not null").count() == 2_000


def test_trees_keep_rows_with_missing_numbers(spark):
    df = planted(spark).withColumn("a", F.when(F.col("id") % 10 == 0, None).when(F.col("id") % 10 == 1, float("nan"))
                                   .otherwise(F.col("a")))
    df = df.withColumn("y", F.when(F.col("id") % 10 < 2, 77.0).otherwise(F.col("y")))
    model = trees.fit_tree(df, ["a"], ["c"], "y", depth=4)
    rows = model.predict(df).collect()
    assert len(rows) == 2_000
    assert all(abs(r.prediction - 77) < 1e-6 for r in rows if r.id % 10 < 2)


def test_fold_predictions_leave_the_log_scale_before_the_mean(spark):
    df = planted(spark)
    models = ensemble.fit_folds(df, 2, lambda t, v: trees.fit_tree(t, ["a"], ["c"], "y", 2))
    some = df.filter("id < 5")
    both = [np.expm1(m.predict(some).orderBy("id").toPandas().prediction) for m in models.values()]
    mean = ensemble.score_predictions(some, models, back=F.expm1).orderBy("id").toPandas().prediction
    assert np.allclose(mean, sum(both) / 2)


def test_out_of_fold_and_score_average(spark):
    df = planted(spark)
    models = ensemble.fit_folds(df, 2, lambda t, v: trees.fit_tree(t, ["a"], ["c"], "y", 2))
    oof = ensemble.oof_predictions(df, models)
    assert oof.count() == 2000 and oof.select("id").distinct().count() == 2000
    both = [m.predict(df.filter("id < 5")).orderBy("id").toPandas().prediction for m in models.values()]
    mean = ensemble.score_predictions(df.filter("id < 5"), models).orderBy("id").toPandas().prediction
    assert np.allclose(mean, sum(both) / 2)


def brute_tree(x, y, rows, depth, min_rows):
    """Predictions per row of the greedy tree that lessens squared error most at each cut."""
    mean = sum(y[i] for i in rows) / len(rows)
    best = None
    for f in range(len(x[0])) if depth else ():
        for cut in sorted({x[i][f] for i in rows})[:-1]:
            low, high = [i for i in rows if x[i][f] <= cut], [i for i in rows if x[i][f] > cut]
            if min(len(low), len(high)) < min_rows:
                continue
            gain = sum(y[i] for i in low) ** 2 / len(low) + sum(y[i] for i in high) ** 2 / len(high)
            if best is None or gain > best[0] + 1e-9:
                best = gain, low, high
    if best is None or best[0] - mean * mean * len(rows) <= 1e-9:
        return {i: mean for i in rows}
    return brute_tree(x, y, best[1], depth - 1, min_rows) | brute_tree(x, y, best[2], depth - 1, min_rows)


def brute_rows(spark, count=60):
    rnd = random.Random(12)
    x = [(float(rnd.randint(0, 9)), float(rnd.randint(0, 6)), float(rnd.randint(0, 4))) for _ in range(count)]
    y = [3 * a + (5 * b if a > 4 else -2 * b) + c + rnd.gauss(0, 2) for a, b, c in x]
    df = spark.createDataFrame([(i, *v, t) for i, (v, t) in enumerate(zip(x, y))], "id int, a double, b double, c double, y double")
    return x, y, df


@pytest.mark.parametrize("depth, min_rows", [(1, 1), (3, 1), (4, 5)])
def test_tree_equals_brute_force(spark, depth, min_rows):
    x, y, df = brute_rows(spark)
    model = trees.fit_tree(df, ["a", "b", "c"], [], "y", depth=depth, min_rows=min_rows)
    want = brute_tree(x, y, list(range(len(y))), depth, min_rows)
    got = {r.id: r.prediction for r in model.predict(df).collect()}
    assert got == pytest.approx(want, abs=1e-9)


def test_boosting_equals_brute_force(spark):
    x, y, df = brute_rows(spark)
    config = trees.TreeConfig(trees=6, depth=3, rate=0.3, min_rows=2)
    model = trees.fit_gbt(df, ["a", "b", "c"], [], "y", config)
    so_far = brute_tree(x, y, list(range(len(y))), 3, 2)
    for _ in range(5):
        tree = brute_tree(x, [t - so_far[i] for i, t in enumerate(y)], list(range(len(y))), 3, 2)
        so_far = {i: p + 0.3 * tree[i] for i, p in so_far.items()}
    assert {r.id: r.prediction for r in model.predict(df).collect()} == pytest.approx(so_far, abs=1e-9)


def test_forest_is_the_mean_of_its_trees(spark):
    _, _, df = brute_rows(spark)
    model = trees.fit_forest(df, ["a", "b", "c"], [], "y", 7, 3)
    scored = model.assembler.transform(df)
    each = [t.setPredictionCol("p").transform(scored).select("id", "p").collect() for t in model.model.trees]
    mean = {rows[0].id: sum(r.p for r in rows) / len(rows) for rows in zip(*each)}
    assert {r.id: r.prediction for r in model.predict(df).collect()} == pytest.approx(mean)


@pytest.mark.parametrize("loss", ["squared", "absolute"])
def test_boosting_goes_on_as_if_never_stopped(spark, monkeypatch, loss):
    """A short first fit and slabs after it give the trees and errors of one long fit."""
    _, _, df = brute_rows(spark, 200)
    train, valid = df.filter("id % 4 > 0"), df.filter("id % 4 = 0")
    config = trees.TreeConfig(trees=11, depth=2, rate=0.2, loss=loss)
    whole = trees.fit_gbt(train, ["a", "b", "c"], [], "y", config, valid, 9)
    monkeypatch.setattr(trees, "FIRST_PATIENCES", 0.5)
    monkeypatch.setattr(trees, "SLAB_ROUNDS", 3)
    parts = trees.fit_gbt(train, ["a", "b", "c"], [], "y", config, valid, 8)
    assert len(parts.errors) > 4 and parts.errors == pytest.approx(whole.errors[: len(parts.errors)])
    assert {r.id: r.prediction for r in parts.predict(df).collect()} == pytest.approx(
        {r.id: r.prediction for r in whole.predict(df).collect()}, abs=1e-9)


def test_cut_back_model_predicts_with_the_trees_it_keeps(spark):
    _, _, df = brute_rows(spark)
    noise = df.withColumn("y", F.rand(5))
    config = trees.TreeConfig(trees=30, depth=4, rate=0.5)
    model = trees.fit_gbt(noise.filter("id % 2 = 0"), ["a", "b", "c"], [], "y", config, noise.filter("id % 2 = 1"), 5)
    assert model.rounds < 30 and model.model.getNumTrees == model.rounds
    scored = model.assembler.transform(df)
    total = {r.id: 0.0 for r in df.collect()}
    for tree, weight in zip(model.model.trees, model.model.treeWeights):
        for r in tree.setPredictionCol("p").transform(scored).select("id", "p").collect():
            total[r.id] += weight * r.p
    assert {r.id: r.prediction for r in model.predict(df).collect()} == pytest.approx(total)
    assert model.errors[model.rounds - 1] == min(model.errors)
