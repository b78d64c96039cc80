"""Metrics, blends and prediction repair on prediction columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from haulcast.operators import blend, folds, metrics
from haulcast.plans.registry import bucket, query, r, rounded, ships

Y = "transport_cost"
COLUMNS = ["row_id", Y, "equipment_value", "base_transport_fee", "equipment_width", "is_train"]

# three stand-in models, as expressions of columns the target does not contain
MODELS = {"p1": "20 * equipment_value + 1000 * equipment_width - 20000",
          "p2": "0.4 * base_transport_fee - 15000",
          "p3": "3000 * equipment_width - 40000"}
PREDICTED = "SELECT row_id, transport_cost AS y, is_train, " + bucket("row_id", 42, 5) + " AS fold, " + ", ".join(
    f"{e} AS {n}" for n, e in MODELS.items()) + " FROM shipments"
LOGGED = ("SELECT row_id, y, fold, ln(1 + CASE WHEN p1 < 0 THEN 0 ELSE p1 END) AS lp FROM predicted WHERE y > 0")


def predicted(spark, d):
    df = ships(spark, d, *COLUMNS).withColumns({n: F.expr(e) for n, e in MODELS.items()})
    df = folds.assign_folds(df, "row_id", 5)
    return df.select("row_id", F.col(Y).alias("y"), "is_train", "fold", *MODELS)


@query("metric_mse", f"SELECT {r('avg((y - p1) * (y - p1))', 0)} AS mse FROM predicted", predicted=PREDICTED)
def metric_mse(spark, d):
    return rounded(metrics.score(predicted(spark, d), "y", "p1", ["mse"]), "mse", digits=0)


@query("metric_rmse", f"SELECT {r('sqrt(avg((y - p1) * (y - p1)))')} AS rmse FROM predicted", predicted=PREDICTED)
def metric_rmse(spark, d):
    return rounded(metrics.score(predicted(spark, d), "y", "p1", ["rmse"]), "rmse")


@query("metric_mae", f"SELECT {r('avg(abs(y - p1))')} AS mae FROM predicted", predicted=PREDICTED)
def metric_mae(spark, d):
    return rounded(metrics.score(predicted(spark, d), "y", "p1", ["mae"]), "mae")


@query("metric_r2", f"""
SELECT {r('1 - sum((y - p1) * (y - p1)) / sum((y - m) * (y - m))')} AS r2
FROM predicted, (SELECT avg(y) AS m FROM predicted)""", predicted=PREDICTED)
def metric_r2(spark, d):
    return rounded(metrics.score(predicted(spark, d), "y", "p1", ["r2"]), "r2")


def _logged(spark, d):
    df = predicted(spark, d).filter("y > 0")
    return df.select("row_id", "y", "fold", F.log1p(F.when(F.col("p1") < 0, 0.0).otherwise(F.col("p1"))).alias("lp"))


@query("metric_mae_original_scale", f"SELECT {r('avg(abs(y - (exp(lp) - 1)))')} AS mae_original_scale FROM logged",
       predicted=PREDICTED, logged=LOGGED)
def metric_mae_original_scale(spark, d):
    out = metrics.score(_logged(spark, d), "y", "lp", ["mae_original_scale"])
    return rounded(out, "mae_original_scale")


@query("metric_fold_summary", f"""
SELECT count(*) AS folds, {r('avg(m)')} AS mae_mean, {r('stddev_pop(m)')} AS mae_std
FROM (SELECT fold, avg(abs(y - p1)) AS m FROM predicted GROUP BY fold)""", predicted=PREDICTED)
def metric_fold_summary(spark, d):
    return rounded(metrics.fold_summary(predicted(spark, d), "y", "p1"), "mae_mean", "mae_std")


# each row's mean target of the other folds: the simplest out-of-fold model
BASELINE = " UNION ALL ".join(
    f"SELECT row_id, y, {f}::int AS fold, (SELECT avg(y) FROM predicted WHERE fold <> {f}) AS p FROM predicted "
    f"WHERE fold = {f}" for f in range(5))


def _baseline(spark, d):
    from haulcast.operators.stats import fit_excluding
    df = predicted(spark, d)
    return df.select("row_id", "y", "fold", fit_excluding(df, "fold", ["y"])("y", "mean").alias("p"))


@query("metric_oof_rmse", f"SELECT {r('sqrt(avg((y - p) * (y - p)))')} AS rmse FROM baseline",
       predicted=PREDICTED, baseline=BASELINE)
def metric_oof_rmse(spark, d):
    return rounded(metrics.score(_baseline(spark, d), "y", "p", ["rmse"]), "rmse")


@query("oof_mean_baseline", f"SELECT row_id, fold, {r('p')} AS p FROM baseline",
       predicted=PREDICTED, baseline=BASELINE)
def oof_mean_baseline(spark, d):
    return rounded(_baseline(spark, d).select("row_id", "fold", "p"), "p")


@query("score_fold_average_long", f"""
SELECT row_id, {r('(p1 + p2 + p3) / 3')} AS prediction FROM predicted WHERE NOT is_train""", predicted=PREDICTED)
def score_fold_average_long(spark, d):
    df = predicted(spark, d).filter("not is_train")
    long = df.select("row_id", F.explode(F.array("p1", "p2", "p3")).alias("p"))
    return rounded(blend.fold_average(long, "row_id", "p"), "prediction")


@query("blend_equal", f"""
SELECT row_id, {r('0.5 * p1 + 0.5 * p2')} AS two, {r('(p1 + p2 + p3) / 3')} AS three FROM predicted""",
       predicted=PREDICTED)
def blend_equal(spark, d):
    df = blend.blend_equal(predicted(spark, d), ["p1", "p2"], "two")
    return rounded(blend.blend_equal(df, ["p1", "p2", "p3"], "three").select("row_id", "two", "three"), "two", "three")


@query("blend_weighted", f"""
SELECT row_id, {r('0.25 * p1 + 0.25 * p2 + 0.5 * p3')} AS prediction FROM predicted""", predicted=PREDICTED)
def blend_weighted(spark, d):
    df = blend.blend(predicted(spark, d), {"p1": 0.25, "p2": 0.25, "p3": 0.5})
    return rounded(df.select("row_id", "prediction"), "prediction")


@query("blend_inverse_rmse", f"""
SELECT row_id, {r('(p1 / e1 + p2 / e2) / (1 / e1 + 1 / e2)')} AS prediction
FROM predicted, (SELECT sqrt(avg((y - p1) ** 2)) AS e1, sqrt(avg((y - p2) ** 2)) AS e2 FROM predicted WHERE is_train)
WHERE NOT is_train""", predicted=PREDICTED)
def blend_inverse_rmse(spark, d):
    df = predicted(spark, d)
    weights = blend.inverse_rmse_weights(df.filter("is_train"), "y", ["p1", "p2"])
    out = blend.blend(df.filter("not is_train"), weights)
    return rounded(out.select("row_id", "prediction"), "prediction")


@query("pred_neg_to_positive_mean", f"""
SELECT row_id, {r('CASE WHEN p1 < 0 THEN m ELSE p1 END')} AS p1
FROM predicted, (SELECT avg(p1) AS m FROM predicted WHERE p1 > 0)""", predicted=PREDICTED)
def pred_neg_to_positive_mean(spark, d):
    return rounded(blend.negatives_to_positive_mean(predicted(spark, d).select("row_id", "p1"), "p1"), "p1")


@query("pred_neg_to_target_mean", f"""
SELECT row_id, {r('CASE WHEN p1 < 0 THEN m ELSE p1 END')} AS p1
FROM predicted, (SELECT avg(y) AS m FROM predicted WHERE is_train AND y > 0) WHERE NOT is_train""",
       predicted=PREDICTED)
def pred_neg_to_target_mean(spark, d):
    df = predicted(spark, d)
    score = df.filter("not is_train").select("row_id", "p1")
    return rounded(blend.negatives_to_target_mean(score, "p1", df.filter("is_train"), "y"), "p1")


@query("pred_clip_zero", f"SELECT row_id, {r('CASE WHEN p1 < 0 THEN 0 ELSE p1 END')} AS p1 FROM predicted",
       predicted=PREDICTED)
def pred_clip_zero(spark, d):
    return rounded(blend.negatives_to_zero(predicted(spark, d).select("row_id", "p1"), "p1"), "p1")
