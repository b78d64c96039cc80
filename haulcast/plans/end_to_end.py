"""Whole flows from raw rows to scores and predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from haulcast.operators import (blend, dates, encode, ensemble, entity, folds, impute, metrics, quality, scale, search,
                                target, trees)
from haulcast.operators import linear as lm
from haulcast.operators.linear import Penalty
from haulcast.operators.quantiles import quantile
from haulcast.plans.registry import SWAPPED, bucket, query, r, rounded, ships
from haulcast.roles import SHIPMENTS
from haulcast.session import materialise

E = "hospital_id"
Y = "transport_cost"
NUMERIC = list(SHIPMENTS.numeric)


def grouped_features(spark, d, *more):
    """Train rows without extreme costs, all score rows, and the features of their hospital."""
    df = ships(spark, d, "row_id", E, "transport_method", "order_placed_date", "delivery_date", Y, "is_train", *more)
    df = target.clip_lower(df, Y)
    limit = quantile(df.filter("is_train"), Y, 0.995)
    df = df.filter(~F.col("is_train") | (F.col(Y) < limit))
    df = dates.swap_inverted(df, "order_placed_date", "delivery_date")
    df = dates.add_duration(df, "order_placed_date", "delivery_date")
    df = dates.fix_duration(df, "duration", "mean", "train")
    stats = entity.fit_entity_stats(df, E, "duration", prefix="hospital_dur", count="hospital_order_count")
    df = entity.ratio(stats.attach(df), "duration", "hospital_dur_mean", "duration_vs_hospital_mean")
    df = entity.difference(df, "duration", "hospital_dur_max", "duration_vs_hospital_max")
    return folds.assign_group_folds(target.log_target(df, Y, "y"), E, 5)


KEPT = f"""
SELECT row_id, hospital_id, transport_method, is_train, {bucket(E, 42, 5)} AS fold, {SWAPPED} AS raw, cost,
       ln(1 + cost) AS y
FROM (SELECT *, CASE WHEN transport_cost < 0 THEN 0 ELSE transport_cost END AS cost FROM shipments)
WHERE NOT is_train OR cost < (SELECT quantile_cont(CASE WHEN transport_cost < 0 THEN 0 ELSE transport_cost END, 0.995)
                              FROM shipments WHERE is_train)"""
FEATURED = """
SELECT *, duration / avg(duration) OVER (PARTITION BY hospital_id) AS ratio,
       duration - max(duration) OVER (PARTITION BY hospital_id) AS diff
FROM (SELECT *, CASE WHEN raw > 0 THEN raw ELSE (SELECT avg(raw) FROM kept WHERE is_train AND raw > 0) END AS duration
      FROM kept)"""
MEANS = " UNION ALL ".join(
    f"SELECT {f} AS held, transport_method AS v, avg(y) AS m FROM kept WHERE is_train AND fold <> {f} "
    "AND transport_method IS NOT NULL GROUP BY transport_method" for f in range(5))
CV_SQL = f"""
SELECT fold, count(*) AS rows, {r('avg(abs(cost - (exp(coalesce(m, fallback)) - 1)))')} AS mae,
       {r('avg(ratio)')} AS mean_duration_ratio, {r('avg(diff)')} AS mean_duration_gap
FROM featured JOIN (SELECT held, avg(m) AS fallback FROM means GROUP BY held) fb ON fb.held = fold
LEFT JOIN means ON means.held = fold AND v = transport_method
WHERE is_train GROUP BY fold"""


@query("grouped_cost_cv", CV_SQL, kept=KEPT, featured=FEATURED, means=MEANS)
def grouped_cost_cv(spark, d):
    """Cross-validated error of the category-mean model on hospital-grouped folds, per fold."""
    df = encode.target_encode_oof(grouped_features(spark, d), ["transport_method"], "y", 5)
    scored = df.filter("is_train").withColumn("p", F.expm1("transport_method_te"))
    out = scored.groupBy("fold").agg(
        F.count("*").alias("rows"), metrics.mae(F.col(Y), F.col("p")).alias("mae"),
        F.avg("duration_vs_hospital_mean").alias("mean_duration_ratio"),
        F.avg("duration_vs_hospital_max").alias("mean_duration_gap"))
    return rounded(out, "mae", "mean_duration_ratio", "mean_duration_gap")


@query("cost_by_tuned_lasso")
def cost_by_tuned_lasso(spark, d):
    """Hold-out linear flow: repair, durations, imputed and scaled design, alpha search, predictions."""
    labels = ["equipment_type", "transport_method"]
    df = ships(spark, d, "row_id", E, "is_train", "order_placed_date", "delivery_date", Y, *NUMERIC, *labels)
    df = target.nonpositive_to_positive_mean(df, Y, F.col("is_train"))
    df = dates.swap_inverted(df, "order_placed_date", "delivery_date")
    df = dates.add_duration(df, "order_placed_date", "delivery_date")
    df = dates.fix_duration(df, "duration", "mean", "frame").drop("order_placed_date", "delivery_date")
    df = folds.assign_folds(folds.assign_holdout(df, "row_id", 20), "row_id", 5)
    fitted = F.col("is_train") & ~F.col("is_holdout")
    numeric = [*NUMERIC, "duration"]
    df = scale.scale_standard(impute.impute_mean(df, numeric, fitted), numeric, fitted)
    df, hot = encode.one_hot(impute.impute_mode(df, labels, fitted), labels, fitted)
    # fixed values: the alphas of the search
    penalties = [Penalty("lasso", a) for a in (0.0001, 0.001, 0.01, 0.1, 1.0, 10.0)]
    _, model = search.search_linear(df.filter(fitted), [*numeric, *hot], Y, penalties)
    out = blend.negatives_to_positive_mean(model.predict(df.filter("not is_train")), "prediction")
    return out.select("row_id", E, F.col("prediction").alias(Y))


@query("cost_by_tree_blend")
def cost_by_tree_blend(spark, d):
    """Grouped-fold blend of two boosted models on log cost, with the contract of its output checked."""
    df = grouped_features(spark, d, *NUMERIC, "equipment_type", "hospital_info")
    labels = ["transport_method", "equipment_type", "hospital_info"]
    numeric = [*NUMERIC, "duration", "hospital_dur_mean", "hospital_dur_std", "hospital_order_count",
               "duration_vs_hospital_mean", "duration_vs_hospital_max"]
    df = impute.impute_constant(impute.impute_median(df, numeric), labels)
    df = materialise(folds.assign_group_folds(df, E, 2, out="half"), "tree-frame")
    train, score = df.filter("is_train"), df.filter("not is_train")
    configs = {"a": trees.with_rounds(trees.LEAFWISE_SHALLOW, 4), "b": trees.with_rounds(trees.CATEGORICAL, 4)}
    for name, config in configs.items():
        models = ensemble.fit_folds(
            train, 2, lambda t, v, c=config: trees.fit_gbt(t, numeric, labels, "y", c, v, 200), "half")
        score = ensemble.score_predictions(score, models, name, F.expm1)
    out = materialise(blend.blend_equal(score.drop(Y), ["a", "b"], Y).select("row_id", E, Y), "blended")
    report = quality.contract_report(out.select(E, Y), df.filter("not is_train"), E, [E, Y]).first()
    if not (report["columns_match"] and report["row_count_match"] and report["id_set_match"]):
        raise ValueError(f"predictions do not fit their input: {report}")
    return out


@query("cost_by_stack")
def cost_by_stack(spark, d):
    """Boosted trees and a lasso, out of fold, blended by error and by a lasso on top."""
    labels = ["equipment_type", "transport_method"]
    df = ships(spark, d, "row_id", E, "is_train", "order_placed_date", "delivery_date", Y, *NUMERIC, *labels)
    df = target.negative_or_null_to_positive_median(df, Y, F.col("is_train"))
    df = target.log_target(df, Y, "y")
    df = dates.swap_inverted(df, "order_placed_date", "delivery_date")
    df = dates.add_duration(df, "order_placed_date", "delivery_date")
    df = dates.fix_duration(df, "duration", "median", "train").drop("order_placed_date", "delivery_date")
    df = encode.count_encode(df, [E, *labels])
    df = entity.pairwise_ratios(df, NUMERIC[:3])
    df = folds.assign_folds(df, "row_id", 2)
    df = encode.target_encode_oof(df, [E, *labels], "y", 2)
    numeric = [*NUMERIC, "duration", *[f"{c}_{s}" for c in (E, *labels) for s in ("count", "te")],
               *[c for c in df.columns if "_div_" in c]]
    df = impute.impute_mode(impute.impute_median(df, numeric, F.col("is_train")), labels, F.col("is_train"))
    df, hot = encode.one_hot(scale.scale_robust(df, numeric, F.col("is_train")), labels, F.col("is_train"))
    df = materialise(df, "stack-frame")
    train, score = df.filter("is_train"), df.filter("not is_train")
    boosted = ensemble.fit_folds(
        train, 2, lambda t, v: trees.fit_gbt(t, numeric, labels, "y", trees.with_rounds(trees.LEAFWISE_SHALLOW, 4)))
    sparse = lm.fit_linear_by_fold(train, [*numeric, *hot], "y", Penalty("lasso", 0.01))
    oof = sparse.predict_oof(ensemble.oof_predictions(train, boosted, out="tree_oof"), out="lasso_oof")
    score = sparse.average().predict(ensemble.score_predictions(score, boosted, "tree_oof"), "lasso_oof")
    out = ensemble.blend_with_meta(oof, score, ["tree_oof", "lasso_oof"], "y", 0.01)
    out = blend.negatives_to_positive_mean(out, "prediction")
    return out.select("row_id", E, F.col("prediction").alias(Y))
