"""Linear models, their searches, and what is built from their predictions.

The SQL twins solve the same problems with two features from moments computed
by the SQL engine: closed forms where they exist, a recursive coordinate descent
where they do not.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from haulcast.operators import blend, encode, ensemble, folds, foldwise, impute, metrics, scale, search, target
from haulcast.operators import linear as lm
from haulcast.operators.linear import Penalty
from haulcast.plans.registry import bucket, query, r, rounded, ships
from haulcast.roles import SHIPMENTS
from haulcast.session import materialise

Y = "transport_cost"
TWO = ["x1", "x2"]
K = 5

BASE = f"""
SELECT row_id, is_train, {bucket('row_id', 42, K)} AS fold, {bucket('row_id', 42, 100)} < 20 AS is_holdout,
       CASE WHEN transport_cost >= 0 THEN transport_cost ELSE m END AS y,
       (equipment_width - a1) / b1 AS x1, (base_transport_fee - a2) / b2 AS x2
FROM shipments, (SELECT avg(transport_cost) AS m FROM shipments WHERE is_train AND transport_cost > 0),
     (SELECT avg(equipment_width) AS a1, stddev_pop(equipment_width) AS b1, avg(base_transport_fee) AS a2,
             stddev_pop(base_transport_fee) AS b2 FROM shipments WHERE is_train)"""


def base(spark, d):
    """Repaired target and two scaled features, with folds and a hold-out tag."""
    df = ships(spark, d, "row_id", "is_train", Y, "equipment_width", "base_transport_fee")
    df = target.negative_or_null_to_positive_mean(df, Y, F.col("is_train"))
    df = scale.scale_standard(df, ["equipment_width", "base_transport_fee"], F.col("is_train"))
    df = folds.assign_holdout(folds.assign_folds(df, "row_id", K), "row_id", 20)
    return df.select("row_id", "is_train", "fold", "is_holdout", F.col(Y).alias("y"),
                     F.col("equipment_width").alias("x1"), F.col("base_transport_fee").alias("x2"))


def _moments(rows: str, keys: str = "") -> str:
    """Centred sums of products of x1, x2, y per key."""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""
SELECT {keys + ',' if keys else ''} count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my,
       var_pop(x1) * count(*) AS s11, var_pop(x2) * count(*) AS s22, covar_pop(x1, x2) * count(*) AS s12,
       covar_pop(x1, y) * count(*) AS s1y, covar_pop(x2, y) * count(*) AS s2y FROM ({rows}) {group}"""


OUTSIDE_ROWS = "SELECT held, x1, x2, y FROM base JOIN (SELECT unnest(range(5)) AS held) ON fold <> held WHERE is_train"


def _closed(l2: str) -> str:
    det = f"((s11 + {l2}) * (s22 + {l2}) - s12 * s12)"
    return (f"SELECT *, (s1y * (s22 + {l2}) - s12 * s2y) / {det} AS w1, "
            f"(s2y * (s11 + {l2}) - s12 * s1y) / {det} AS w2 FROM moments")


def _soft(x: str, cut: str) -> str:
    return f"(sign({x}) * greatest(abs({x}) - {cut}, 0))"


def _descent(source: str, carry: str) -> str:
    """Coordinate descent on every row of ``source``, which has moments, l1 and l2."""
    return f"""
SELECT {carry}, s11, s22, s12, s1y, s2y, m1, m2, my, l1, l2, 0 AS step, 0.0::double AS w1, 0.0::double AS w2
FROM ({source})
UNION ALL
SELECT {carry}, s11, s22, s12, s1y, s2y, m1, m2, my, l1, l2, step + 1, v1,
       {_soft('s2y - s12 * v1', 'l1')} / (s22 + l2)
FROM (SELECT *, {_soft('s1y - s12 * w2', 'l1')} / (s11 + l2) AS v1 FROM descent WHERE step < 40)"""


TERMS = f"""
SELECT 'intercept' AS term, {r('my - w1 * m1 - w2 * m2')} AS coefficient FROM solved
UNION ALL SELECT 'x1', {r('w1')} FROM solved UNION ALL SELECT 'x2', {r('w2')} FROM solved"""
TRAIN = "SELECT * FROM base WHERE is_train"
LAST = "SELECT * FROM descent WHERE step = 40"


def _coefficients(spark, d, penalty: Penalty):
    model = lm.fit_linear(base(spark, d).filter("is_train"), TWO, "y", penalty)
    return rounded(model.table(spark), "coefficient")


@query("fit_ols", TERMS, base=BASE, moments=_moments(TRAIN), solved=_closed("0"))
def fit_ols(spark, d):
    return _coefficients(spark, d, Penalty())


@query("fit_ridge", TERMS, base=BASE, moments=_moments(TRAIN), solved=_closed("1.0"))
def fit_ridge(spark, d):
    return _coefficients(spark, d, Penalty("ridge", 1.0))


@query("fit_lasso", TERMS, base=BASE, moments=_moments(TRAIN),
       descent=_descent("SELECT *, 1 AS trial, n * 0.1 AS l1, 0 AS l2 FROM moments", "trial"), solved=LAST)
def fit_lasso(spark, d):
    return _coefficients(spark, d, Penalty("lasso", 0.1))


@query("fit_elastic_net", TERMS, base=BASE, moments=_moments(TRAIN),
       descent=_descent("SELECT *, 1 AS trial, n * 0.5 * 0.3 AS l1, n * 0.5 * 0.7 AS l2 FROM moments", "trial"),
       solved=LAST)
def fit_elastic_net(spark, d):
    return _coefficients(spark, d, Penalty("elastic_net", 0.5, 0.3))


@query("fit_ols_one_feature", f"""
SELECT 'intercept' AS term, {r('regr_intercept(y, x1)')} AS coefficient FROM base WHERE is_train
UNION ALL SELECT 'x1', {r('regr_slope(y, x1)')} FROM base WHERE is_train""", base=BASE)
def fit_ols_one_feature(spark, d):
    model = lm.fit_linear(base(spark, d).filter("is_train"), ["x1"], "y")
    return rounded(model.table(spark), "coefficient")


POLY = "SELECT x1 AS x1, x1 * x1 AS x2, y FROM base WHERE is_train"


@query("fit_poly_ols", TERMS.replace("'x2'", "'x1_x_x1'"), base=BASE, moments=_moments(POLY), solved=_closed("0"))
def fit_poly_ols(spark, d):
    df, names = scale.interactions(base(spark, d).filter("is_train").select("y", "x1"), ["x1"], squares=True)
    return rounded(lm.fit_linear(df, names, "y").table(spark), "coefficient")


@query("predict", f"""
SELECT row_id, {r('my + w1 * (x1 - m1) + w2 * (x2 - m2)')} AS prediction FROM base, solved WHERE NOT is_train""",
       base=BASE, moments=_moments(TRAIN), solved=_closed("0"))
def predict(spark, d):
    df = base(spark, d)
    model = lm.fit_linear(df.filter("is_train"), TWO, "y")
    return rounded(model.predict(df.filter("not is_train")).select("row_id", "prediction"), "prediction")


@query("holdout_linear_scores", f"""
SELECT {r('avg((y - p) * (y - p))', 0)} AS mse, {r('sqrt(avg((y - p) * (y - p)))')} AS rmse,
       {r('avg(abs(y - p))')} AS mae, {r('1 - avg((y - p) * (y - p)) / var_pop(y)')} AS r2
FROM (SELECT y, my + w1 * (x1 - m1) + w2 * (x2 - m2) AS p FROM base, solved WHERE is_train AND is_holdout)""",
       base=BASE, moments=_moments(TRAIN + " AND NOT is_holdout"), solved=_closed("0"))
def holdout_linear_scores(spark, d):
    df = base(spark, d).filter("is_train")
    model = lm.fit_linear(df.filter("not is_holdout"), TWO, "y")
    out = metrics.score(model.predict(df.filter("is_holdout")), "y", "prediction")
    return rounded(rounded(out, "rmse", "mae", "r2"), "mse", digits=0)


ALPHAS = search.log_spaced(1e-2, 1e3, 11)
HELD_MSE = f"""
SELECT alpha, {r('avg(m)', 0)} AS mse FROM (
  SELECT alpha, fold, avg((y - (my + w1 * (x1 - m1) + w2 * (x2 - m2))) ** 2) AS m
  FROM base JOIN solved ON held = fold WHERE is_train GROUP BY alpha, fold) GROUP BY alpha"""
ALPHA_ROWS = f"SELECT unnest([{', '.join(repr(a) for a in ALPHAS)}]::double[]) AS alpha"


@query("fit_lasso_path_cv", HELD_MSE.replace("SELECT alpha,", f"SELECT {r('alpha')} AS alpha,", 1),
       base=BASE, moments=_moments(OUTSIDE_ROWS, "held"), alphas=ALPHA_ROWS,
       descent=_descent("SELECT *, n * alpha AS l1, 0 AS l2 FROM moments, alphas", "held, alpha"), solved=LAST)
def fit_lasso_path_cv(spark, d):
    _, path = lm.fit_path_cv(base(spark, d).filter("is_train"), TWO, "y", ALPHAS)
    return rounded(rounded(path, "alpha"), "mse", digits=0)


@query("fit_lasso_path_cv_best", f"""
SELECT {r('alpha')} AS alpha FROM ({HELD_MSE.replace("round(avg(m), 0)", "avg(m)")}) ORDER BY mse, alpha DESC LIMIT 1""",
       base=BASE, moments=_moments(OUTSIDE_ROWS, "held"), alphas=ALPHA_ROWS,
       descent=_descent("SELECT *, n * alpha AS l1, 0 AS l2 FROM moments, alphas", "held, alpha"), solved=LAST)
def fit_lasso_path_cv_best(spark, d):
    model, _ = lm.fit_path_cv(base(spark, d).filter("is_train"), TWO, "y", ALPHAS)
    return rounded(spark.createDataFrame([(float(model.penalty.alpha),)], "alpha double"), "alpha")


def _trial_rows(penalties: list[Penalty]) -> str:
    return " UNION ALL ".join(
        f"SELECT {i} AS trial, {p.alpha!r}::double AS alpha, {p.l1_ratio!r}::double AS ratio, "
        f"{str(p.kind == 'ridge').lower()} AS ridge" for i, p in enumerate(penalties))


TRIAL_SOURCE = """SELECT *, CASE WHEN ridge THEN 0 ELSE n * alpha * ratio END AS l1,
       CASE WHEN ridge THEN alpha ELSE n * alpha * (1 - ratio) END AS l2 FROM moments, trials"""
TRIAL_SCORES = """
SELECT trial::int AS trial, {score} AS score FROM (
  SELECT trial, fold, {metric} AS m
  FROM (SELECT trial, fold, y, my + w1 * (x1 - m1) + w2 * (x2 - m2) AS p
        FROM base JOIN solved ON held = fold WHERE is_train) GROUP BY trial, fold) GROUP BY trial"""

GRID = [Penalty("elastic_net", a, l1) for a in search.log_spaced(1e-3, 10, 5)
        for l1 in search.evenly_spaced(0.1, 0.9, 3)]
# fixed values: the penalty grids of the three-family search
FAMILIES = ([Penalty("lasso", float(a)) for a in (0.1, 1, 10, 50, 100)]
            + [Penalty("ridge", float(a)) for a in (1, 10, 50, 100, 200)]
            + [Penalty("elastic_net", float(a), l1) for a in (0.1, 1, 10) for l1 in (0.1, 0.5, 0.9)])


@query("search_grid", TRIAL_SCORES.format(score=r("avg(m)"), metric="sqrt(avg((y - p) ** 2))"),
       base=BASE, moments=_moments(OUTSIDE_ROWS, "held"), trials=_trial_rows(GRID),
       descent=_descent(TRIAL_SOURCE, "held, trial"), solved=LAST)
def search_grid(spark, d):
    trials, _ = search.search_linear(base(spark, d).filter("is_train"), TWO, "y", GRID, metric="rmse")
    return rounded(trials.select("trial", "score"), "score")


@query("search_families", TRIAL_SCORES.format(score=r("avg(m)"), metric="avg(abs(y - p))"),
       base=BASE, moments=_moments(OUTSIDE_ROWS, "held"), trials=_trial_rows(FAMILIES),
       descent=_descent(TRIAL_SOURCE, "held, trial"), solved=LAST)
def search_families(spark, d):
    trials, _ = search.search_linear(base(spark, d).filter("is_train"), TWO, "y", FAMILIES, metric="mae")
    return rounded(trials.select("trial", "score"), "score")


# out-of-fold predictions and stacking ---------------------------------------------------------------

@query("oof_predictions", f"""
SELECT row_id, fold, {r('my + w1 * (x1 - m1) + w2 * (x2 - m2)')} AS prediction
FROM base JOIN solved ON held = fold WHERE is_train""",
       base=BASE, moments=_moments(OUTSIDE_ROWS, "held"), solved=_closed("0"))
def oof_predictions(spark, d):
    df = base(spark, d).filter("is_train")
    out = lm.fit_linear_by_fold(df, TWO, "y").predict_oof(df)
    return rounded(out.select("row_id", "fold", "prediction"), "prediction")


@query("score_fold_average", f"""
SELECT row_id, {r('avg(my + w1 * (x1 - m1) + w2 * (x2 - m2))')} AS prediction
FROM base, solved WHERE NOT is_train GROUP BY row_id""",
       base=BASE, moments=_moments(OUTSIDE_ROWS, "held"), solved=_closed("0"))
def score_fold_average(spark, d):
    df = base(spark, d)
    models = lm.fit_linear_by_fold(df.filter("is_train"), TWO, "y")
    out = models.average().predict(df.filter("not is_train"))
    return rounded(out.select("row_id", "prediction"), "prediction")


# two one-feature models per fold, their out-of-fold columns a and b, and a lasso on those columns
SINGLE = """
SELECT held, regr_slope(ly, x1) AS u1, regr_intercept(ly, x1) AS c1, regr_slope(ly, x2) AS u2,
       regr_intercept(ly, x2) AS c2
FROM (SELECT held, x1, x2, ln(1 + y) AS ly FROM base JOIN (SELECT unnest(range(5)) AS held) ON fold <> held
      WHERE is_train) GROUP BY held"""
COLUMNS = """
SELECT row_id, ln(1 + y) AS y, c1 + u1 * x1 AS x1, c2 + u2 * x2 AS x2 FROM base JOIN single ON held = fold
WHERE is_train"""
SCORED = """
SELECT row_id, avg(c1 + u1 * x1) AS x1, avg(c2 + u2 * x2) AS x2 FROM base, single WHERE NOT is_train GROUP BY row_id"""
META_ALPHA = 1e-5


def _stacked(spark, d):
    """Out-of-fold columns for train rows and fold-averaged ones for score rows."""
    df = base(spark, d).withColumn("ly", F.log1p("y"))
    train, score = df.filter("is_train"), df.filter("not is_train")
    first = lm.fit_linear_by_fold(train, ["x1"], "ly")
    second = lm.fit_linear_by_fold(train, ["x2"], "ly")
    oof = second.predict_oof(first.predict_oof(train, out="a"), out="b").select("row_id", "ly", "a", "b")
    scored = second.average().predict(first.average().predict(score, "a"), "b").select("row_id", "a", "b")
    return oof, scored


@query("fit_stack", f"""
SELECT row_id, {r('my + w1 * (x1 - m1) + w2 * (x2 - m2)')} AS prediction FROM scored, solved""",
       base=BASE, single=SINGLE, columns=COLUMNS, scored=SCORED, moments=_moments("SELECT * FROM columns"),
       descent=_descent(f"SELECT *, 1 AS trial, n * {META_ALPHA} AS l1, 0 AS l2 FROM moments", "trial"), solved=LAST)
def fit_stack(spark, d):
    oof, scored = _stacked(spark, d)
    model = ensemble.fit_meta(oof, ["a", "b"], "ly", META_ALPHA)
    return rounded(model.predict(scored).select("row_id", "prediction"), "prediction")


@query("blend_meta", f"""
SELECT row_id, {r('exp(0.5 * (x1 / e1 + x2 / e2) / (1 / e1 + 1 / e2) '
                  '+ 0.5 * (my + w1 * (x1 - m1) + w2 * (x2 - m2))) - 1', 2)} AS prediction
FROM scored, solved, (SELECT sqrt(avg((y - x1) ** 2)) AS e1, sqrt(avg((y - x2) ** 2)) AS e2 FROM columns)""",
       base=BASE, single=SINGLE, columns=COLUMNS, scored=SCORED, moments=_moments("SELECT * FROM columns"),
       descent=_descent(f"SELECT *, 1 AS trial, n * {META_ALPHA} AS l1, 0 AS l2 FROM moments", "trial"), solved=LAST)
def blend_meta(spark, d):
    oof, scored = _stacked(spark, d)
    out = ensemble.blend_with_meta(oof, scored, ["a", "b"], "ly", META_ALPHA)
    return rounded(out.select("row_id", "prediction"), "prediction", digits=2)


def _one_feature_bases(target_column):
    return {n: lambda t, v, x=x: lm.fit_linear(t, [x], target_column) for n, x in (("a", "x1"), ("b", "x2"))}


def _nested(spark, d):
    df = base(spark, d).withColumn("ly", F.log1p("y"))
    return ensemble.oof_table(df.filter("is_train"), df.filter("not is_train"), K, _one_feature_bases("ly"), "row_id", "ly")


@query("oof_fold_scores", f"""
SELECT model, fold, count(*) AS rows, {r('avg(abs(y - p))')} AS mae, {r('sqrt(avg((y - p) ** 2))')} AS rmse
FROM (SELECT 'a' AS model, fold, ln(1 + y) AS y, c1 + u1 * x1 AS p FROM base JOIN single ON held = fold WHERE is_train
      UNION ALL SELECT 'b', fold, ln(1 + y), c2 + u2 * x2 FROM base JOIN single ON held = fold WHERE is_train)
GROUP BY model, fold""", base=BASE, single=SINGLE)
def oof_fold_scores(spark, d):
    """Held-out errors of two bases by fold, from the nested table of their predictions."""
    return rounded(ensemble.fold_scores(_nested(spark, d)), "mae", "rmse")


@query("stack_nested", f"""
SELECT row_id, {r('my + w1 * (x1 - m1) + w2 * (x2 - m2)')} AS prediction FROM scored, solved""",
       base=BASE, single=SINGLE, columns=COLUMNS, scored=SCORED, moments=_moments("SELECT * FROM columns"),
       descent=_descent(f"SELECT *, 1 AS trial, n * {META_ALPHA} AS l1, 0 AS l2 FROM moments", "trial"), solved=LAST)
def stack_nested(spark, d):
    """A lasso over the columns of the nested table."""
    oof, scored = ensemble.base_columns(_nested(spark, d), "row_id", ["a", "b"])
    model = ensemble.fit_meta(oof, ["a", "b"], "target", META_ALPHA)
    return rounded(model.predict(scored).select("row_id", "prediction"), "prediction")


# the full design: every numeric column imputed and scaled, every small category one-hot -------------

def full_design(spark, d):
    numeric, labels = list(SHIPMENTS.numeric), ["equipment_type", "transport_method", "hospital_info"]
    df = ships(spark, d, "row_id", "is_train", Y, *numeric, *labels, *SHIPMENTS.flags)
    train = F.col("is_train")
    df = target.negative_or_null_to_positive_mean(df, Y, train)
    df = impute.flags_to_int(df, SHIPMENTS.flags)
    df = scale.scale_standard(impute.impute_mean(df, numeric, train), numeric, train)
    df, hot = encode.one_hot(impute.impute_mode(df, labels, train), labels, train)
    return folds.assign_folds(df, "row_id", K), [*numeric, *SHIPMENTS.flags, *hot], labels


@query("fit_lasso_full_design")
def fit_lasso_full_design(spark, d):
    df, names, _ = full_design(spark, d)
    model, _ = lm.fit_path_cv(df.filter("is_train"), names, Y)
    out = blend.negatives_to_positive_mean(model.predict(df.filter("not is_train")), "prediction")
    return out.select("row_id", "prediction")


@query("fit_wide_lasso")
def fit_wide_lasso(spark, d):
    df, _, labels = full_design(spark, d)
    model = lm.fit_wide(df.filter("is_train"), list(SHIPMENTS.numeric), labels, Y, Penalty("lasso", 0.1))
    return model.transform(df.filter("not is_train")).select("row_id", "prediction")


@query("fit_poly_ols_full")
def fit_poly_ols_full(spark, d):
    """Least squares on all degree-2 terms of the scaled numbers, the flags and the one-hot labels."""
    labels = ["equipment_type", "transport_method", "hospital_info", "hospital_location"]
    df = ships(spark, d, "row_id", "is_train", Y, *SHIPMENTS.numeric, *labels, *SHIPMENTS.flags)
    train = F.col("is_train")
    df = target.negative_or_null_to_positive_mean(df, Y, train)
    df = impute.flags_to_int(impute.impute_mode(df, [*labels, *SHIPMENTS.flags], train), SHIPMENTS.flags)
    df = scale.scale_standard(impute.impute_mean(df, SHIPMENTS.numeric, train), SHIPMENTS.numeric, train)
    df = encode.one_hot_vector(df, labels, "hot", train)
    design = VectorAssembler(inputCols=[*SHIPMENTS.numeric, *SHIPMENTS.flags, "hot"], outputCol="design").transform(df)
    design = scale.poly_vector(materialise(design.select("row_id", "is_train", Y, "design"), "design"), "design")
    model = lm.fit_vector_ols(design.filter("is_train"), "poly", Y)
    out = blend.negatives_to_positive_mean(model.transform(design.filter("not is_train")), "prediction")
    return out.select("row_id", "prediction")


# preprocessing fitted outside each fold -------------------------------------------------------------

GAPS = ["equipment_height", "supplier_reliability"]
GAP_ROWS = f"""
SELECT held, fold, y, coalesce((h - mh) / sh, 0) AS x1, coalesce((s - ms) / ss, 0) AS x2
FROM (SELECT {bucket('row_id', 42, K)} AS fold, ln(1 + greatest(transport_cost, 0)) AS y, equipment_height AS h,
             supplier_reliability AS s FROM shipments WHERE is_train AND transport_cost IS NOT NULL)
CROSS JOIN (
  SELECT held, avg(h) AS mh, sqrt(sum((h - a) ** 2) / count(*)) AS sh, avg(s) AS ms, sqrt(sum((s - b) ** 2) / count(*)) AS ss
  FROM (SELECT *, avg(h) OVER (PARTITION BY held) AS a, avg(s) OVER (PARTITION BY held) AS b
        FROM (SELECT {bucket('row_id', 42, K)} AS fold, equipment_height AS h, supplier_reliability AS s
              FROM shipments WHERE is_train AND transport_cost IS NOT NULL)
        JOIN (SELECT unnest(range({K})) AS held) ON fold <> held) GROUP BY held)"""


def logged(spark, d, *names):
    """Train and score rows with the logarithm of the cost and folds; nothing else is fitted."""
    df = target.log_target(target.clip_lower(ships(spark, d, "row_id", "is_train", Y, *names), Y), Y, "y")
    return folds.assign_folds(df, "row_id", K)


@query("fold_fit_preprocessing", f"""
SELECT fold::int AS fold, {r('avg((y - (my + w1 * (x1 - m1) + w2 * (x2 - m2))) ** 2)')} AS mse
FROM gaps JOIN solved USING (held) WHERE fold = held GROUP BY fold""",
       gaps=GAP_ROWS, moments=_moments("SELECT * FROM gaps WHERE fold <> held", "held"), solved=_closed("50.0"))
def fold_fit_preprocessing(spark, d):
    """Held-out error per fold of a ridge model whose imputing and scaling are fitted outside the fold."""
    df = logged(spark, d, *GAPS).filter("is_train")
    out = foldwise.fold_errors(df, foldwise.raw_sums(df, GAPS, [], "y"), [Penalty("ridge", 50.0)])
    return rounded(out.select("fold", "mse"), "mse")


WIDE_LABELS = ["equipment_type", "transport_method", "hospital_info", "hospital_location", *SHIPMENTS.flags]
# fixed values: the 30 alphas and 9 ratios of the elastic-net study
FULL_GRID = [Penalty("elastic_net", a, l1) for l1 in search.evenly_spaced(0.1, 0.9, 9) for a in search.log_spaced(1e-3, 10, 30)]


@query("search_grid_full")
def search_grid_full(spark, d):
    """270 elastic nets over 5 folds on all numbers and labels, preprocessing fitted per fold."""
    df = logged(spark, d, *SHIPMENTS.numeric, *WIDE_LABELS).filter("is_train")
    return foldwise.search_foldwise(df, SHIPMENTS.numeric, WIDE_LABELS, "y", FULL_GRID)[0]


@query("cost_by_foldwise_grid")
def cost_by_foldwise_grid(spark, d):
    """Predicted costs of the score rows by the best of the 270 elastic nets."""
    df = logged(spark, d, *SHIPMENTS.numeric, *WIDE_LABELS)
    _, model = foldwise.search_foldwise(df.filter("is_train"), SHIPMENTS.numeric, WIDE_LABELS, "y", FULL_GRID)
    out = model.predict(df.filter("not is_train"), "y")
    return out.select("row_id", F.expm1("prediction").alias("prediction"))


@query("fit_lasso_path_cv_full")
def fit_lasso_path_cv_full(spark, d):
    """A path of 100 lasso penalties over 5 folds on all numbers and labels, preprocessing fitted per fold."""
    df = logged(spark, d, *SHIPMENTS.numeric, *WIDE_LABELS).filter("is_train")
    raw = foldwise.raw_sums(df, SHIPMENTS.numeric, WIDE_LABELS, "y")
    everything = raw.outside(None)
    alphas = lm.default_path(foldwise.Preprocessing.fit(raw, everything).sums(everything), 100)
    errors = foldwise.fold_errors(df, raw, [Penalty("lasso", a) for a in alphas])
    table = spark.createDataFrame(list(enumerate(alphas)), "trial int, alpha double")
    return errors.groupBy("trial").agg(F.avg("mse").alias("mse")).join(F.broadcast(table), "trial").select("alpha", "mse")
