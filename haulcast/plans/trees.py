"""Tree models.

Trees with one split, also boosted, can be told in SQL: the best cut maximises
the between-group sum of squares. The models themselves run their configurations
uncut over the whole feature set, for their rows, and are tested on planted signals.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from haulcast.operators import encode, ensemble, folds, impute, scale, search, target, trees
from haulcast.operators import linear as lm
from haulcast.plans.registry import bucket, query, r, rounded, ships
from haulcast.roles import SHIPMENTS
from haulcast.session import materialise

Y = "transport_cost"
NUMERIC = list(SHIPMENTS.numeric)
CATEGORIES = ["equipment_type", "transport_method", "hospital_info", "hospital_location"]

STUMP_ROWS = f"""
SELECT row_id, hospital_location AS loc, coalesce(transport_method, '~') AS method, equipment_width AS q,
       transport_cost AS y, {bucket('hospital_id', 42, 5)} = 0 AS held
FROM shipments WHERE is_train AND transport_cost IS NOT NULL"""


def _stump(source: str, n: int, features: tuple[str, ...] = ("loc", "q"), rows: str = "true") -> dict[str, str]:
    """CTEs that find the best single cut on some rows of ``source`` and predict all its rows as p{n}.

    Labels are ordered by their mean, the number q by itself.
    """
    cells = " UNION ALL ".join(
        f"SELECT '{f}' AS f, {f}::varchar AS v, {'q' if f == 'q' else 'avg(y)'} AS k, count(*) AS n, sum(y) AS s "
        f"FROM {source} WHERE {rows} GROUP BY {f}" for f in features)
    labels = [f for f in features if f != "q"]
    joins = " ".join(f"JOIN cells{n} c_{f} ON c_{f}.f = '{f}' AND c_{f}.v = {f}" for f in labels)
    keys = " ".join(f"WHEN '{f}' THEN c_{f}.k" for f in labels)
    return {
        f"cells{n}": cells,
        f"cuts{n}": f"""
SELECT f, k, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER (PARTITION BY f) AS nt,
       sum(s) OVER (PARTITION BY f) AS st FROM cells{n} WINDOW w AS (PARTITION BY f ORDER BY k, v)""",
        f"best{n}": f"""
SELECT f, k AS cut, sl / nl AS low, (st - sl) / (nt - nl) AS high FROM cuts{n} WHERE nt > nl
ORDER BY sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) DESC LIMIT 1""",
        f"fitted{n}": f"""
SELECT {source}.*, CASE WHEN CASE best{n}.f WHEN 'q' THEN q {keys} END <= cut THEN low ELSE high END AS p{n}
FROM {source} CROSS JOIN best{n} {joins}""",
    }


def _stump_rows(spark, d):
    df = ships(spark, d, "row_id", "hospital_id", "hospital_location", "transport_method", "equipment_width", Y,
               "is_train").filter(f"is_train and {Y} is not null").drop("is_train")
    return folds.assign_group_folds(df, "hospital_id", 5)


def _stumps(spark, d, config, numeric=("equipment_width",), labels=("hospital_location",)):
    df = _stump_rows(spark, d)
    model = trees.fit_gbt(df, list(numeric), list(labels), Y, replace(config, trees=2, depth=1, subsample=1.0,
                                                                      features="all"))
    return rounded(model.predict(df).select("row_id", "prediction"), "prediction")


@query("fit_decision_stump", f"SELECT row_id, {r('p1')} AS prediction FROM fitted1",
       rows0=STUMP_ROWS, **_stump("rows0", 1))
def fit_decision_stump(spark, d):
    df = _stump_rows(spark, d)
    model = trees.fit_tree(df, ["equipment_width"], ["hospital_location"], Y, depth=1)
    return rounded(model.predict(df).select("row_id", "prediction"), "prediction")


@query("fit_gbt_stumps", f"SELECT row_id, {r('p1 + 0.1 * p2')} AS prediction FROM fitted2",
       rows0=STUMP_ROWS, **_stump("rows0", 1), rows1="SELECT * REPLACE (y - p1 AS y) FROM fitted1",
       **_stump("rows1", 2))
def fit_gbt_stumps(spark, d):
    return _stumps(spark, d, trees.BOOSTED)


@query("fit_gbt_abs_stumps", f"SELECT row_id, {r('p1 + 0.01 * p2')} AS prediction FROM fitted2",
       rows0=STUMP_ROWS, **_stump("rows0", 1),
       rows1="SELECT * REPLACE (CASE WHEN y < p1 THEN -1.0::double ELSE 1.0::double END AS y) FROM fitted1",
       **_stump("rows1", 2))
def fit_gbt_abs_stumps(spark, d):
    return _stumps(spark, d, trees.LEAFWISE_ABSOLUTE)


TWO_LABELS = ("loc", "method")


@query("fit_gbt_categorical_stumps", f"SELECT row_id, {r('p1 + 0.01 * p2')} AS prediction FROM fitted2",
       rows0=STUMP_ROWS, **_stump("rows0", 1, TWO_LABELS), rows1="SELECT * REPLACE (y - p1 AS y) FROM fitted1",
       **_stump("rows1", 2, TWO_LABELS))
def fit_gbt_categorical_stumps(spark, d):
    return _stumps(spark, d, trees.CATEGORICAL, [], ["hospital_location", "transport_method"])


ROUNDS = """
SELECT 1::int AS round, avg((y - p1) ** 2) AS e FROM fitted1 WHERE held
UNION ALL SELECT 2::int, avg((y - 0.1 * p2) ** 2) FROM fitted2 WHERE held
UNION ALL SELECT 3::int, avg((y - 0.1 * p3) ** 2) FROM fitted3 WHERE held"""


@query("early_stopping_stumps", f"""
SELECT round, {r('e', 1)} AS validation_error, e = (SELECT min(e) FROM rounds) AS is_best FROM rounds""",
       rows0=STUMP_ROWS, **_stump("rows0", 1, rows="NOT held"),
       rows1="SELECT * REPLACE (y - p1 AS y) FROM fitted1", **_stump("rows1", 2, rows="NOT held"),
       rows2="SELECT * REPLACE (y - 0.1 * p2 AS y) FROM fitted2", **_stump("rows2", 3, rows="NOT held"), rounds=ROUNDS)
def early_stopping_stumps(spark, d):
    df = _stump_rows(spark, d)
    model = trees.fit_gbt(df.filter("fold <> 0"), ["equipment_width"], ["hospital_location"], Y,
                          replace(trees.BOOSTED, trees=3, depth=1), df.filter("fold = 0"), 200)
    rows = [(i + 1, float(e), i + 1 == model.rounds) for i, e in enumerate(model.errors)]
    out = spark.createDataFrame(rows, "round int, validation_error double, is_best boolean")
    return rounded(out, "validation_error", digits=1)


@query("encode_native_category", "SELECT row_id, " + ", ".join(
    f"(CASE WHEN {c} IS NULL THEN (SELECT count(DISTINCT {c}) FROM shipments) "
    f"ELSE dense_rank() OVER (ORDER BY {c} NULLS LAST) - 1 END)::int AS {c}_idx" for c in CATEGORIES)
       + " FROM shipments")
def encode_native_category(spark, d):
    out = trees.native_categories(ships(spark, d, "row_id", *CATEGORIES), CATEGORIES)
    return out.select("row_id", *[F.col(f"{c}_idx").cast("int").alias(f"{c}_idx") for c in CATEGORIES])


# whole feature sets, rows only -----------------------------------------------------------------------

def tree_frame(spark, d):
    """Log target, imputed numbers, flags, small categories, and the entity by count and target."""
    names = [*NUMERIC, *CATEGORIES, *SHIPMENTS.flags]
    df = ships(spark, d, "row_id", "hospital_id", "is_train", Y, *names)
    df = target.log_target(target.clip_lower(df, Y), Y, "y")
    df = impute.impute_median(impute.flags_to_int(df, SHIPMENTS.flags), NUMERIC, F.col("is_train"))
    df = folds.assign_group_folds(df, "hospital_id", 5)
    df = encode.count_encode(impute.impute_constant(df, CATEGORIES), ["hospital_id"])
    df = materialise(encode.target_encode_oof(df, ["hospital_id"], "y", 5), "tree-frame")
    return df, [*NUMERIC, *SHIPMENTS.flags, "hospital_id_count", "hospital_id_te"], CATEGORIES


# fixed values: rounds without a better one that end the configurations of 2000 and of 5000 rounds
PATIENCE, LONG_PATIENCE = 100, 200
# A round costs about half a second on any table, as each level of a tree is a job, and the small steps of these
# configurations need more than a thousand rounds. The queries take larger steps, fewer rounds and less patience.
STEPS, LONG_STEPS = 5, 10
SHALLOW = trees.coarser(trees.LEAFWISE_SHALLOW, STEPS)


def _boosted(spark, d, config, patience=None):
    """Model and score predictions; with ``patience``, the first fold is held out and ends the boosting."""
    df, numeric, labels = tree_frame(spark, d)
    train, score_rows = df.filter("is_train"), df.filter("not is_train")
    held = train.filter("fold = 0") if patience else None
    model = trees.fit_gbt(train.filter("fold <> 0") if patience else train, numeric, labels, "y", config, held, patience)
    return model, model.predict(score_rows).select("row_id", F.expm1("prediction").alias("prediction"))


@query("fit_gbt")
def fit_gbt(spark, d):
    return _boosted(spark, d, trees.BOOSTED)[1]


@query("fit_gbt_subsample")
def fit_gbt_subsample(spark, d):
    return _boosted(spark, d, replace(trees.BOOSTED_SUBSAMPLED, subsample=0.7))[1]


@query("fit_gbt_leafwise")
def fit_gbt_leafwise(spark, d):
    return _boosted(spark, d, SHALLOW, PATIENCE // STEPS)[1]


@query("fit_gbt_abs")
def fit_gbt_abs(spark, d):
    return _boosted(spark, d, trees.coarser(trees.LEAFWISE_ABSOLUTE, LONG_STEPS), LONG_PATIENCE // LONG_STEPS)[1]


@query("fit_gbt_categorical")
def fit_gbt_categorical(spark, d):
    return _boosted(spark, d, trees.coarser(trees.CATEGORICAL, LONG_STEPS), LONG_PATIENCE // LONG_STEPS)[1]


@query("early_stopping")
def early_stopping(spark, d):
    model, _ = _boosted(spark, d, SHALLOW, PATIENCE // STEPS)
    rows = [(i + 1, float(e), i + 1 == model.rounds) for i, e in enumerate(model.errors)]
    return spark.createDataFrame(rows, "round int, validation_error double, is_best boolean")


@query("fit_decision_tree")
def fit_decision_tree(spark, d):
    df, numeric, labels = tree_frame(spark, d)
    model = trees.fit_tree(df.filter("is_train"), numeric, labels, "y", depth=5)
    return model.predict(df.filter("not is_train")).select("row_id", "prediction")


@query("fit_random_forest")
def fit_random_forest(spark, d):
    df, numeric, labels = tree_frame(spark, d)
    model = trees.fit_forest(df.filter("is_train"), numeric, labels, "y", trees=100)
    return model.predict(df.filter("not is_train")).select("row_id", "prediction")


@query("search_grid_trees")
def search_grid_trees(spark, d):
    df, numeric, labels = tree_frame(spark, d)
    train = folds.assign_folds(df.filter("is_train"), "row_id", 2, "inner-42", "inner")
    trials = search.grid(trees=[2, 4], rate=[0.1, 0.2])
    return search.search_trees(train, numeric, labels, "y", trees.BOOSTED, trials, 2, "inner")


@query("search_random")
def search_random(spark, d):
    df, numeric, labels = tree_frame(spark, d)
    train = folds.assign_folds(df.filter("is_train"), "row_id", 2, "inner-42", "inner")
    base = trees.with_rounds(trees.LEAFWISE_ABSOLUTE, 3)
    # fixed values: learning rate and row sampling ranges of the study
    ranges = {"rate": (0.01, 0.1, "log"), "depth": (2, 5, "int"), "subsample": (0.6, 1.0)}
    return search.search_trees(train, numeric, labels, "y", base, search.draws(ranges, 3), 2, "inner",
                               "mae_original_scale", original=Y)


def nested_bases(spark, d):
    """Boosted trees and a wide lasso on five grouped folds: the nested table of their predictions of log cost."""
    df, numeric, labels = tree_frame(spark, d)
    df = scale.scale_standard(df, numeric, F.col("is_train"))
    train, score_rows = df.filter("is_train AND y IS NOT NULL"), df.filter("not is_train")
    # few rounds of a large step: five folds are fitted one after another
    config = replace(trees.LEAFWISE_SHALLOW, trees=20, rate=0.2)
    bases = {"trees": lambda t, v: trees.fit_gbt(t, numeric, labels, "y", config, v),
             "lasso": lambda t, v: ensemble.Pipelined(lm.fit_wide(t, numeric, labels, "y", lm.Penalty("lasso", 0.01)))}
    return ensemble.oof_table(train, score_rows, 5, bases, "row_id", "y")


@query("cost_by_nested_stack")
def cost_by_nested_stack(spark, d):
    """Costs of the score rows: half blend by error, half lasso over out-of-fold trees and wide lasso."""
    oof, scored = ensemble.base_columns(nested_bases(spark, d), "row_id", ["trees", "lasso"])
    oof = materialise(oof, "bases")
    out = ensemble.blend_with_meta(oof, scored, ["trees", "lasso"], "target", 0.01)
    return out.select("row_id", "prediction")
