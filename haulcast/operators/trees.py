"""Tree models on Spark's learners: boosting, forests and single trees."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressionModel, GBTRegressor, RandomForestRegressionModel
from pyspark.ml.wrapper import JavaWrapper
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulcast.operators import growing
from haulcast.operators.encode import label_encode
from haulcast.operators.growing import Feature, Growth, Tree, best_round  # noqa: F401 - best_round is offered here


PART_ROWS = 50_000
# names of former limits of a fit with patience; boosting now ends by itself in the stage that grows the trees
FIRST_PATIENCES, SLAB_ROUNDS = 6, 25


@dataclass(frozen=True)
class TreeConfig:
    trees: int = 200
    depth: int = 3
    rate: float = 0.1
    min_rows: int = 1
    subsample: float = 1.0
    features: str = "all"
    loss: str = "squared"
    bins: int = 64
    seed: int = 42


# The parameter sets of the models this library stands in for.
# Leaf-wise growth becomes a depth limit of ceil(log2(leaves)); penalties on leaf
# values have no counterpart in Spark's learner.
BOOSTED = TreeConfig(trees=200, depth=3, rate=0.1, min_rows=2)
BOOSTED_SUBSAMPLED = TreeConfig(trees=300, depth=3, rate=0.2, subsample=1.0)
LEAFWISE = TreeConfig(trees=5000, depth=6, rate=0.01, subsample=0.8, features="0.8")
LEAFWISE_SHALLOW = TreeConfig(trees=2000, depth=5, rate=0.03, subsample=0.8, features="0.6")
LEAFWISE_ABSOLUTE = replace(LEAFWISE, loss="absolute")
CATEGORICAL = TreeConfig(trees=5000, depth=6, rate=0.01)


def with_rounds(config: TreeConfig, trees: int) -> TreeConfig:
    return replace(config, trees=trees)


def coarser(config: TreeConfig, times: int) -> TreeConfig:
    """Steps ``times`` as large in as many times fewer rounds."""
    return replace(config, trees=config.trees // times, rate=config.rate * times)


def tree_features(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> tuple[PipelineModel, int, int]:
    """Fitted assembler that keeps categories as categories, the bins they need, and the number of rows.

    A null number becomes one below the smallest known one, so a cut can set missing
    rows apart. Labels are indexed in sorted order with one slot for unseen and null
    labels; a tree keeps a bin for each of them. Entity names belong to the count and
    target encodings, by their role and at any number.
    """
    stages, bins = [], 2
    index, filled = [f"{c}_idx" for c in categorical], [f"{c}_filled" for c in numeric]
    low = lambda c: F.min(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")))
    facts = df.agg(F.count("*").alias("_rows"), *[low(c).alias(f"{c}_filled") for c in numeric],
                   *[F.count_distinct(c).alias(f"{c}_idx") for c in categorical]).first()
    if numeric:
        known = lambda c: f"CASE WHEN NOT isnan(CAST(`{c}` AS DOUBLE)) THEN CAST(`{c}` AS DOUBLE) END"
        fills = {c: math.floor(facts[f"{c}_filled"] or 0.0) - 1.0 for c in numeric}
        stages.append(SQLTransformer(statement="SELECT *, " + ", ".join(
            f"coalesce({known(c)}, CAST('{v!r}' AS DOUBLE)) AS `{c}_filled`" for c, v in fills.items()) + " FROM __THIS__"))
    if categorical:
        bins = max(facts[i] for i in index) + 1
        stages.append(StringIndexer(inputCols=list(categorical), outputCols=index, handleInvalid="keep",
                                    stringOrderType="alphabetAsc"))
    stages.append(VectorAssembler(inputCols=[*filled, *index], outputCol="features"))
    return Pipeline(stages=stages).fit(df), bins, facts["_rows"]


def assembled(assembler: PipelineModel, df: DataFrame, rows: int, *columns: str) -> DataFrame:
    """Assembled rows in the cache, as every level of every tree reads them again; in no more parts than they fill."""
    return assembler.transform(df).select("features", *columns).coalesce(max(1, -(-rows // PART_ROWS))).persist()


@dataclass
class TreeModel:
    """A fitted tree learner with the assembler it was trained on."""

    assembler: PipelineModel
    model: object
    rounds: int
    errors: list[float] | None = None

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """Add predictions; helper columns do not stay."""
        scored = self.model.transform(self.assembler.transform(df))
        return scored.select(*df.columns, F.col(self.model.getPredictionCol()).alias(out))


class GrownModel(TreeModel):
    """Trees of ``growing`` with their weights. Spark's model of them, ``model``, is made when it is asked for:
    node by node across to the JVM it takes longer than growing them."""

    def __init__(self, assembler: PipelineModel, columns: PipelineModel, features: Sequence[Feature], trees: Sequence[Tree],
                 weights: Sequence[float], make: Callable[[list], object], errors: list[float] | None = None):
        self.assembler, self.columns, self.features = assembler, columns, list(features)
        self.trees, self.weights, self.rounds, self.errors = list(trees), list(weights), len(trees), errors
        self._make, self._model = make, None

    @property
    def model(self) -> object:
        if self._model is None:
            self._model = self._make([tree_model(t, self.features) for t in self.trees])
        return self._model

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """Add predictions; helper columns do not stay."""
        ready = self.columns.transform(df)
        scored = growing.Scorer(self.trees, self.weights, self.features).column_of(ready)
        return ready.select(*df.columns, scored.alias(out))


def native_categories(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Labels as sorted category indexes ``{c}_idx`` that tree learners take as categories.

    Null gets the slot after the last label.
    """
    sizes = df.agg(*[F.count_distinct(c).alias(c) for c in cols]).first()
    out = label_encode(df, cols, null_label=None, suffix="_idx")
    return out.withColumns({f"{c}_idx": F.coalesce(f"{c}_idx", F.lit(sizes[c])) for c in cols})


def bin_columns(assembler: PipelineModel, df: DataFrame, target: str, rows: int, bins: int, seed: int,
                whole: int | None = None) -> tuple[PipelineModel, list[Feature]]:
    """The stages before the assembled vector, and its features with the cuts that Spark's learner would try.

    ``whole`` is the number of rows ``df`` is a part of: it lays out the rows, of which Spark takes
    some for the cuts if there are many.
    """
    names = assembler.stages[-1].getInputCols()
    # one slot more than labels, for unseen and null ones
    labels = {c: len(known) + 1 for s in assembler.stages[:-1] if isinstance(s, StringIndexerModel)
              for c, known in zip(s.getOutputCols(), s.labelsArray)}
    ready = assembler.transform(df).select("features", F.col(target).cast("double").alias("y"))
    ready = ready.coalesce(max(1, -(-(whole or rows) // PART_ROWS)))
    spark = SparkSession.active()._jvm.org.apache.spark
    learner = GBTRegressor(featuresCol="features", labelCol="y", maxBins=bins)
    learner._transfer_params_to_java()
    arity = getattr(getattr(spark.ml.util, "MetadataUtils$"), "MODULE$").getCategoricalFeatures(
        ready._jdf.schema().apply("features"))
    strategy = learner._java_obj.getOldBoostingStrategy(arity, spark.mllib.tree.configuration.Algo.Regression()).treeStrategy()
    instances = getattr(getattr(spark.ml.util, "DatasetUtils$"), "MODULE$").extractInstances(
        learner._java_obj, ready._jdf, SparkSession.active()._jvm.scala.Option.empty())
    meta = getattr(getattr(spark.ml.tree.impl, "DecisionTreeMetadata$"), "MODULE$").buildMetadata(instances, strategy)
    found = getattr(getattr(spark.ml.tree.impl, "RandomForest$"), "MODULE$").findSplits(instances, meta, seed)
    cuts = {c: np.array([cut.threshold() for cut in found[i]], dtype=float) for i, c in enumerate(names) if c not in labels}
    return PipelineModel(assembler.stages[:-1]), [Feature(c, cuts.get(c), labels.get(c, 0)) for c in names]


def features_per_node(strategy: str, count: int, trees: int = 1) -> int:
    """Number of features a node chooses from, by the strategy names of Spark's learners."""
    if strategy == "auto":
        strategy = "onethird" if trees > 1 else "all"
    shares = {"all": 1.0, "onethird": 1 / 3}
    return math.ceil(count * shares[strategy] if strategy in shares else count * float(strategy))


def growth(config: TreeConfig, features: int, patience: int | None = None) -> Growth:
    # under squared loss the trees are fitted to twice the residual, so the step is halved
    # for ``rate`` to mean the share of the residual that a tree corrects
    step = config.rate / 2 if config.loss == "squared" else config.rate
    return Growth(config.trees, config.depth, step, config.min_rows, config.subsample,
                  features_per_node(config.features, features), config.loss, config.seed, patience)


def fit_gbt(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], target: str, config: TreeConfig,
            valid: DataFrame | None = None, patience: int | None = None) -> TreeModel:
    """Boosted trees; with ``valid``, cut back to the round with the lowest validation error.

    ``patience`` ends boosting after that many rounds without a better one. The rows of
    both sides are binned once, and one stage grows all trees over them.
    """
    known = df.dropna(subset=[target])
    assembler, bins, rows = tree_features(known, numeric, categorical)
    held = None if valid is None else valid.dropna(subset=[target])
    return fit_boosted(assembler, known, target, [config], bins, rows, held, patience)[0]


def fit_boosted(assembler: PipelineModel, df: DataFrame, target: str, configs: Sequence[TreeConfig], bins: int, rows: int,
                held: DataFrame | None = None, patience: int | None = None, whole: int | None = None) -> list[GrownModel]:
    """Boosted models of several configurations over the same rows, with the validation error per round.

    With ``held``, boosting ends once ``patience`` rounds brought nothing better there,
    and the trees up to the best round are kept.
    """
    most = max(bins, *[c.bins for c in configs])
    columns, features = bin_columns(assembler, df, target, rows, most, configs[0].seed, whole)
    side = lambda rows, part: columns.transform(rows).select(*[f.column for f in features], target, F.lit(part).alias("_part"))
    ready = side(df, 0) if held is None else side(df, 0).unionByName(side(held, 1))
    grown = growing.grow(ready, features, target, rows, [growth(c, len(features), patience) for c in configs],
                         None if held is None else F.col("_part"))
    out = []
    for config, (trees, errors) in zip(configs, grown):
        rounds = config.trees if held is None else best_round(errors, patience)
        if held is not None and patience is not None:
            errors = errors[: rounds + patience]
        step = config.rate / 2 if config.loss == "squared" else config.rate
        weights = [1.0, *[step] * (rounds - 1)]
        out.append(GrownModel(assembler, columns, features, trees[:rounds], weights, lambda made, w=weights: boosted_model(made, w),
                              None if held is None else errors))
    return out


def tree_model(tree: Tree, features: Sequence[Feature]) -> object:
    """A grown tree as a model of Spark's, on the JVM's side."""
    jvm = SparkSession.active()._jvm
    ml = jvm.org.apache.spark.ml
    leaf, inner, cut, labels = ml.tree.LeafNode, ml.tree.InternalNode, ml.tree.ContinuousSplit, ml.tree.CategoricalSplit
    # children have higher numbers than their parents
    made: dict[int, object] = {}
    for n in range(len(tree.values) - 1, -1, -1):
        if n not in tree.cuts:
            made[n] = leaf(tree.values[n], 0.0, None)
            continue
        i, lefts, left, right = tree.cuts[n]
        if features[i].cuts is not None:
            split = cut(i, float(features[i].cuts[int(lefts.sum()) - 1]))
        else:
            codes = JavaWrapper._new_java_array([float(c) for c in lefts.nonzero()[0]], jvm.double)
            split = labels(i, codes, features[i].categories)
        made[n] = inner(tree.values[n], 0.0, tree.gains[n], made.pop(left), made.pop(right), split, None)
    return ml.regression.DecisionTreeRegressionModel(made[0], len(features))


def boosted_model(trees: Sequence, weights: Sequence[float]) -> GBTRegressionModel:
    """The boosted model with the given trees and weights, without a fit."""
    jvm = SparkSession.active()._jvm
    array = JavaWrapper._new_java_array(list(trees), jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel)
    doubles = JavaWrapper._new_java_array([float(w) for w in weights], jvm.double)
    return _wrapped(GBTRegressionModel, JavaWrapper._new_java_obj(
        "org.apache.spark.ml.regression.GBTRegressionModel", f"boosted_{len(trees)}", array, doubles))


def forest_model(trees: Sequence, features: int) -> RandomForestRegressionModel:
    """The forest of the given trees."""
    jvm = SparkSession.active()._jvm
    array = JavaWrapper._new_java_array(list(trees), jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel)
    made = JavaWrapper._new_java_obj(
        "org.apache.spark.ml.regression.RandomForestRegressionModel", f"forest_{len(trees)}", array, features)
    # the sum over the trees is divided by this
    made.set(made.numTrees(), len(trees))
    return _wrapped(RandomForestRegressionModel, made)


def _wrapped(kind: type, made):
    made.setFeaturesCol("features")
    made.setPredictionCol("tree_prediction")
    model = kind(made)
    # the Python side takes its column names from the parameters of the model it wraps
    model._resetUid(made.uid())
    model._transfer_params_from_java()
    return model


def _fit_cached(learner, assembler: PipelineModel, df: DataFrame, target: str, rows: int):
    """Fit on assembled rows kept in the cache."""
    ready = assembled(assembler, df, rows, target)
    try:
        return learner.fit(ready)
    finally:
        ready.unpersist()


def fit_tree(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], target: str,
             depth: int = 5, bins: int = 64, min_rows: int = 1) -> TreeModel:
    """A single regression tree."""
    known = df.dropna(subset=[target])
    assembler, needed, rows = tree_features(known, numeric, categorical)
    learner = DecisionTreeRegressor(featuresCol="features", labelCol=target, predictionCol="tree_prediction",
                                    maxDepth=depth, maxBins=max(bins, needed), minInstancesPerNode=min_rows)
    return TreeModel(assembler, _fit_cached(learner, assembler, known, target, rows), 1)


def fit_forest(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], target: str,
               trees: int = 20, depth: int = 5, bins: int = 64, seed: int = 42) -> TreeModel:
    """A random forest."""
    known = df.dropna(subset=[target])
    assembler, needed, rows = tree_features(known, numeric, categorical)
    columns, features = bin_columns(assembler, known, target, rows, max(bins, needed), seed)
    config = Growth(trees, depth, 1.0, 1, 1.0, features_per_node("auto", len(features), trees), "squared", seed, forest=True)
    (grown, _), = growing.grow(columns.transform(known), features, target, rows, [config])
    return GrownModel(assembler, columns, features, grown, [1 / trees] * trees, lambda made: forest_model(made, len(features)))
