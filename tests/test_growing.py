"""Trees grown in one stage: any number of tasks and jobs, parts of the rows, groups of bins."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from haulcast.operators import growing, search, trees
from haulcast.operators.growing import Feature

CONFIG = trees.TreeConfig(trees=6, depth=4, rate=0.3, min_rows=2)


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(3_000, numPartitions=5).select(
        "id", (F.col("id") * 7919 % 500).cast("double").alias("a"), (F.col("id") * 104_729 % 37).cast("double").alias("b"),
        F.concat(F.lit("k"), (F.col("id") * 31 % 11).cast("string")).alias("c")).withColumn(
        "y", F.sin(F.col("a") / 40) * 5 + F.col("b") % 7 + F.when(F.col("c") == "k3", 4.0).otherwise(0.0)).cache()


def predicted(model, df):
    return {r.id: r.prediction for r in model.predict(df).collect()}


def jobs(spark, name, act):
    spark.sparkContext.setJobGroup(name, name)
    try:
        act()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_more_rounds_take_no_more_jobs(spark, table):
    """F4 to F9: a job for each level of each tree was half a second a round on any table."""
    few, many = (jobs(spark, f"rounds-{n}", lambda: trees.fit_gbt(
        table, ["a", "b"], ["c"], "y", trees.with_rounds(CONFIG, n), table.filter("id % 9 = 0"), 50)) for n in (2, 25))
    assert 0 < many <= few + 2


@pytest.mark.parametrize("loss, bins_together", [("squared", 4_096), ("absolute", 4_096), ("squared", 1)])
def test_tasks_and_groups_change_nothing(table, monkeypatch, loss, bins_together):
    config = trees.TreeConfig(**{**CONFIG.__dict__, "loss": loss})
    train, held = table.filter("id % 5 > 0"), table.filter("id % 5 = 0")
    one = trees.fit_gbt(train, ["a", "b"], ["c"], "y", config, held, 50)
    monkeypatch.setattr(growing, "PART_ROWS", 700)
    monkeypatch.setattr(growing, "GROUP_BINS", bins_together)
    many = trees.fit_gbt(train, ["a", "b"], ["c"], "y", config, held, 50)
    assert many.errors == pytest.approx(one.errors) and predicted(many, table) == pytest.approx(predicted(one, table))


def test_predictions_are_those_the_errors_were_taken_from(table):
    """The model handed to Spark says what the stage has added up."""
    train, held = table.filter("id % 5 > 0"), table.filter("id % 5 = 0")
    model = trees.fit_gbt(train, ["a", "b"], ["c"], "y", CONFIG, held)
    truth = {r.id: r.y for r in held.collect()}
    gaps = [(truth[i] - p) ** 2 for i, p in predicted(model, held).items()]
    assert model.rounds == CONFIG.trees and np.mean(gaps) == pytest.approx(model.errors[-1])


@pytest.mark.parametrize("share", [0.5, 1.0])
def test_drawn_rows_and_forests_over_tasks(table, monkeypatch, share):
    monkeypatch.setattr(growing, "PART_ROWS", 700)
    config = trees.TreeConfig(trees=15, depth=4, rate=0.5, subsample=share, features="0.7")
    spread = table.agg(F.var_pop("y")).first()[0]
    for model in (trees.fit_gbt(table, ["a", "b"], ["c"], "y", config), trees.fit_forest(table, ["a", "b"], ["c"], "y", 15, 6)):
        found, truth = predicted(model, table), {r.id: r.y for r in table.collect()}
        assert np.mean([(truth[i] - p) ** 2 for i, p in found.items()]) < 0.7 * spread


def test_no_rows_are_kept_in_the_cache(spark, table):
    """F11 to F14: assembled vectors and Spark's copies of them went to disk."""
    seen = set()
    keep = lambda: seen.update(x.id() for x in spark.sparkContext._jsc.sc().getRDDStorageInfo())
    table.count()
    keep()
    before = set(seen)
    fold = table.withColumn("fold", (F.col("id") % 2).cast("int"))
    persist = type(fold).persist
    try:
        type(fold).persist = lambda self, *a: (_ for _ in ()).throw(AssertionError("rows were cached"))
        trees.fit_forest(table, ["a"], ["c"], "y", 3, 3)
        found = search.search_trees(fold, ["a", "b"], ["c"], "y", CONFIG, [{"trees": 2}, {"trees": 3, "bins": 40}], 2)
    finally:
        type(fold).persist = persist
    keep()
    assert seen == before and found.filter("score > 0").count() == 2


def test_cuts_are_those_of_sparks_learner(table):
    """With all rows and features, the stage grows the trees that Spark's boosting does, also from cuts of some rows."""
    assert table.count() < 10_000
    wide = table.crossJoin(table.sparkSession.range(5).select(F.col("id").alias("more"))).withColumn(
        "a", F.col("a") + F.col("more") / 8).withColumn("id", F.col("id") * 5 + F.col("more"))
    model = trees.fit_gbt(wide, ["a", "b"], ["c"], "y", CONFIG)
    ready = model.assembler.transform(wide).coalesce(1)
    learner = GBTRegressor(labelCol="y", maxIter=CONFIG.trees, maxDepth=CONFIG.depth, stepSize=CONFIG.rate / 2,
                           minInstancesPerNode=CONFIG.min_rows, maxBins=CONFIG.bins, seed=CONFIG.seed, predictionCol="p")
    want = {r.id: r.p for r in learner.fit(ready).transform(ready).collect()}
    assert predicted(model, wide) == pytest.approx(want)


@pytest.mark.parametrize("mapped", [1, 1 << 30])
def test_rows_of_a_task_by_column(monkeypatch, mapped):
    """What a task holds comes from blocks of any length, in memory or from mapped files."""
    monkeypatch.setattr(growing, "MAPPED_BYTES", mapped)
    features, groups = [Feature("a", None, 9), Feature("b", None, 5)], [[0], [1]]
    rng = np.random.default_rng(4)
    blocks = [(rng.integers(0, 5, (2, n)).astype(np.uint16), rng.normal(size=n), rng.integers(0, 2, n).astype(np.int8))
              for n in (1, 7, 30)]
    batches = [pa.RecordBatch.from_arrays([pa.array([len(y)]), *[pa.array([a.tobytes()], pa.binary()) for a in (c, y, p)]],
                                          ["rows", "codes", "target", "part"]) for c, y, p in blocks]
    rows = growing._Rows(iter(batches), features, groups)
    assert rows.count == 38 and isinstance(rows.target, np.memmap) == (mapped == 1)
    assert all((rows.codes[g] == np.concatenate([b[0][g] for b in blocks])).all() for g in (0, 1))
    assert (rows.target == np.concatenate([b[1] for b in blocks])).all()
    assert (rows.part == np.concatenate([b[2] for b in blocks])).all()


def test_groups_hold_every_feature_once():
    features = [Feature(str(i), None, n) for i, n in enumerate((9_000, 64, 64, 3, 2, 2, 150))]
    groups = growing.grouped(features)
    assert sorted(i for g in groups for i in g) == list(range(7)) and [0] in groups
