"""Every registered query against its SQL twin, at the smallest scale."""

import pytest

import __spark_entry__ as entry
from compare import differences, duck

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF), con, SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["fold", "rows", "mae", "mean_duration_ratio", "mean_duration_gap"]
    assert df.count() == 5


def test_every_twin_has_a_query():
    assert set(SQL) <= set(QUERIES)


LARGE = ["join_entity_features", "map_lookup", "encode_label", "encode_ordinal_unknown", "encode_count", "encode_cross",
         "encode_target_oof", "folds_grouped_balanced", "target_quantile_grid", "duration_fix_median", "impute_median",
         "fold_fit_medians", "scale_robust", "knn_regress", "fit_lasso_path_cv", "grouped_cost_cv"]


@pytest.mark.parametrize("name", LARGE)
def test_paths_for_large_data_equal_sql(spark, con, name, monkeypatch):
    """The ways taken beyond the size limits, with the limits set low."""
    from haulcast.operators import keyed, knn, linear, quantiles

    monkeypatch.setattr(keyed, "BROADCAST_KEYS", 3)
    monkeypatch.setattr(keyed, "HOT_KEYS", 20)
    monkeypatch.setattr(quantiles, "MAX_BUCKET_ROWS", 40)
    monkeypatch.setattr(knn, "BLOCK_ROWS", 30)
    monkeypatch.setattr(knn, "ROWS_PER_CELL", 20)
    monkeypatch.setattr(linear, "IN_ENGINE_FEATURES", 0)
    assert differences(QUERIES[name](spark, SF), con, SQL[name]) == []
