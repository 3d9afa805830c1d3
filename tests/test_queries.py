import pytest

from featurelab.plans import registry

from .compare import connection, same

SQL = registry.oracle_sql()
SLOW = {"gbt_cv_scores", "gbt_multiclass", "shap_by_fold", "model_residual_icc", "model_residual_icc_class"}


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf, con, name):
    same(registry.queries()[name](spark, sf), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL) - SLOW))
def test_query_without_sql_has_rows(spark, sf, name):
    assert registry.queries()[name](spark, sf).columns


def test_entry_point(spark, sf):
    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["key", "expr", "median_cv", "n_groups"]
