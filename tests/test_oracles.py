"""Every registered query against its SQL, on the smallest given tables."""

import pytest

from checks import ORACLES, QUERIES
from checks.compare import connect, difference

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SF_DIR), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_queries_without_sql_give_rows(spark, name):
    rows = QUERIES[name](spark, SF_DIR)
    assert rows.columns and rows.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__
    assert __spark_entry__.entry(spark).count() > 0


def test_correlations_are_of_every_feature(spark):
    """None is cut off, neither by the query nor by its SQL."""
    from checks.relational import FEATURES
    assert {r["feature"] for r in QUERIES["top_features_corr"](spark, SF_DIR).collect()} == set(FEATURES)
    assert "LIMIT" not in ORACLES["top_features_corr"]
