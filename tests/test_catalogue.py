import pytest
from compare import SF, assert_same

from quantloom import catalogue

SLOW = {"grid_search", "walk_forward", "kfold_cv", "multi_strategy"}


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    assert_same(catalogue.QUERIES[name](spark, SF), duck, catalogue.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL) - SLOW))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry_has_flagship():
    assert catalogue.FLAGSHIP in catalogue.QUERIES
