import pytest
from compare import assert_same, connect

from tidewick.plans.catalog import QUERIES
from tidewick.plans.oracle import ORACLES


def test_each_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_matches_duckdb(spark, data, name):
    assert_same(QUERIES[name](spark, data), connect(data), ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert entry.queries().keys() >= QUERIES.keys()
