"""Registered queries against their SQL, and that SQL-less ones return what their contract says."""

import pytest
from compare import assert_same, connect

from tidewick.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", ORACLES)
def test_matches_duckdb(spark, data, name):
    assert_same(QUERIES[name](spark, data), connect(data), ORACLES[name])


def test_each_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
