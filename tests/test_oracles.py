"""Every registered query runs; those with an oracle match DuckDB."""

import pytest

from oracle_check import compare, connect
from tidemark.plans.registry import all_oracles, all_queries

QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_registry():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) >= 119


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_oracle(spark, sf, con, key):
    assert compare(QUERIES[key](spark, sf), ORACLES[key], con) == ""


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, key):
    df = QUERIES[key](spark, sf)
    assert len(set(df.columns)) == len(df.columns)
    assert df.count() >= 0
