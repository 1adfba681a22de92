"""Every registered query against its SQL twin on the smallest supplied tables."""

import os

import pytest
from oracle import compare, connect

from usage_ts.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    ok, message = compare(spark, con, SF, QUERIES[name], ORACLES[name])
    assert ok, message


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_returns_rows(spark, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows and len(set(df.columns)) == len(df.columns)


def test_every_sql_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
