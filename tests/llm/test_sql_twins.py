"""Text queries that SQL can express, against their SQL."""

import pytest
from oracle import compare, connect

from usage_ts.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    ok, message = compare(spark, connect(SF), SF, queries.QUERIES[name], queries.ORACLES[name])
    assert ok, message
