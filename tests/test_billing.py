"""The last loaded row of each interval, with copies of lines told apart before the shuffle by account."""

import re

import pytest

from usage_ts.operators.dedup import keep_last
from usage_ts.sources import testtables


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("billing"))
    lines = [
        (order, part, 1, line, float(part), price, 0.1, 0.2, "R", "O", day and f"1995-01-{day:02d}")
        for order, line, day in [(1, 1, 1), (1, 1, 2), (1, 2, 1), (2, 1, 1), (3, 1, 1), (4, None, 1), (4, 1, None), (None, 1, 1), (9, 1, 1)]
        for part, price in [(1, 5.0), (2, None), (2, 7.0), (2, 6.0)]
    ]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double"
    kinds = f"{names}, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate string"
    tables = {
        "lineitem": spark.createDataFrame(lines, kinds),
        "orders": spark.createDataFrame(
            [(1, 1, "a"), (2, 1, "a"), (2, 2, "a"), (3, 1, "a"), (4, 2, "a"), (None, 2, "a"), (9, 7, "a")],
            "o_orderkey long, o_custkey long, o_orderpriority string",
        ),
        "customer": spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "c_custkey long, c_mktsegment string"),
    }
    for name, table in tables.items():
        table.write.parquet(f"{path}/{name}.parquet")
    return path


def test_last_rows_are_those_of_the_whole_load_order(spark, folder):
    key = lambda r: tuple(map(str, r))
    plain = keep_last(testtables.billing(spark, folder), testtables.BILLING_KEY, testtables.LOAD_ORDER)
    rows = sorted(testtables.billing_dedup(spark, folder).collect(), key=key)
    assert rows == sorted(plain.collect(), key=key)
    assert len(rows) == len({(r["account"], r["start_d"], r["end_d"]) for r in rows}) and all(r["l_partkey"] == 2 for r in rows)


def test_shuffle_by_account_carries_no_more_of_the_load_order_than_it_needs(spark, folder):
    days = testtables.billing_dedup(spark, folder).select("account", "start_d", "end_d", "consumption")
    plan = days._jdf.queryExecution().executedPlan().toString()
    windows = re.findall(r"row_number\(\) windowspecdefinition\(account.*?specifiedwindowframe", plan)
    assert windows and not any("l_extendedprice" in w or "l_partkey" in w for w in windows)
