"""The wide daily table in one pass, against the parts it is made of, and its dictionary of values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from usage_ts.operators import intervals

D = dt.date
KINDS = "k string, start_d date, end_d date, consumption decimal(18,2), num double, flag double, cat string, `other` string"


@pytest.fixture(scope="module")
def records(spark):
    rows = [
        ("a", D(2020, 1, 1), D(2020, 1, 4), 8, 1.0, 1.0, "x.1", "p"),
        ("a", D(2020, 1, 2), D(2020, 1, 3), 2, 3.0, 0.0, "y_2", None),
        ("a", D(2020, 1, 7), D(2020, 1, 8), 2, None, 0.0, None, None),
        ("b", D(2020, 1, 1), D(2020, 1, 1), 5, 2.0, 1.0, "x.1", "q"),
        ("b", D(2020, 1, 5), D(2020, 1, 4), 5, 2.0, 1.0, "never", "q"),
    ]
    return spark.createDataFrame([(*r[:3], dt_dec(r[3]), *r[4:]) for r in rows], KINDS)


def dt_dec(v):
    from decimal import Decimal

    return Decimal(v)


def test_equals_its_parts(records):
    args = (["num"], ["flag"])
    wide = intervals.daily_wide(records, *args, ["cat", "other"], ["k"])
    plain = intervals.daily_context(records, *args, ["k"])
    assert sorted(map(str, wide.drop("shares").collect())) == sorted(map(str, plain.collect()))
    long = wide.select("k", "d", F.explode("shares").alias("feature", "m")).select("k", "d", "feature", F.explode("m").alias("value", "fraction"))
    parts = intervals.category_fractions(records, ["cat", "other"], ["k"]).drop("n").select(*long.columns)
    assert sorted(long.collect()) == sorted(parts.collect())


def test_one_scan_of_the_records(spark, records, tmp_path):
    records.write.parquet(str(tmp_path / "r"))
    wide = intervals.daily_wide(spark.read.parquet(str(tmp_path / "r")), ["num"], ["flag"], ["cat", "other"], ["k"])
    plan = wide._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") == 1 and "Python" not in plan and "Join" not in plan


def test_columns_of_dotted_values_and_empty_days(records):
    days = intervals.widened(
        intervals.daily_wide(records, ["num"], ["flag"], ["cat", "other"], ["k"]), {"cat": ["x.1", "y_2", "z"], "other": ["p"]}
    )
    got = {(r.k, r.d.day): tuple(r[c] for c in ("n", "cat_x.1", "cat_y_2", "cat_z", "other_p")) for r in days.collect()}
    assert got["a", 2] == (2, 0.5, 0.5, 0.0, 1.0) and got["a", 1] == (1, 1.0, 0.0, 0.0, 1.0)
    # A day without records, and one whose record has no category.
    assert got["a", 5] == (0, 0.0, 0.0, 0.0, 0.0) and got["a", 7] == (1, 0.0, 0.0, 0.0, 0.0)
    assert set(got) == {("a", i) for i in range(1, 9)} | {("b", 1)}


def test_no_categories_and_no_records(records):
    wide = intervals.daily_wide(records, ["num"], ["flag"], [])
    assert wide.count() == 8 and wide.filter(F.size("shares") > 0).count() == 0
    none = intervals.daily_wide(records.limit(0), ["num"], ["flag"], ["cat"], ["k"])
    assert none.count() == 0 and intervals.value_dictionary(none).count() == 0


def test_dictionary_keeps_places(records):
    days = intervals.daily_wide(records, [], [], ["cat", "other"], ["k"])
    first = intervals.value_dictionary(days.filter("k = 'b'"))
    assert sorted(map(tuple, first.collect())) == [("cat", "x.1", 0, 1), ("other", "q", 0, 1)]
    later = intervals.value_dictionary(days, first, 2)
    assert sorted(map(tuple, later.collect())) == [
        ("cat", "x.1", 0, 1), ("cat", "y_2", 1, 2), ("other", "p", 1, 2), ("other", "q", 0, 1),
    ]
    assert sorted(map(tuple, intervals.value_dictionary(days, later, 3).collect())) == sorted(map(tuple, later.collect()))
