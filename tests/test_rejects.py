"""Values beyond the fixed-point types are counted; deviations of large attributes stay exact."""

import datetime as dt

import numpy as np
import pytest

from usage_ts.operators import intervals

DAY = dt.date(2020, 1, 1)
SCHEMA = "g string, start_d date, end_d date, consumption double, x double"


def records(spark, rows):
    return spark.createDataFrame(
        [("a", DAY + dt.timedelta(a), DAY + dt.timedelta(b) if b is not None else None, q, x) for a, b, q, x in rows], SCHEMA
    )


@pytest.mark.parametrize("strategy", ["delta", "explode"])
def test_days_count_what_they_leave_out(spark, strategy):
    df = records(spark, [(0, 1, 4.0, 1.0), (1, 2, 1e30, 1.0), (1, 1, 1e13, 1.0), (0, 2, None, 1.0)])
    days = intervals.daily_consumption(df, strategy=strategy, rejects=True).orderBy("d").collect()
    assert [(r.n, float(r.consumption), r.n_rejected) for r in days] == [(2, 2.0, 0), (4, 2.0, 2), (2, 0.0, 1)]
    assert "n_rejected" not in intervals.daily_consumption(df, strategy=strategy).columns


def test_rejects_of_a_table(spark):
    df = records(
        spark,
        [(0, 1, 4.0, 1e20), (0, 1, 1e30, None), (5, 1, 1e30, 2.0), (0, None, 1.0, 3.0), (0, 0, None, float("nan"))],
    )
    row = intervals.reject_counts(df, ["x"]).first()
    assert (row.n_rows, row.no_interval, row.consumption_rejected, row.x_rejected) == (5, 2, 1, 2)
    assert tuple(intervals.reject_counts(df.limit(0), ["x"]).first()) == (0, 0, 0, 0)


@pytest.mark.parametrize("centre", [0.0, 0.1, -3.7, 1e6, 123_456_789.0, 9e9])
def test_deviation_without_cancellation(spark, centre):
    rng = np.random.default_rng(1)
    x = np.round(centre + rng.normal(size=60) * 0.01, 4)
    df = records(spark, [(0, 0, 1.0, float(v)) for v in x] + [(1, 1, 1.0, float(x[0])), (2, 2, 1.0, None)])
    days = intervals.numeric_context(df, ["x"]).orderBy("d").collect()
    shifted = np.array([round((v - round(centre)) * 1e4) for v in x]) / 1e4
    assert days[0].x_std == pytest.approx(shifted.std(ddof=1), rel=1e-6)
    assert days[0].x_avg == pytest.approx(x.mean()) and days[1].x_std is None and days[2].x_avg is None


def test_equal_values_have_no_deviation(spark):
    df = records(spark, [(0, 0, 1.0, v) for v in [87_654_321.1234] * 7])
    assert intervals.numeric_context(df, ["x"]).first().x_std < 1e-5
