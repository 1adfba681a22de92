"""Interval operators: hand-made rows, equal strategies, conservation."""

import datetime as dt
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from usage_ts.operators import clients, dedup, intervals, series
from usage_ts.sources import testtables

D = dt.date
SCHEMA = "account string, g string, start_d date, end_d date, consumption decimal(18,2), x double, f double, c string"
SMALL = "/root/testdata/sf0.001"


def make(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def collect(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def few(spark):
    return make(
        spark,
        [
            ("1", "a", D(2020, 1, 1), D(2020, 1, 4), Decimal(8), 1.0, 1.0, "u"),
            ("2", "a", D(2020, 1, 3), D(2020, 1, 3), Decimal(5), 3.0, 0.0, "v"),
            ("3", "b", D(2020, 1, 7), D(2020, 1, 8), Decimal(1), None, 1.0, None),
            ("4", "b", D(2020, 1, 9), D(2020, 1, 7), Decimal(99), 1.0, 1.0, "u"),
            ("5", "b", None, D(2020, 1, 7), Decimal(99), 1.0, 1.0, "u"),
        ],
    )


@pytest.mark.parametrize("strategy", ["delta", "explode"])
def test_daily_consumption_and_spine(few, strategy):
    days = intervals.daily_consumption(few, strategy=strategy, spine=True)
    got = [(d, n, float(c)) for d, n, c in collect(days, "d", "n", "consumption")]
    assert got == [
        (D(2020, 1, 1), 1, 2.0), (D(2020, 1, 2), 1, 2.0), (D(2020, 1, 3), 2, 7.0), (D(2020, 1, 4), 1, 2.0),
        (D(2020, 1, 5), 0, 0.0), (D(2020, 1, 6), 0, 0.0), (D(2020, 1, 7), 1, 0.5), (D(2020, 1, 8), 1, 0.5),
    ]
    assert max(r.d for r in intervals.closed_horizon(days).collect()) == D(2020, 1, 7)


@pytest.mark.parametrize("spine", [True, False])
@pytest.mark.parametrize("strategy", ["delta", "explode"])
def test_runs_stand_for_their_days(few, strategy, spine):
    days = intervals.daily_consumption(few, ["g"], strategy=strategy, spine=spine)
    runs = intervals.daily_consumption(few, ["g"], strategy=strategy, spine=spine, until="upto")
    laid_out = runs.withColumn("d", F.explode(F.sequence("d", "upto")))
    assert collect(laid_out, *days.columns) == collect(days, *days.columns)
    assert strategy == "explode" or runs.count() < days.count()


def test_unknown_strategy_is_refused(few):
    with pytest.raises(ValueError):
        intervals.daily_consumption(few, strategy="other")


def test_context_columns(few):
    third = next(r for r in intervals.daily_context(few, ["x"], ["f"]).collect() if r.d == D(2020, 1, 3))
    assert (third.x_avg, third.f) == (2.0, 0.5)
    assert third.x_std == pytest.approx(2**0.5)
    empty = next(r for r in intervals.daily_context(few, ["x"], ["f"]).collect() if r.d == D(2020, 1, 5))
    assert (empty.n, float(empty.consumption), empty.x_avg, empty.f) == (0, 0.0, None, None)


def test_numeric_context_strategies_agree(spark):
    b = testtables.billing_dedup(spark, SMALL)
    a = intervals.numeric_context(b, ["num_a", "l_extendedprice"], ["cat_a"])
    z = intervals.numeric_context(b, ["num_a", "l_extendedprice"], ["cat_a"], strategy="explode")
    j = a.join(z.select("cat_a", "d", *[F.col(c).alias(f"{c}_z") for c in z.columns[2:]]), ["cat_a", "d"], "full")
    for c in ("num_a_avg", "num_a_std", "l_extendedprice_avg", "l_extendedprice_std"):
        assert j.filter(~F.coalesce(F.abs(F.col(c) - F.col(f"{c}_z")) <= 1e-6, F.col(c).isNull() & F.col(f"{c}_z").isNull())).count() == 0
    assert j.filter("n <> n_z or n is null or n_z is null").count() == 0


def test_fractions_sum_to_one_and_pivot(few):
    f = intervals.category_fractions(few, ["c"])
    sums = f.groupBy("d").agg(F.sum("fraction").alias("s")).collect()
    assert all(r.s == pytest.approx(1.0) for r in sums)
    wide = {r.d: r for r in intervals.pivot_fractions(f, {"c": ["u", "v"]}).collect()}
    assert (wide[D(2020, 1, 3)].c_u, wide[D(2020, 1, 1)].c_v) == (0.5, 0.0)
    assert D(2020, 1, 7) not in wide


def test_interval_join_equals_brute_force(spark):
    b = testtables.billing_dedup(spark, SMALL).select("account", "start_d", "end_d")
    dates = b.select(F.trunc("start_d", "week").alias("d")).distinct()
    got = intervals.active_on(b, dates, span=10).groupBy("d").count()
    want = b.join(dates, F.col("d").between(F.col("start_d"), F.col("end_d"))).groupBy("d").count()
    assert collect(got, "d", "count") == collect(want, "d", "count")


def test_small_decimals_survive(spark):
    df = spark.createDataFrame(
        [("1", D(2020, 1, 1), D(2020, 1, 1), 1.2345, 1.9438395), ("2", D(2020, 1, 1), D(2020, 1, 1), 0.0001, 0.0000001)],
        "account string, start_d date, end_d date, consumption double, x double",
    )
    r = intervals.daily_context(df, ["x"], []).first()
    assert float(r.consumption) == pytest.approx(1.2346, abs=1e-9)
    assert r.x_avg == pytest.approx((1.9438395 + 0.0000001) / 2, abs=1e-12)


def test_first_day_cuts_history_only(spark):
    b = testtables.billing_dedup(spark, SMALL)
    whole = intervals.daily_consumption(b, ["rate_class"]).filter("d >= '1999-06-01'")
    part = intervals.daily_consumption(b, ["rate_class"], first_day="1999-06-01")
    assert collect(whole, "rate_class", "d", "n", "consumption") == collect(part, "rate_class", "d", "n", "consumption")


dates = st.dates(D(2020, 1, 1), D(2020, 3, 31))
records = st.lists(st.tuples(dates, st.integers(0, 40), st.integers(0, 500), st.sampled_from("ab")), min_size=1, max_size=12)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(records)
def test_strategies_agree_and_conserve(spark, recs):
    df = make(
        spark,
        [
            (str(i), g, s, s + dt.timedelta(days=n), Decimal(q), 1.0, 1.0, "u")
            for i, (s, n, q, g) in enumerate(recs)
        ],
    )
    delta = collect(intervals.daily_consumption(df, ["g"], spine=True), "g", "d", "n", "consumption")
    explode = collect(intervals.daily_consumption(df, ["g"], strategy="explode", spine=True), "g", "d", "n", "consumption")
    assert delta == explode
    assert float(sum(r[3] for r in delta)) == pytest.approx(sum(q for _, _, q, _ in recs), abs=1e-3)


def test_late_records_replace_the_tail(spark):
    b = testtables.billing_dedup(spark, SMALL)
    old = b.filter("start_d < '2001-01-01'")
    cut = series.look_back_cut(old)
    merged = series.replace_tail(
        intervals.daily_consumption(old), intervals.daily_consumption(b, first_day=cut), cut, "d"
    )
    # Late records start after the cut, so the incremental result equals the complete one.
    assert collect(merged, "d", "n", "consumption") == collect(intervals.daily_consumption(b), "d", "n", "consumption")


def test_month_rules(spark):
    df = make(
        spark,
        [
            ("1", "old", D(2020, 3, 1), D(2020, 6, 29), Decimal(120), 1.0, 1.0, "u"),
            ("1", "new", D(2020, 6, 30), D(2020, 9, 1), Decimal(63), 1.0, 1.0, "u"),
            ("2", "zero", D(2020, 8, 20), D(2020, 8, 20), Decimal(5), 1.0, 1.0, "u"),
            ("3", "gone", D(2018, 1, 1), D(2019, 1, 1), Decimal(5), 1.0, 1.0, "u"),
        ],
    )
    new = {r.account: r for r in clients.client_profiles(df, "2020-09-17", ["g"]).collect()}
    old = {r.account: r for r in clients.client_profiles(df, "2020-09-17", ["g"], compat=True).collect()}
    assert set(new) == {"1", "2"} and new["1"].g == "new"
    # 17 July to 17 August lies inside the second interval: 31 of its 63 days.
    assert float(new["1"].cons_1m_ago) == pytest.approx(31.0)
    assert float(old["1"].cons_1m_ago) == 0.0
    assert float(new["1"].cons_0m_ago) == float(old["1"].cons_0m_ago) == pytest.approx(15.0)
    assert float(new["2"].cons_0m_ago) == 0.0
    total = sum(float(new["1"][f"cons_{m}m_ago"]) for m in range(12))
    assert total == pytest.approx(183.0, abs=1e-3)


def test_hot_key_is_cut_before_the_shuffle(spark):
    b = testtables.billing(spark, SMALL)
    plan = dedup.keep_last(b, testtables.BILLING_KEY, testtables.LOAD_ORDER)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange hashpartitioning"):]
    assert "WindowGroupLimit" in below


def test_delta_reads_only_needed_columns(spark):
    plan = intervals.daily_consumption(testtables.billing_dedup(spark, SMALL))._jdf.queryExecution().executedPlan().toString()
    assert "l_returnflag" not in plan and "l_discount" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
