"""Lag regression and order selection without windows, against the direct solutions."""

import datetime as dt
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_learning import table

from usage_ts.learning import forecasters as FC
from usage_ts.learning import lagged, orders
from usage_ts.learning.solvers import lagged as columns_of
from usage_ts.learning.solvers import least_squares
from usage_ts.plans import forecasting


def walk(n, seed):
    rng = np.random.default_rng(seed)
    return np.cumsum(rng.normal(size=n)) + 5 * np.sin(np.arange(n) * 2 * np.pi / 7)


@pytest.mark.parametrize(("n", "width"), [(2, 1), (12, 5), (60, 7), (1500, 300), (700, 300)])
def test_lag_sums_equal_windows(n, width):
    y = walk(n, n)
    z = (y - y.mean()) / y.std()
    x = np.column_stack([z[width:], columns_of(z, list(range(1, width + 1)), width)])
    assert lagged.lag_gram(z, width) == pytest.approx(x.T @ x, abs=1e-9)
    fit = lagged.LinearLags.fit(y, {"T_X": width})
    oldest_first = columns_of(z, list(range(width, 0, -1)), width)
    design = np.column_stack([np.ones(n - width), oldest_first])
    b = least_squares(design, z[width:])
    assert fit.fitted[width:] == pytest.approx((design @ b) * y.std() + y.mean(), abs=1e-6)


@pytest.mark.parametrize("y", [np.ones(40), np.arange(40.0), np.tile([1.0, 2.0, 3.0], 14)])
def test_lags_that_do_not_vary(y):
    fit = lagged.LinearLags.fit(y, {"T_X": 6})
    assert fit.fitted[6:] == pytest.approx(y[6:]) and np.isfinite(lagged.LinearLags.ahead(fit.coef, fit.state, 5, {})).all()


def test_every_order_equals_its_own_fit(spark):
    y = walk(400, 3)
    c = y - y.mean()
    r = np.array([c[k:] @ c[: len(c) - k] for k in range(31)]) / len(c)
    got = {row.order: row for row in orders.all_orders(table(spark, a=y), 30).collect()}
    assert sorted(got) == list(range(31))
    for p in range(1, 31):
        phi = np.linalg.solve(r[np.abs(np.subtract.outer(range(p), range(p)))], r[1 : p + 1])
        assert got[p].coef == pytest.approx(phi, abs=1e-8)
        assert got[p].variance == pytest.approx(r[0] - phi @ r[1 : p + 1])
    best = orders.best_order(orders.all_orders(table(spark, a=y), 30)).first()
    assert best.aic == min(row.aic for row in got.values())


def test_orders_of_short_and_constant_series(spark):
    s = table(spark, one=[4.0], two=[1.0, 2.0], flat=[3.0] * 9)
    got = orders.all_orders(s, 5).groupBy("series_key").agg(F.max("order").alias("p"), F.count("aic").alias("n")).collect()
    assert {r.series_key: (r.p, r.n) for r in got} == {"one": (0, 0), "two": (1, 2), "flat": (0, 0)}
    assert {r.series_key for r in orders.best_order(orders.all_orders(s, 5)).collect()} == {"one", "two", "flat"}


def test_autoregression_recovers_a_model(spark):
    rng = np.random.default_rng(7)
    y = np.zeros(4000)
    for t in range(2, len(y)):
        y[t] = 0.6 * y[t - 1] - 0.3 * y[t - 2] + rng.normal()
    y += 50
    s = FC.with_params(table(spark, a=y), "autoregression")
    row = FC.fit_models(s, "autoregression").first()
    assert row.coef[0] == pytest.approx(50, abs=0.2) and row.coef[1:3] == pytest.approx([0.6, -0.3], abs=0.05)
    ahead = [r.yhat for r in FC.forecast(FC.fit_models(s, "autoregression"), 300).orderBy("ds").collect()]
    assert ahead[-1] == pytest.approx(row.coef[0], abs=1e-6)


def test_runs_of_equal_days_score_like_single_days(spark):
    day = lambda n: dt.date(2001, 1, 1) + dt.timedelta(n)
    rng = np.random.default_rng(2)
    rows = []
    for key, runs in (("long", 40), (None, 25), ("short", 1)):
        at = 0
        for i in range(runs):
            lasting = int(rng.integers(1, 5))
            rows.append((key, day(at), day(at + lasting - 1), float(rng.integers(0, 9)), "test" if i > 35 else "train"))
            at += lasting + (i == 7)
    runs = FC.with_params(spark.createDataFrame(rows, "series_key string, ds date, upto date, y double, role string"), "linear_regression", {"T_X": 3})
    single = runs.withColumn("ds", F.explode(F.sequence("ds", "upto"))).drop("upto")
    arrays = F.arrays_zip("ds", "gt", "model", "forecast", "test_pred")
    packed = FC.evaluate(runs, "linear_regression", until="upto")
    key = lambda r: (r["series_key"] or "", r["ds"])
    got = sorted(packed.select("series_key", F.inline(arrays)).collect(), key=key)
    want = sorted(FC.evaluate(single, "linear_regression").collect(), key=key)
    assert packed.count() == 3 and [r[:2] for r in got] == [r[:2] for r in want]
    assert [r[2:] for r in got] == [pytest.approx(r[2:]) for r in want]
    assert any(r["test_pred"] is not None for r in got) and any(r["model"] is None for r in got)


def test_days_of_an_account_are_neither_sorted_nor_shuffled(spark, tmp_path):
    lines = [(o, 1, 1, n, float(o + n), 1.0, 0.1, 0.1, "R", "O", f"1995-{1 + o:02d}-{n + 1:02d}") for o in range(1, 12) for n in range(1, 8)]
    kinds = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double"
    kinds += ", l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate string"
    spark.createDataFrame(lines, kinds).write.parquet(f"{tmp_path}/lineitem.parquet")
    orders_ = [(o, 1 if o < 11 else 2, "a") for o in range(1, 12)]
    spark.createDataFrame(orders_, "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, "x"), (2, "y")], "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    got = forecasting.lag_regression_by_account(spark, str(tmp_path))
    assert {r["series_key"]: (r["n_rows"] > 300, r["condition"]) for r in got.collect()} == {1: (True, 0.0), 2: (False, None)}
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    above = plan.split("MapInArrow")[0]
    assert "MapInArrow" in plan and "explode(sequence" not in plan
    assert "Sort [" not in above and "Window" not in above and above.count("Exchange") == above.count("partial_count(1)") == 1
    dealt = re.findall(r"Exchange hashpartitioning\((\w+)#", plan.split("MapInArrow")[1])
    assert set(dealt) <= {"o_custkey", "l_orderkey", "o_orderkey", "c_custkey"} and dealt.count("o_custkey") == 1
