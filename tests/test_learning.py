"""Forecasters recover what generated a series; searches are reproducible; saved models forecast."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from usage_ts.learning import additive, forest, search
from usage_ts.learning import forecasters as FC
from usage_ts.learning.lagged import Arma, LinearLags
from usage_ts.learning.solvers import difference_weights
from usage_ts.operators import series
from usage_ts.plans import jobs
from usage_ts.sources import store

D0 = dt.date(2018, 1, 1)


def table(spark, **named):
    parts = [
        pd.DataFrame({"series_key": k, "ds": [D0 + dt.timedelta(days=i) for i in range(len(y))], "y": np.asarray(y, float)})
        for k, y in named.items()
    ]
    return spark.createDataFrame(pd.concat(parts), "series_key string, ds date, y double")


def ar(phi, n, seed, mean=0.0):
    rng = np.random.default_rng(seed)
    y = np.zeros(n)
    for t in range(len(phi), n):
        y[t] = sum(p * y[t - i - 1] for i, p in enumerate(phi)) + rng.normal()
    return y + mean


@pytest.fixture(scope="module")
def weekly():
    rng = np.random.default_rng(5)
    t = np.arange(900)
    return 100 + 0.05 * t + 10 * np.sin(2 * np.pi * (t + 17897) / 7) + 20 * np.cos(2 * np.pi * (t + 17532) / 365.25) + rng.normal(0, 0.5, len(t))


def test_ar_and_ma_terms_are_recovered():
    fit = Arma.fit(ar([0.6, 0.2], 6000, 1), {"P": 2, "D": 0, "Q": 0})
    assert fit.coef[1:] == pytest.approx([0.6, 0.2], abs=0.04)
    e = np.random.default_rng(2).normal(size=8001)
    w = np.zeros(8000)
    for t in range(1, 8000):
        w[t] = 0.5 * w[t - 1] + e[t + 1] + 0.4 * e[t]
    fit = Arma.fit(np.cumsum(w), {"P": 1, "D": 1, "Q": 1})
    assert fit.coef[1:] == pytest.approx([0.5, 0.4], abs=0.06)


def test_difference_polynomial():
    assert list(difference_weights(1, 1, 3)) == [1, -1, 0, -1, 1]
    assert list(difference_weights(0, 0, 1)) == [1]


def test_seasonal_arma_continues_a_pattern_exactly():
    y = np.tile([1.0, 5.0, 2.0, 8.0, 3.0, 3.0, 9.0], 20) + np.arange(140) * 0.5
    params = {"P": 1, "D": 1, "Q": 0, "SEASONAL_P": 1, "SEASONAL_D": 1, "SEASONAL_Q": 0, "M": 7}
    fit = Arma.fit(y, params)
    want = np.tile([1.0, 5.0, 2.0, 8.0, 3.0, 3.0, 9.0], 2) + np.arange(140, 154) * 0.5
    assert Arma.ahead(fit.coef, fit.state, 14, params) == pytest.approx(want, abs=1e-6)


def test_one_step_and_recursion_agree_on_the_first_day():
    y = ar([0.5, 0.3], 500, 3, mean=50)
    p = {"T_X": 5}
    fit = LinearLags.fit(y[:400], p)
    steps = LinearLags.one_step(fit.coef, fit.state, y[400:], p)
    ahead = LinearLags.ahead(fit.coef, fit.state, 100, p)
    assert steps[0] == pytest.approx(ahead[0]) and len(steps) == 100
    assert np.isnan(fit.fitted[:5]).all() and not np.isnan(fit.fitted[5:]).any()


def test_short_series_do_not_fail_the_others(spark):
    df = FC.with_params(table(spark, long=ar([0.5], 200, 1, 9), short=[1, 2, 3]), "linear_regression", {"T_X": 10})
    models = FC.fit_models(df, "linear_regression")
    assert {r.series_key: len(r.coef) for r in models.collect()} == {"long": 13, "short": 0}
    f = FC.forecast(models, 4)
    assert f.filter("yhat is null").select("series_key").distinct().collect()[0][0] == "short"
    first = f.filter("series_key = 'long'").agg(F.min("ds")).first()[0]
    assert first == D0 + dt.timedelta(days=200)


@pytest.mark.parametrize("name,params", [("linear_regression", {"T_X": 14}), ("sarimax", {"M": 7}), ("arima", {"Q": 14})])
def test_models_beat_the_last_value(spark, weekly, name, params):
    split = series.split_fixed(table(spark, a=weekly, b=weekly * 2), 60)
    board = search.evaluate_all(split, {"last_value": None, name: params}).collect()
    mae = {(r.series_key, r.model_name): r.MAE for r in board}
    for k in "ab":
        assert mae[(k, name)] < 0.7 * mae[(k, "last_value")]


def test_saved_models_forecast_the_same(spark, weekly, tmp_path):
    df = FC.with_params(table(spark, a=weekly), "sarimax", {"M": 7})
    models = FC.fit_models(df, "sarimax")
    store.save_models(models, str(tmp_path / "m"))
    a = FC.forecast(models, 30).orderBy("ds").toPandas()
    b = FC.forecast(store.load_models(spark, str(tmp_path / "m")), 30).orderBy("ds").toPandas()
    assert a.equals(b) and len(a) == 30


def test_additive_recovers_parts_and_they_add_up(spark, weekly, tmp_path):
    bump = weekly.copy()
    holidays = [i for i in range(900) if (D0 + dt.timedelta(days=i)).strftime("%m%d") in ("0701", "0702")]
    bump[holidays] += 15
    s = table(spark, a=bump)
    cal = spark.createDataFrame([("h", dt.date(y, 7, 1)) for y in range(2018, 2022)], "holiday string, ds date")
    model = additive.forecaster(cal, {"h": "is_h"})
    loose = {"SEASONALITY_PRIOR_SCALE": 10.0, "HOLIDAYS_PRIOR_SCALE": 10.0, "CHANGEPOINT_PRIOR_SCALE": 0.05}
    models = FC.fit_models(FC.with_params(s, model, loose), model)
    row = models.first()
    assert row.b_holidays[0] == pytest.approx(15, abs=1.0)
    dates = series.holiday_flags(s.select("series_key", "ds"), cal, {"h": "is_h"}).withColumn("params", F.lit(None))
    parts = additive.components(dates, models.drop("model"), holidays=["is_h"]).toPandas()
    total = parts[["trend", "yearly", "weekly", "holidays"]].sum(axis=1)
    assert np.allclose(total, parts["yhat"])
    assert parts["weekly"].max() == pytest.approx(10, abs=0.5)
    assert np.abs(parts.sort_values("ds")["yhat"].to_numpy() - bump).mean() < 1.0
    text = additive.seasonality_parameters(models).filter("component = 'weekly'").first().parameters
    assert '"period":7.0' in text and '"fourier_order":3' in text
    ahead = FC.forecast(models, 20, model=model)
    assert ahead.count() == 20 and ahead.filter("yhat is null").count() == 0
    jobs.save_decomposition(dates, models.drop("model"), str(tmp_path), holidays=["is_h"])
    assert spark.read.parquet(str(tmp_path / "trend_component")).count() == 900
    assert spark.read.json(str(tmp_path / "seasonality_parameters")).count() == 2
    jobs.save_forecast(ahead, str(tmp_path / "forecast"))
    assert (tmp_path / "forecast" / "series_key=a").exists()


def test_multiplicative_mode_fits_growing_seasons(spark):
    t = np.arange(800)
    y = (50 + 0.2 * t) * (1 + 0.3 * np.sin(2 * np.pi * (t + 17532) / 7))
    split = series.split_fixed(table(spark, a=y), 100)
    loose = {"SEASONALITY_PRIOR_SCALE": 10.0, "CHANGEPOINT_PRIOR_SCALE": 0.001}
    mape = {}
    for mode in ("additive", "multiplicative"):
        _, metrics, _ = jobs.train(
            split.drop("role"), "additive", loose | {"SEASONALITY_MODE": mode}, test_rows=100
        )
        mape[mode] = metrics.first().MAPE
    assert mape["multiplicative"] < 0.02 < mape["additive"]


def test_cross_validation_and_search(spark, weekly):
    s = table(spark, a=weekly)
    cv = search.cross_validate(s, "linear_regression", {"T_X": 14}, 10, 3)
    assert sorted(r.fold for r in cv.collect()) == [8, 9, 10]
    space = {
        "T_X": {"TYPE": "int_uniform", "RANGE": [1, 20]},
        "K": {"TYPE": "set", "RANGE": ["a", "b"]},
        "L": {"TYPE": "float_log", "RANGE": [0.001, 0.5]},
        "U": {"TYPE": "float_uniform", "RANGE": [0.0, 0.5]},
        "N": {"TYPE": "set", "RANGE": None},
    }
    trials = search.sample_trials(space, 5, 1)
    assert trials == search.sample_trials(space, 5, 1) and trials != search.sample_trials(space, 5, 2)
    assert all(1 <= t["T_X"] <= 20 and 0.001 <= t["L"] <= 0.5 and "N" not in t for t in trials)
    out = search.search(s, "linear_regression", [{"T_X": 1}, {"T_X": 14}], "RMSE", 10, 3).collect()
    best = next(r for r in out if r.trial == "Best")
    assert '"T_X": 14' in best.params and len(out) == 3
    assert best.score == min(r.score for r in out)


def test_order_search_prefers_the_true_order(spark):
    y = np.cumsum(ar([0.6, -0.5], 3000, 8))
    best = FC.select_order(table(spark, a=y), "arima", [{"P": p, "D": 1, "Q": 0} for p in (1, 2)]).first()
    assert '"P": 2' in best.params and best.fits == 2


def test_forest_walk_equals_model(spark, weekly):
    s = table(spark, a=weekly[:300], b=weekly[300:600])
    stats = series.fit_scale(s, ["y"])
    w = forest.windows(s, stats, 7).persist()
    model = forest.fit_forest(w, trees=5, depth=4, seed=1)
    pred = forest.predictions(model, w, stats)
    assert pred.agg(F.avg(F.abs(F.col("yhat") - F.col("y")))).first()[0] < 5
    # The first step of the walk is the model's own prediction for the newest window.
    newest = series.recent_window(s, 7).join(stats, "series_key")
    scaled = newest.select(
        "series_key", "y_mean", "y_scale",
        forest.array_to_vector(F.transform("window", lambda x: (x - F.col("y_mean")) / F.col("y_scale"))).alias("features"),
    )
    want = {r.series_key: r.prediction * r.y_scale + r.y_mean for r in model.transform(scaled).collect()}
    ahead = forest.recursive_forecast(model, s, stats, 7, 10)
    got = {r.series_key: r.yhat for r in ahead.filter(F.col("ds").isin(D0 + dt.timedelta(days=300))).collect()}
    assert got == pytest.approx(want) and ahead.count() == 20


def test_every_step_of_a_walk_is_the_models_own(spark, weekly, tmp_path):
    """Over the seams between written states, and with columns of the caller's own."""
    s = table(spark, a=weekly[:200], b=weekly[200:400])
    stats = series.fit_scale(s, ["y"])
    model = forest.fit_forest(forest.windows(s, stats, 5), trees=4, depth=3, seed=1)
    z = {k: [(v - np.mean(y)) / np.std(y) for v in y] for k, y in (("a", weekly[:200]), ("b", weekly[200:400]))}
    states = spark.createDataFrame([(k, [float(v) for v in y[-5:]]) for k, y in z.items()], "series_key string, window array<double>")
    got = {(r.series_key, r.step): r.prediction for r in forest.walk(model, states, 7, str(tmp_path), every=3).collect()}
    assert sorted(p.name for p in tmp_path.iterdir()) == ["from-0000001", "from-0000004", "from-0000007"]
    for k, y in z.items():
        window = list(y[-5:])
        for step in range(1, 8):
            one = spark.createDataFrame([([float(v) for v in window[-5:]],)], "w array<double>").select(forest.array_to_vector("w").alias("features"))
            window.append(model.transform(one).first().prediction)
            assert got[(k, step)] == window[-1]


def test_forest_by_name_in_every_comparison(spark, weekly):
    s = table(spark, a=weekly[:300], b=weekly[300:600], c=weekly[:3])
    small = {"T_X": 7, "N_ESTIMATORS": 2, "MAX_DEPTH": 4}
    cv = search.cross_validate(s, "random_forest", small, 20, 2).collect()
    assert sorted((r.series_key, r.fold) for r in cv if r.fold) == [(k, f) for k in "ab" for f in (19, 20)]
    assert [r.MAE for r in cv if r.series_key == "c"] == [None] and all(r.MAE < 60 for r in cv if r.fold)
    found = search.search(s, "random_forest", [small, {**small, "MAX_DEPTH": 1}], "RMSE", 20, 1).collect()
    best = {r.series_key: r.params for r in found if r.trial == "Best"}
    assert '"MAX_DEPTH": 4' in best["a"] and best["c"] is None
    split = series.split_fixed(s, 12)
    metrics, ahead = search.evaluate_refit_forecast(split, "random_forest", 12, small)
    assert ahead.filter("yhat IS NOT NULL").groupBy("series_key").count().collect() and metrics.count() == 3
    assert {r["count"] for r in ahead.groupBy("series_key").count().collect()} == {12}
    board = search.evaluate_all(split, {"last_value": None, "random_forest": small}).collect()
    assert {(r.series_key, r.model_name) for r in board} == {(k, m) for k in "abc" for m in ("last_value", "random_forest")}


def test_forest_without_any_window_gives_nulls(spark):
    s = FC.with_params(table(spark, a=[1.0, 2.0], b=[3.0]), "random_forest", {"T_X": 5})
    models = FC.fit_models(s, "random_forest")
    assert [r.path for r in models.collect()] == [None, None]
    assert [r.yhat for r in FC.forecast(models, 3, model="random_forest").collect()] == [None] * 6


def test_refit_uses_all_rows(spark, weekly):
    split = series.split_fixed(table(spark, a=weekly), 60)
    metrics, ahead = search.evaluate_refit_forecast(split, "linear_regression", 5, {"T_X": 7})
    assert metrics.count() == 1
    assert ahead.agg(F.min("ds")).first()[0] == D0 + dt.timedelta(days=900)
