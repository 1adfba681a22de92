"""Lag regression of several features against windows laid out, and its forecasts step by step."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from usage_ts.learning import forecasters as FC
from usage_ts.learning import multivariate, search
from usage_ts.learning.solvers import least_squares
from usage_ts.plans import jobs

D0 = dt.date(2018, 1, 1)


def simulated(n, seed=0):
    rng = np.random.default_rng(seed)
    y = np.zeros((n, 2))
    for t in range(2, n):
        y[t] = [0.5 * y[t - 1, 0] + 0.3 * y[t - 1, 1], -0.2 * y[t - 2, 0] + 0.4 * y[t - 1, 1]] + rng.normal(size=2)
    return y * [3, 0.5] + [50, 7]


def table(spark, **named):
    parts = [
        pd.DataFrame({"series_key": k, "ds": [D0 + dt.timedelta(days=i) for i in range(len(y))], "y": y[:, 0], "x.1": y[:, 1]})
        for k, y in named.items()
    ]
    return spark.createDataFrame(pd.concat(parts), "series_key string, ds date, y double, `x.1` double")


@pytest.mark.parametrize(("n", "width"), [(12, 1), (40, 5), (400, 30), (900, 100)])
def test_block_sums_equal_windows(n, width):
    y = simulated(n)
    z = (y - y.mean(axis=0)) / y.std(axis=0)
    x = np.column_stack([z[width:], multivariate.windows_of(z, width)[:-1]])
    assert multivariate.block_gram(z, width) == pytest.approx(x.T @ x, abs=1e-8)
    model = multivariate.fit(y, width)
    design = np.column_stack([np.ones(n - width), multivariate.windows_of(z, width)[:-1]])
    direct = design @ least_squares(design, z[width:])
    assert multivariate.predicted(y, width, model) == pytest.approx(direct * y.std(axis=0) + y.mean(axis=0), abs=1e-5)


def test_features_that_do_not_vary_or_repeat():
    y = simulated(60)
    for extra in (np.ones(60), y[:, 0]):
        both = np.column_stack([y, extra])
        model = multivariate.fit(both, 3)
        known = multivariate.predicted(both, 3, model)
        assert np.isfinite(known).all()
        assert known[:, 0] == pytest.approx(multivariate.predicted(y, 3, multivariate.fit(y, 3))[:, 0], abs=1e-6)


def test_model_is_recovered_and_fed_back(spark):
    y = simulated(6000, 3)
    s = FC.with_params(table(spark, a=y, b=simulated(50, 4)), multivariate.forecaster(["x.1"]), {"T_X": 2})
    models = multivariate.fit_features(s, ["y", "x.1"])
    row = models.filter("series_key = 'a'").first()
    mean, scale, coef = np.array(row.coef[:2]), np.array(row.coef[2:4]), np.array(row.coef[4:]).reshape(2, 5)
    own = coef[:, 1:] * np.tile(1 / (scale / [3, 0.5]), 2) * (scale / [3, 0.5])[:, None]
    assert own == pytest.approx(np.array([[0.5, 0.3, 0, 0], [0, 0.4, -0.2, 0]]), abs=0.04)
    ahead = multivariate.forecast_features(models, ["y", "x.1"], 5).filter("series_key = 'a'").orderBy("ds").collect()
    z = [(v - mean) / scale for v in np.array(row.state).reshape(2, 2)]
    for r in ahead:
        z.append(coef[:, 0] + coef[:, 1:] @ np.concatenate([z[-1], z[-2]]))
        assert [r.y, r["x.1"]] == pytest.approx(z[-1] * scale + mean)
    assert ahead[0].ds == D0 + dt.timedelta(days=6000)


def test_short_series_and_unknown_values(spark):
    y = simulated(40)
    holes = y.copy()
    holes[5, 1], holes[9, 0] = np.nan, np.inf
    s = FC.with_params(table(spark, short=y[:3], holes=holes), multivariate.forecaster(["x.1"]), {"T_X": 3})
    models = {r.series_key: r for r in multivariate.fit_features(s, ["y", "x.1"]).collect()}
    assert models["short"].coef == [] and models["holes"].n_rows == 38
    kept = np.delete(holes, [5, 9], axis=0)
    assert models["holes"].coef == pytest.approx(np.concatenate([m.ravel() for m in multivariate.fit(kept, 3)]))
    ahead = multivariate.forecast_features(multivariate.fit_features(s, ["y", "x.1"]), ["y", "x.1"], 4).collect()
    assert sorted((r.series_key, r.y is None) for r in ahead) == [("holes", False)] * 4 + [("short", True)] * 4
    assert multivariate.fit_features(s.limit(0), ["y", "x.1"]).count() == 0


def test_as_a_forecaster(spark):
    s = table(spark, a=simulated(300, 5), b=simulated(300, 6))
    model = multivariate.forecaster(["x.1"])
    bands, metrics, models = jobs.train(s, model, {"T_X": 2}, test_rows=30)
    assert metrics.count() == 2 and all(r.MAE < 12 for r in metrics.collect())
    assert FC.forecast(models, 7, model=model).filter("yhat is not null").count() == 14
    assert search.cross_validate(s, model, {"T_X": 2}).count() == 10
