"""Product-form seasonal ARMA: simulated terms come back, errors are orthogonal, forecasts follow the equation."""

import numpy as np
import pytest
from test_learning import table

from usage_ts.learning import forecasters as FC
from usage_ts.learning import seasonal
from usage_ts.learning.lagged import Arma
from usage_ts.learning.seasonal import Order, SeasonalArma
from usage_ts.learning.solvers import roll_forward

DEFAULT = {"P": 7, "D": 1, "Q": 0, "SEASONAL_P": 1, "SEASONAL_D": 1, "SEASONAL_Q": 0, "M": 365}
WEEKLY = {"P": 1, "D": 1, "Q": 1, "SEASONAL_P": 1, "SEASONAL_D": 1, "SEASONAL_Q": 1, "M": 7}
CASES = [
    (DEFAULT, [0, 0.4, -0.2, 0.1, 0, 0.1, -0.1, 0.2, -0.3], 6000),
    (WEEKLY, [0, 0.5, 0.4, 0.4, -0.6], 6000),
    ({"P": 2, "D": 0, "Q": 2}, [3, 0.5, 0.2, 0.3, 0.3], 6000),
    ({"P": 0, "D": 1, "Q": 1}, [0, -0.5], 4000),
]


def simulated(params, coef, n, seed=1, burn=3000):
    """A series that follows the model, value after value."""
    order, rng = Order.of(params), np.random.default_rng(seed)
    c, (ar, sar, ma, sma) = order.split(np.array(coef, float))
    auto, mean = np.convolve(ar, sar), np.convolve(ma, sma)
    shocks = c + np.convolve(rng.normal(size=n + burn + len(mean) - 1), mean, mode="valid")
    back = [k for k in range(1, len(auto)) if auto[k]]
    w = roll_forward(np.zeros(len(auto)), back, -auto[back], shocks, n + burn)[-n:]
    poly = order.differences
    back = [k for k in range(1, len(poly)) if poly[k]]
    return roll_forward(np.full(len(poly) - 1, 100.0), back, -poly[back], w, n) if back else w


@pytest.mark.parametrize(("params", "coef", "n"), CASES)
def test_simulated_terms_come_back(params, coef, n):
    fit = SeasonalArma.fit(simulated(params, coef, n), params)
    assert fit.coef[1:] == pytest.approx(coef[1:], abs=0.09)


@pytest.mark.parametrize(("params", "coef", "n"), CASES)
def test_errors_follow_the_equation_and_are_orthogonal(params, coef, n):
    """Errors by plain recursion, derivatives by differences of the whole fit."""
    n = min(n, 1500)
    y, order = simulated(params, coef, n, seed=2), Order.of(params)
    fit = SeasonalArma.fit(y, params)
    w = np.convolve(y, order.differences, mode="valid")

    def errors(b):
        c, (ar, sar, ma, sma) = order.split(b)
        auto, mean = np.convolve(ar, sar), np.convolve(ma, sma)
        u = np.convolve(w, auto, mode="valid") - c
        back = list(range(1, len(mean)))
        return roll_forward(np.zeros(len(back)), back, -mean[1:], u, len(u)) if back else u

    e = errors(fit.coef)
    assert y[len(y) - len(e) :] - fit.fitted[len(y) - len(e) :] == pytest.approx(e, abs=1e-7)
    for i in range(0 if order.constant else 1, len(fit.coef)):
        h = np.eye(len(fit.coef))[i] * 1e-5
        slope = (errors(fit.coef + h) - errors(fit.coef - h)) / 2e-5
        assert abs(slope @ e) < 1e-5 * np.sqrt((slope @ slope) * (e @ e))
        # A least sum of squares: no step to either side is lower.
        assert min(np.sum(errors(fit.coef + s * 1e-3 * np.eye(len(fit.coef))[i]) ** 2) for s in (-1, 1)) > e @ e


@pytest.mark.parametrize(("params", "coef", "n"), CASES)
def test_forecast_days_leave_no_error(params, coef, n):
    y, order = simulated(params, coef, min(n, 1500), seed=3), Order.of(params)
    fit = SeasonalArma.fit(y, params)
    longer = np.concatenate([y, SeasonalArma.ahead(fit.coef, fit.state, 400, params)])
    e = seasonal.errors(np.convolve(longer, order.differences, mode="valid"), order, fit.coef)
    assert np.abs(e[-400:]).max() < 1e-7 < np.abs(e[:-400]).max()


def test_not_worse_than_two_regressions():
    rng = np.random.default_rng(3)
    y = np.cumsum(rng.normal(size=2500)) + np.convolve(rng.normal(size=2529), np.ones(30), mode="valid")
    params = {"P": 2, "D": 1, "Q": 14}
    fit, order = SeasonalArma.fit(y, params), Order.of(params)
    w = np.diff(y)
    begin = seasonal.errors(w, order, seasonal.start(w, order))
    end = seasonal.errors(w, order, fit.coef)
    assert end @ end < 0.999 * (begin @ begin)


def test_one_seasonal_lag_equals_the_regression():
    y = simulated({"P": 0, "SEASONAL_P": 1, "M": 7, "D": 1}, [0, 0.5], 400)
    params = {"P": 0, "D": 1, "Q": 0, "SEASONAL_P": 1, "M": 7}
    assert SeasonalArma.fit(y, params).coef == pytest.approx(Arma.fit(y, params).coef, abs=1e-9)


def test_growing_series_stay_at_the_border():
    y = 1.05 ** np.arange(200)
    fit = SeasonalArma.fit(y, {"P": 1, "D": 0, "Q": 0})
    assert abs(fit.coef[1]) < 1 and np.isfinite(SeasonalArma.ahead(fit.coef, fit.state, 50, {"P": 1})).all()


@pytest.mark.parametrize("n", [1, 2, 5, 40])
def test_short_and_constant_series_have_a_result(spark, n):
    s = FC.with_params(table(spark, a=[4.0] * n, b=list(range(n))), "sarimax", WEEKLY)
    models = FC.fit_models(s, "sarimax")
    ahead = FC.forecast(models, 3).collect()
    assert len(ahead) == 6 and all((r.yhat is None) == (n < 40) for r in ahead)


def test_series_with_a_gap_of_nulls_is_left_unfitted():
    y = np.where(np.arange(300) == 50, np.nan, np.arange(300.0))
    assert len(SeasonalArma.fit(y, {"P": 1, "D": 1, "Q": 1}).coef) == 0
