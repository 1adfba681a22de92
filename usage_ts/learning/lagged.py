"""Forecasters on lag windows and on lagged errors.

A forecaster is three functions of one series: ``fit`` gives a :class:`Fit`,
``ahead`` continues a series from the fit alone, ``one_step`` predicts given
later rows from their actual predecessors. ``coef`` and ``state`` are all that a
saved model needs. A series too short for the model gets no coefficients and NaN
predictions, so that it does not fail the job that fits its neighbours.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from usage_ts.learning.solvers import difference_weights, lagged, least_squares, roll_forward, solve_symmetric


@dataclass
class Fit:
    coef: np.ndarray
    state: np.ndarray
    fitted: np.ndarray
    aic: float = float("nan")


def unfitted(y: np.ndarray) -> Fit:
    return Fit(np.empty(0), np.empty(0), np.full(len(y), np.nan))


class LastValue:
    """Repeat the last training value."""

    @staticmethod
    def fit(y, params) -> Fit:
        return Fit(np.array([1.0]), y[-1:], np.concatenate([[np.nan], y[:-1]]))

    @staticmethod
    def ahead(coef, state, steps, params):
        return np.full(steps, state[-1])

    @staticmethod
    def one_step(coef, state, later, params):
        return np.concatenate([state[-1:], later])[: len(later)]


def lag_gram(z: np.ndarray, width: int, less: np.ndarray | None = None) -> np.ndarray:
    """Products of all pairs of the columns (value, lag 1, ..., lag ``width``) over the rows that have all lags.

    Row 0 is one sum per lag. Each further diagonal step drops the last product and takes up one before the
    first, so the other rows follow from it without any window being laid out. With a vector ``less`` its products
    are taken off, in the same steps.
    """
    n = len(z)
    gram = np.empty((width + 1, width + 1))
    gram[0] = np.correlate(z, z[width:], "valid")[::-1]
    ends = [z[width - 1 :: -1] if width else z[:0], z[n - 1 : n - 1 - width : -1]]
    if less is not None:
        gram[0] -= less[0] * less
        ends += [less[:-1], less[1:]]
    gram[:, 0] = gram[0]
    signed = np.array(ends)
    signed[1::2] *= -1.0
    steps = signed.T @ np.array(ends)
    for i in range(width):
        np.add(gram[i, :-1], steps[i], out=gram[i + 1, 1:])
    return gram


class LinearLags:
    """M1: ordinary least squares of the scaled value on its ``T_X`` predecessors, by the normal equations.

    ``coef`` is mean, population deviation, intercept, weights from the oldest lag on. Directions in which the
    lags do not vary get no weight.
    """

    @staticmethod
    def fit(y, params) -> Fit:
        width = int(params["T_X"])
        if len(y) <= width:
            return unfitted(y)
        mean, scale = y.mean(), y.std() or 1.0
        z = (y - mean) / scale
        n = len(z)
        ends = np.concatenate([[0.0], np.cumsum(z)])
        sums = (ends[n - width :] - ends[: width + 1])[::-1]
        rows = n - width
        centred = lag_gram(z, width, sums / np.sqrt(rows))
        weights = solve_symmetric(centred[1:, 1:], centred[1:, 0])
        intercept = (sums[0] - sums[1:] @ weights) / rows
        fitted = np.full(n, np.nan)
        fitted[width:] = (intercept + np.convolve(z[:-1], weights, mode="valid")) * scale + mean if width else intercept * scale + mean
        return Fit(np.concatenate([[mean, scale, intercept], weights[::-1]]), y[n - width :], fitted)

    @staticmethod
    def ahead(coef, state, steps, params):
        mean, scale, b = coef[0], coef[1], coef[2:]
        lags = list(range(len(b) - 1, 0, -1))
        z = roll_forward((state - mean) / scale, lags, b[1:], np.full(steps, b[0]), steps)
        return z * scale + mean

    @staticmethod
    def one_step(coef, state, later, params):
        mean, scale, b = coef[0], coef[1], coef[2:]
        width = len(b) - 1
        z = (np.concatenate([state, later]) - mean) / scale
        return (b[0] + lagged(z, list(range(width, 0, -1)), width) @ b[1:]) * scale + mean


class Arma:
    """Differenced autoregression with moving-average terms, in two regressions.

    Not registered by name; the product form (``seasonal.py``) starts from the same two regressions.

    A long autoregression gives error estimates; the differenced value is then
    regressed on its own lags and on the lagged errors (Hannan and Rissanen,
    1982). Consistent, though not maximum likelihood. Seasonal and plain lags get
    free coefficients instead of the product form. A constant is fitted only
    without differencing. ``state`` is the recent values, then the recent errors.
    """

    @staticmethod
    def terms(params) -> tuple[list[int], list[int], np.ndarray]:
        """Lags of the value and of the error, and the differencing polynomial."""
        p, d, q = (int(params.get(k, 0)) for k in ("P", "D", "Q"))
        sp, sd, sq = (int(params.get(k, 0)) for k in ("SEASONAL_P", "SEASONAL_D", "SEASONAL_Q"))
        m = int(params.get("M", 1))
        ar = sorted({i + m * j for j in range(sp + 1) for i in range(p + 1)} - {0})
        ma = sorted({i + m * j for j in range(sq + 1) for i in range(q + 1)} - {0})
        return ar, ma, difference_weights(d, sd, m)

    @staticmethod
    def errors_of(w: np.ndarray, longest: int) -> np.ndarray:
        """Residuals of a long autoregression; zero where it does not reach."""
        x = np.column_stack([np.ones(len(w) - longest), lagged(w, list(range(1, longest + 1)), longest)])
        return np.concatenate([np.zeros(longest), w[longest:] - x @ least_squares(x, w[longest:])])

    @staticmethod
    def fit(y, params) -> Fit:
        ar, ma, poly = Arma.terms(params)
        lost = len(poly) - 1
        w = np.convolve(y, poly, mode="valid") if len(y) > lost else np.empty(0)
        begin = reach = max(ar, default=0)
        errors = np.zeros(len(w))
        if ma:
            # The order follows from the parameters alone, so that series of any length share one estimator.
            longest = max(ma[-1], reach) + 4
            if len(w) <= 2 * longest + 1:
                return unfitted(y)
            errors = Arma.errors_of(w, longest)
            begin = max(begin, longest + ma[-1])
        constant = 1.0 if lost == 0 else 0.0
        count = len(ar) + len(ma) + int(constant)
        used = len(w) - begin
        if used <= count + 1:
            return unfitted(y)
        x = np.column_stack([np.full(used, constant), lagged(w, ar, begin), lagged(errors, ma, begin)])
        coef = least_squares(x, w[begin:])
        resid = w[begin:] - x @ coef
        fitted = np.full(len(y), np.nan)
        fitted[lost + begin :] = y[lost + begin :] - resid
        errors[begin:] = resid
        aic = used * np.log(max(resid @ resid / used, 1e-300)) + 2 * (count + 1)
        state = np.concatenate([y[len(y) - lost - reach :], errors[len(w) - max(ma, default=0) :]])
        return Fit(coef, state, fitted, aic)

    @staticmethod
    def ahead(coef, state, steps, params):
        ar, ma, poly = Arma.terms(params)
        size = len(poly) - 1 + max(ar, default=0)
        recent, errors = state[:size], np.concatenate([state[size:], np.zeros(steps)])
        w = np.convolve(recent, poly, mode="valid") if max(ar, default=0) else np.empty(0)
        known = lagged(errors, ma, max(ma, default=0)) if ma else np.zeros((steps, 0))
        drift = coef[0] + known @ coef[1 + len(ar) :]
        change = roll_forward(w, ar, coef[1 : 1 + len(ar)], drift, steps)
        back = [i for i in range(1, len(poly)) if poly[i] != 0.0]
        return roll_forward(recent, back, -poly[back], change, steps)

    one_step = None
