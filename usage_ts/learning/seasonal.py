"""Seasonal ARMA in product form, by conditional least squares (M8, M9).

The differenced value w follows a(B) A(B^m) w = c + b(B) B(B^m) e with one coefficient per plain and per
seasonal term. The errors before the first predictable value count as zero; the squares of the others are
lowered by damped Gauss-Newton steps from a start by two regressions, until the errors are orthogonal to
every derivative. All four parts keep their inverse roots within the unit circle, so neither errors nor
forecasts grow; a series that pulls a part to the border ends there.

``coef`` is the constant (0 where the value is differenced), then the plain autoregressive, seasonal
autoregressive, plain and seasonal moving-average terms. ``state`` is recent values, then recent errors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from usage_ts.learning.lagged import Arma, Fit, unfitted
from usage_ts.learning.solvers import difference_weights, lagged, least_squares, roll_forward, solve_symmetric

#: The errors are orthogonal to a derivative if the cosine between them is below this.
TOLERANCE = 1e-9
#: A step that lowers the sum of squares by a smaller share is no step.
LEAST = 1e-13
#: A part of the start that grows is pulled in to this modulus of its largest inverse root.
INSIDE = 0.95


@dataclass(frozen=True)
class Order:
    """Numbers of terms, period and differences of a model."""

    p: int
    sp: int
    q: int
    sq: int
    m: int
    d: int
    sd: int

    @staticmethod
    def of(params) -> Order:
        names = ("P", "SEASONAL_P", "Q", "SEASONAL_Q", "M", "D", "SEASONAL_D")
        return Order(*(int(params.get(k, 1 if k == "M" else 0)) for k in names))

    @property
    def differences(self) -> np.ndarray:
        return difference_weights(self.d, self.sd, self.m)

    @property
    def reach(self) -> int:
        return self.p + self.m * self.sp

    @property
    def memory(self) -> int:
        return self.q + self.m * self.sq

    @property
    def constant(self) -> bool:
        return self.d + self.sd == 0

    def split(self, coef: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """The constant and the four polynomials, lowest power first, seasonal ones spread to their lags."""
        steps = (1, self.m, 1, self.m)
        return coef[0], [spread(np.append(1.0, s * t), k) for (t, s), k in zip(parts(self, coef), steps, strict=True)]


def spread(poly: np.ndarray, step: int) -> np.ndarray:
    """The polynomial in B^step."""
    out = np.zeros((len(poly) - 1) * step + 1)
    out[::step] = poly
    return out


def reciprocal(poly: np.ndarray, n: int) -> np.ndarray:
    """First ``n`` coefficients of 1 / ``poly``, doubled from step to step."""
    g = np.ones(1)
    while len(g) < n:
        length = min(2 * len(g), n)
        size = 1 << (3 * length).bit_length()
        f = np.fft.rfft(g, size)
        g = np.fft.irfft(f * (2 - np.fft.rfft(poly[:length], size) * f), size)[:length]
    return g


def divided(x: np.ndarray, poly: np.ndarray) -> np.ndarray:
    """Columns of ``x`` divided by ``poly``, with zeros before the first row."""
    n = len(x)
    if not poly[1:].any():
        return x
    size = 1 << (2 * n - 1).bit_length()
    echo = np.fft.rfft(reciprocal(poly, n), size)[:, None]
    return np.fft.irfft(np.fft.rfft(x, size, axis=0) * echo, size, axis=0)[:n]


def inverse_root(terms: np.ndarray) -> float:
    """Largest modulus of the inverse roots of 1 + terms[0] z + ..., 0 without terms."""
    return float(np.max(np.abs(np.roots(np.append(1.0, terms))), initial=0.0))


def errors(w: np.ndarray, order: Order, coef: np.ndarray) -> np.ndarray:
    """Errors of the values that have all lags."""
    c, (ar, sar, ma, sma) = order.split(coef)
    u = np.convolve(w, np.convolve(ar, sar), mode="valid") - c
    return divided(u[:, None], np.convolve(ma, sma))[:, 0]


def derivatives(w: np.ndarray, e: np.ndarray, order: Order, coef: np.ndarray) -> np.ndarray:
    """Derivative of every error by every free coefficient."""
    _, (ar, sar, ma, sma) = order.split(coef)
    used, m = len(e), order.m
    plain, seasonal = np.convolve(w, sar, mode="valid"), np.convolve(w, ar, mode="valid")
    past = [np.concatenate([np.zeros(size), np.convolve(e, poly)[:used]]) for size, poly in ((order.q, sma), (m * order.sq, ma))]
    columns = [np.ones(used)] if order.constant else []
    columns += [plain[order.p - i :][:used] for i in range(1, order.p + 1)]
    columns += [seasonal[m * (order.sp - j) :][:used] for j in range(1, order.sp + 1)]
    columns += [past[0][order.q - i :][:used] for i in range(1, order.q + 1)]
    columns += [past[1][m * (order.sq - j) :][:used] for j in range(1, order.sq + 1)]
    return -divided(np.column_stack(columns), np.convolve(ma, sma)) if columns else np.empty((used, 0))


def start(w: np.ndarray, order: Order) -> np.ndarray | None:
    """Plain and seasonal terms by regression on own lags and on the errors of a long autoregression.

    None if the series is too short for the latter. Its order follows from the parameters alone.
    """
    begin, e = order.reach, np.zeros(len(w))
    if order.memory:
        longest = max(order.memory, order.reach) + 4
        if len(w) <= 2 * longest + 1:
            return None
        e = Arma.errors_of(w, longest)
        begin = max(begin, longest + order.memory)
    if len(w) - begin < 1:
        return None
    lags = [*range(1, order.p + 1), *(order.m * j for j in range(1, order.sp + 1))]
    back = [*range(1, order.q + 1), *(order.m * j for j in range(1, order.sq + 1))]
    ones = np.full(len(w) - begin, float(order.constant))
    coef = least_squares(np.column_stack([ones, lagged(w, lags, begin), lagged(e, back, begin)]), w[begin:])
    for part, sign in parts(order, coef):
        root = inverse_root(sign * part)
        if root >= 1:
            part *= (INSIDE / root) ** np.arange(1, len(part) + 1)
    return coef


def parts(order: Order, coef: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Views of the four groups of terms, with their sign in the polynomial."""
    return list(zip(np.split(coef[1:], np.cumsum([order.p, order.sp, order.q])), (-1, -1, 1, 1), strict=True))


def inside(order: Order, coef: np.ndarray) -> bool:
    return all(inverse_root(sign * part) < 1 for part, sign in parts(order, coef))


def settle(w: np.ndarray, order: Order, coef: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of locally least squares and their errors.

    Ends when the errors are orthogonal to all derivatives, or when no damped step lowers the sum of squares
    by more than its last digits: at the border of the unit circle, or where terms cancel each other.
    """
    free = slice(0 if order.constant else 1, len(coef))
    e, damping = errors(w, order, coef), 0.0
    total = float(e @ e)
    while total > 1e-24 * float(w @ w):
        jac = derivatives(w, e, order, coef)
        norm = np.sqrt(np.sum(jac * jac, axis=0))
        jac = jac / np.where(norm > 0, norm, 1.0)
        slope = jac.T @ e
        if np.max(np.abs(slope), initial=0.0) <= TOLERANCE * np.sqrt(total):
            break
        gram, moved = jac.T @ jac, False
        while not moved and damping < 1e12:
            step = solve_symmetric(gram + damping * np.eye(len(slope)), -slope)
            trial = coef.copy()
            trial[free] += step / np.where(norm > 0, norm, 1.0)
            if inside(order, trial):
                next_e = errors(w, order, trial)
                next_total = float(next_e @ next_e)
                moved = next_total < total * (1 - LEAST)
            damping = max(damping * 10, 1e-4) if not moved else (damping / 10 if damping > 1e-4 else 0.0)
        if not moved:
            break
        coef, e, total = trial, next_e, next_total
    return coef, e


class SeasonalArma:
    @staticmethod
    def fit(y, params) -> Fit:
        order = Order.of(params)
        poly = order.differences
        lost = len(poly) - 1
        w = np.convolve(y, poly, mode="valid") if len(y) > lost else np.empty(0)
        count = order.p + order.sp + order.q + order.sq + int(order.constant)
        used = len(w) - order.reach
        first = start(w, order) if used > count + 1 and np.isfinite(y).all() else None
        if first is None:
            return unfitted(y)
        coef, e = settle(w, order, first)
        fitted = np.full(len(y), np.nan)
        fitted[len(y) - used :] = y[len(y) - used :] - e
        aic = used * np.log(max(e @ e / used, 1e-300)) + 2 * (count + 1)
        recent = np.concatenate([np.zeros(order.memory), e])[used:]
        return Fit(coef, np.concatenate([y[len(y) - lost - order.reach :], recent]), fitted, aic)

    @staticmethod
    def ahead(coef, state, steps, params):
        order = Order.of(params)
        c, (ar, sar, ma, sma) = order.split(np.asarray(coef))
        poly, auto, mean = order.differences, np.convolve(ar, sar), np.convolve(ma, sma)
        size = len(poly) - 1 + order.reach
        recent, known = state[:size], np.concatenate([state[size:], np.zeros(steps)])
        # Errors to come are zero; the last known ones reach in as far as the moving average does.
        drift = c + np.convolve(known, mean, mode="valid")
        whole = np.convolve(auto, poly)
        back = list(np.flatnonzero(whole[1:]) + 1)
        return roll_forward(recent, back, -whole[back], drift, steps)

    one_step = None
