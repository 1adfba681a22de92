"""Small numeric helpers that run inside a task on one series at a time.

A series has one value per day, so its length is bounded by the calendar.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np


def least_squares(x: np.ndarray, y: np.ndarray, penalty: np.ndarray | None = None) -> np.ndarray:
    """Coefficients minimising |y - xb|^2 + sum(penalty * b^2), for each column of ``y``; minimum norm if underdetermined."""
    if penalty is not None and np.any(penalty > 0):
        x = np.vstack([x, np.diag(np.sqrt(penalty))])
        y = np.concatenate([y, np.zeros((len(penalty), *y.shape[1:]))])
    return np.linalg.lstsq(x, y, rcond=None)[0]


def solve_symmetric(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solution of smallest norm of a positive semidefinite system, for each column of ``b``; directions below rounding are left out."""
    if not len(b):
        return np.zeros(b.shape)
    direct = _sound_solution(a, b)
    if direct is not None:
        return direct
    values, vectors = np.linalg.eigh(a)
    kept = values > max(values[-1], 0.0) * len(b) * 1e-14
    return vectors[:, kept] @ ((vectors[:, kept].T @ b).T / values[kept]).T


#: Random right sides that show how large the inverse of a matrix is, and the share of it they may miss.
PROBES, MISSED = 8, 1e-2


@lru_cache(maxsize=8)
def _probes(size: int) -> np.ndarray:
    return np.random.default_rng(0).standard_normal((size, PROBES))


def _sound_solution(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """Solution by elimination if all directions of ``a`` are above rounding, a tenth of the work of its eigenvectors; else none."""
    right = b.reshape(len(b), -1)
    try:
        x = np.linalg.solve(a, np.column_stack([right, _probes(len(a))]))
    except np.linalg.LinAlgError:
        return None
    inverse = np.sqrt((x[:, right.shape[1] :] ** 2).sum(axis=0)).max()
    # The norm bounds the largest value from above, so no direction is kept here that the rule below leaves out.
    sound = np.linalg.norm(a) * inverse * len(a) * 1e-14 < MISSED
    return x[:, : right.shape[1]].reshape(b.shape) if sound else None


def lagged(values: np.ndarray, lags: list[int], start: int) -> np.ndarray:
    """Matrix whose column j holds ``values`` shifted by ``lags[j]``, rows from ``start`` on."""
    n = len(values)
    if not lags:
        return np.empty((n - start, 0))
    return np.column_stack([values[start - k : n - k] for k in lags])


def roll_forward(
    history: np.ndarray, lags: list[int], weights: np.ndarray, drift: np.ndarray, steps: int
) -> np.ndarray:
    """x[t] = drift[t] + sum(weights * x[t - lag]), fed back ``steps`` times after ``history``."""
    n = len(history)
    x = np.concatenate([history, np.empty(steps)])
    back = np.asarray(lags, dtype=int)
    for t in range(n, n + steps):
        x[t] = drift[t - n] + weights @ x[t - back]
    return x[n:]


def difference_weights(d: int, seasonal_d: int, m: int) -> np.ndarray:
    """Coefficients of (1 - B)^d (1 - B^m)^D, lowest power first."""
    poly = np.array([1.0])
    for _ in range(d):
        poly = np.convolve(poly, [1.0, -1.0])
    seasonal = np.zeros(m + 1)
    seasonal[0], seasonal[m] = 1.0, -1.0
    for _ in range(seasonal_d):
        poly = np.convolve(poly, seasonal)
    return poly
