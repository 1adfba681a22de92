"""All autoregressive orders of a series from one pass over its autocovariances.

The recursion of Levinson and Durbin extends the coefficients of one order to those of the next with a sum
over the autocovariances, so thirty orders cost hardly more than one fit, and no series is copied per order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usage_ts.learning.forecasters import Forecaster, register
from usage_ts.learning.lagged import Fit, unfitted
from usage_ts.learning.solvers import roll_forward

KEYS = ("series_key",)
NAME = "autoregression"


def autocovariances(y: np.ndarray, lags: int) -> np.ndarray:
    """Mean products of deviations at distance 0 to ``lags``, all divided by the number of values."""
    c = y - y.mean()
    return np.array([c[k:] @ c[: len(c) - k] for k in range(lags + 1)]) / len(c)


def levinson(r: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """Coefficients and error variance of every order from 0 to ``len(r) - 1``; ends where nothing is left to explain."""
    phi, variance = np.zeros(0), float(r[0])
    yield phi, variance
    for m in range(len(r) - 1):
        if variance <= 1e-12 * r[0] or r[0] <= 0:
            return
        k = (r[m + 1] - phi @ r[m:0:-1]) / variance
        phi = np.append(phi - k * phi[::-1], k)
        variance *= 1 - k * k
        yield phi, variance


def orders(y: np.ndarray, most: int) -> list[tuple[int, float, float, np.ndarray]]:
    """(order, variance, AIC, coefficients) of every order that the series allows."""
    n, found = len(y), []
    for phi, variance in levinson(autocovariances(y, min(most, n - 1))):
        aic = n * np.log(variance) + 2 * (len(phi) + 1) if variance > 0 else float("nan")
        found.append((len(phi), variance, aic, phi))
    return found


def all_orders(
    df: DataFrame, most: int = 30, by: Sequence[str] = KEYS, ds: str = "ds", value: str = "y"
) -> DataFrame:
    """(``by``, order, n_rows, variance, aic, coef) of the orders 0 to ``most`` of each series.

    Null values are passed over. A constant series has order 0 alone, without an AIC.
    """
    keys = list(by)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values(ds)[value].to_numpy(dtype=float)
        rows = orders(y, most)
        out = pdf.iloc[[0] * len(rows)][keys].reset_index(drop=True)
        out["order"], out["n_rows"] = [r[0] for r in rows], len(y)
        out["variance"], out["aic"] = [r[1] for r in rows], [r[2] for r in rows]
        out["coef"] = [r[3] for r in rows]
        return out

    fields = [T.StructField("order", T.IntegerType()), T.StructField("n_rows", T.LongType())]
    fields += [T.StructField(c, T.DoubleType()) for c in ("variance", "aic")]
    fields += [T.StructField("coef", T.ArrayType(T.DoubleType()))]
    schema = T.StructType([df.schema[k] for k in keys] + fields)
    rows = df.filter(F.col(value).isNotNull()).select(*keys, ds, F.col(value).cast("double").alias(value))
    found = rows.groupBy(*keys).applyInPandas(one, schema)
    return found.withColumn("aic", F.when(~F.isnan("aic"), F.col("aic")))


def best_order(fits: DataFrame, by: Sequence[str] = KEYS, decimals: int = 9) -> DataFrame:
    """The order of least AIC of each series; AICs equal to ``decimals`` places tie and the lower order wins."""
    rank = Window.partitionBy(*by).orderBy(F.round("aic", decimals).asc_nulls_last(), "order")
    return fits.withColumn("_rank", F.row_number().over(rank)).filter("_rank = 1").drop("_rank")


class Autoregression:
    """The order of least AIC among 0 to ``MAX_ORDER``; ``coef`` is the mean, then the weights from lag 1 on."""

    @staticmethod
    def fit(y, params) -> Fit:
        if len(y) < 2 or not np.isfinite(y).all():
            return unfitted(y)
        found = orders(y, int(params["MAX_ORDER"]))
        _, _, aic, phi = min(found, key=lambda r: (round(r[2], 9) if r[2] == r[2] else np.inf, r[0]))
        p, mean = len(phi), y.mean()
        fitted = np.full(len(y), np.nan)
        fitted[p:] = mean + (np.convolve(y[:-1] - mean, phi, mode="valid") if p else 0.0)
        return Fit(np.append(mean, phi), y[len(y) - p :], fitted, aic)

    @staticmethod
    def ahead(coef, state, steps, params):
        lags = list(range(1, len(coef)))
        return coef[0] + roll_forward(state - coef[0], lags, coef[1:], np.zeros(steps), steps)

    @staticmethod
    def one_step(coef, state, later, params):
        p, mean = len(coef) - 1, coef[0]
        if not p:
            return np.full(len(later), mean)
        known = np.concatenate([state, later])[:-1] - mean
        return mean + np.convolve(known, coef[1:], mode="valid")


register(Forecaster(NAME, Autoregression, {"MAX_ORDER": 30}))
