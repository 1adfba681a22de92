"""Additive model: piecewise linear trend, yearly and weekly seasons, holidays.

Features are Spark columns computed from the date, and scoring and decomposition
are dot products of those columns with the fitted coefficients. Only the
penalised least squares of one series runs in Python.

Changes of the trend have a Laplace prior, so most of them are zero; seasons and
holidays have a Gaussian one (a ridge). The variance of the noise is that of the
model without priors, and the coefficients are the posterior's maximum, not a
sample. Changepoints are evenly spaced in time, not in rows.

A series of one day has no time scale: it keeps a row with null coefficients, and
null parts at every date. Rows without a value are passed over; a series without
any value has no model, and null parts.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usage_ts.functions import calendar
from usage_ts.functions.arrays import dot
from usage_ts.learning.forecasters import KEYS, PARAMS, Forecaster, register
from usage_ts.learning.solvers import least_squares, solve_symmetric
from usage_ts.operators import evaluation, series

NAME = "additive"

# Default prior scales, mode and share of history that holds changepoints.
DEFAULTS = {
    "CHANGEPOINT_PRIOR_SCALE": 0.001,
    "SEASONALITY_PRIOR_SCALE": 0.01,
    "HOLIDAYS_PRIOR_SCALE": 0.01,
    "SEASONALITY_MODE": "additive",
    "CHANGEPOINT_RANGE": 0.8,
}
CHANGEPOINTS = 25
BLOCKS = ("trend", "yearly", "weekly", "holidays")
#: Optimality against the price of a change; its square is the share by which a round has to lower the squares.
TOLERANCE = 1e-6


def _param(name: str) -> Column:
    return F.get_json_object(PARAMS, f"$.{name}")


def design(df: DataFrame, holidays: Sequence[str] = (), ds: str = "ds") -> DataFrame:
    """Feature arrays of each row, one per block; needs ``first_ds``, ``last_ds`` and ``params``."""
    t = calendar.scaled_time(F.col(ds), F.col("first_ds"), F.col("last_ds"))
    reach = _param("CHANGEPOINT_RANGE").cast("double")
    steps = [F.greatest(t - reach * (j / CHANGEPOINTS), F.lit(0.0)) for j in range(1, CHANGEPOINTS + 1)]
    blocks = {"trend": F.array(F.lit(1.0), t, *steps)}
    for name, (period, order) in calendar.SEASONS.items():
        blocks[name] = F.array(*calendar.fourier_pairs(F.col(ds), period, order))
    flags = [F.col(h).cast("double") for h in holidays]
    blocks["holidays"] = F.array(*flags) if flags else F.array().cast("array<double>")
    return df.withColumns({f"x_{b}": c for b, c in blocks.items()})


def with_span(train: DataFrame, by: Sequence[str], ds: str, value: str) -> DataFrame:
    """Add first and last training date and the largest absolute value of each series, within its partition."""
    whole = Window.partitionBy(*by)
    return train.withColumns(
        {
            "first_ds": F.min(ds).over(whole),
            "last_ds": F.max(ds).over(whole),
            "y_scale": F.max(F.abs(value)).over(whole).cast("double"),
        }
    )


def sparse_changes(gram: np.ndarray, product: np.ndarray, price: float) -> np.ndarray:
    """The b of least b'Gb / 2 - b'c + price * sum|b|, exact but for rounding.

    While a zero has a slope above the price, the steepest one gets that sign, and the minimum for the signs at
    hand is gone to; where a coefficient would pass zero on the way, it may stay there. The value falls with
    every move, so no set of signs comes twice and the search ends.
    """

    def value(b):
        return b @ gram @ b / 2 - b @ product + price * np.abs(b).sum()

    b = np.zeros(len(product))
    while True:
        slope = product - gram @ b
        excess = np.where(b == 0, np.abs(slope) - price * (1 + TOLERANCE), 0.0)
        entering = int(np.argmax(excess))
        if excess[entering] <= 0:
            return b
        sign = np.sign(b)
        sign[entering] = np.sign(slope[entering])
        before, settled = value(b), False
        while not settled:
            on = sign != 0
            target = np.zeros(len(b))
            target[on] = solve_symmetric(gram[np.ix_(on, on)], product[on] - price * sign[on])
            passing = np.flatnonzero(b * target < 0)
            points = [target]
            for j in passing:
                stop = b + b[j] / (b[j] - target[j]) * (target - b)
                stop[j] = 0.0
                points.append(stop)
            lowest = min(points, key=value)
            settled = not len(passing) or value(lowest) >= value(b)
            if value(lowest) < value(b):
                b = lowest
            sign = np.sign(b)
        if value(b) >= before:
            return b


def trend_fit(x: np.ndarray, y: np.ndarray, price: float) -> np.ndarray:
    """Offset, slope and changes of least |y - xb|^2 / 2 + price * sum|changes|.

    Offset and slope follow from the changes, which are fitted to what a line leaves.
    """
    line, hinges = x[:, :2], x[:, 2:]
    both = np.column_stack([y, hinges])
    left = both - line @ least_squares(line, both)
    changes = sparse_changes(left[:, 1:].T @ left[:, 1:], left[:, 1:].T @ left[:, 0], price)
    return np.concatenate([least_squares(line, y - hinges @ changes), changes])


def solve(blocks: dict[str, np.ndarray], y: np.ndarray, params: Mapping) -> tuple[dict[str, np.ndarray], float]:
    """Coefficients of each block for one series scaled to [-1, 1], and the variance of its noise.

    Trend and seasons are fitted in turn to the penalised sum of squares, until it stands.
    """
    season = np.hstack([blocks[b] for b in BLOCKS[1:]])
    trend = blocks["trend"]
    priors = {
        "yearly": float(params["SEASONALITY_PRIOR_SCALE"]),
        "weekly": float(params["SEASONALITY_PRIOR_SCALE"]),
        "holidays": float(params["HOLIDAYS_PRIOR_SCALE"]),
    }
    both = np.hstack([trend, season])
    tiny = np.full(both.shape[1], 1e-8)
    noise = np.mean((y - both @ least_squares(both, y, tiny)) ** 2)
    # Noise at rounding level would leave the priors without any say.
    noise = max(noise, 1e-16)
    price = noise / float(params["CHANGEPOINT_PRIOR_SCALE"])
    ridge = noise * np.concatenate([np.full(blocks[b].shape[1], priors[b] ** -2) for b in BLOCKS[1:]])
    multiplicative = params["SEASONALITY_MODE"] == "multiplicative"
    b, last = np.zeros(season.shape[1]), np.inf
    while True:
        effect = season @ b
        if multiplicative:
            a = trend_fit(trend * (1 + effect)[:, None], y, price)
            level = trend @ a
            b = least_squares(season * level[:, None], y - level, ridge)
            rest = y - level * (1 + season @ b)
        else:
            a, b = joint_fit(trend, season, y, price, ridge)
            rest = y - trend @ a - season @ b
        value = (rest @ rest + b @ (ridge * b)) / 2 + price * np.abs(a[2:]).sum()
        if not multiplicative or last - value <= TOLERANCE**2 * value:
            break
        last = value
    out, at = {"trend": a}, 0
    for name in BLOCKS[1:]:
        width = blocks[name].shape[1]
        out[name] = b[at : at + width]
        at += width
    return out, float(noise)


def joint_fit(trend, season, y, price, ridge) -> tuple[np.ndarray, np.ndarray]:
    """Trend and seasons together: everything but the changes is a ridge, and follows from them."""
    smooth = np.hstack([trend[:, :2], season])
    penalty = np.concatenate([np.zeros(2), ridge])
    hinges = trend[:, 2:]
    both = np.column_stack([y, hinges])
    coef = least_squares(smooth, both, penalty)
    left = both - smooth @ coef
    # Products with what the ridge leaves: hinges' (1 - S) (y, hinges), S being its smoother.
    products = hinges.T @ left
    gram = (products[:, 1:] + products[:, 1:].T) / 2
    changes = sparse_changes(gram, products[:, 0], price)
    rest = coef[:, 0] - coef[:, 1:] @ changes
    return np.concatenate([rest[:2], changes]), rest[2:]


def fit(
    train: DataFrame,
    by: Sequence[str] = KEYS,
    holidays: Sequence[str] = (),
    ds: str = "ds",
    value: str = "y",
) -> DataFrame:
    """M5: one row of coefficients per series; ``train`` carries ``params`` and the holiday flags.

    ``noise`` is the variance that the priors are weighed with, in the square of the value's unit.
    """
    keys = list(by)
    ready = design(with_span(train.filter(F.col(value).isNotNull()), keys, ds, value), holidays, ds)
    inputs = [f"x_{b}" for b in BLOCKS]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        params = json.loads(pdf[PARAMS].iloc[0])
        scale = pdf["y_scale"].iloc[0] or 1.0
        out = pdf.iloc[[0]][[*keys, PARAMS, "first_ds", "last_ds"]].copy()
        if out["first_ds"].iloc[0] == out["last_ds"].iloc[0]:
            return out.assign(noise=None, **{f"b_{b}": None for b in BLOCKS})
        blocks = {b: np.stack(pdf[f"x_{b}"].to_numpy()) for b in BLOCKS}
        coef, noise = solve(blocks, pdf[value].to_numpy(dtype=float) / scale, params)
        out["noise"] = noise * scale**2
        for b in BLOCKS:
            out[f"b_{b}"] = [coef[b] * (scale if b == "trend" or params["SEASONALITY_MODE"] == "additive" else 1.0)]
        return out

    doubles = T.ArrayType(T.DoubleType())
    schema = T.StructType(
        [ready.schema[c] for c in (*keys, PARAMS, "first_ds", "last_ds")]
        + [T.StructField("noise", T.DoubleType())]
        + [T.StructField(f"b_{b}", doubles) for b in BLOCKS]
    )
    return (
        ready.select(*keys, PARAMS, "first_ds", "last_ds", "y_scale", F.col(value).cast("double").alias(value), *inputs)
        .groupBy(*keys)
        .applyInPandas(one, schema)
    )


def components(
    dates: DataFrame, models: DataFrame, by: Sequence[str] = KEYS, holidays: Sequence[str] = (), ds: str = "ds"
) -> DataFrame:
    """M6, M7: trend, yearly, weekly, holidays and yhat at the given dates, history or future.

    In multiplicative mode the last three are shares of the trend. A null key is a series like any other.
    """
    found = models.withColumnsRenamed({k: f"_model_{k}" for k in by})
    same = [F.col(k).eqNullSafe(F.col(f"_model_{k}")) for k in by]
    ready = design(dates.drop(PARAMS).join(found, same, "left"), holidays, ds)
    parts = ready.withColumns({b: dot(F.col(f"x_{b}"), F.col(f"b_{b}")) for b in BLOCKS})
    effect = F.col("yearly") + F.col("weekly") + F.col("holidays")
    yhat = F.when(_param("SEASONALITY_MODE") == "multiplicative", F.col("trend") * (1 + effect)).otherwise(
        F.col("trend") + effect
    )
    keep = [c for c in dates.columns if c != PARAMS and c not in holidays]
    return parts.withColumn("yhat", yhat).select(*keep, *BLOCKS, "yhat")


def decompose(
    dates: DataFrame, models: DataFrame, by: Sequence[str] = KEYS, holidays: Sequence[str] = (), ds: str = "ds"
) -> DataFrame:
    """M6 in long form: (``by``, ds, component, value)."""
    wide = components(dates, models, by, holidays, ds)
    return wide.select(
        *by,
        ds,
        F.inline(F.array(*[F.struct(F.lit(b).alias("component"), F.col(b).alias("value")) for b in BLOCKS])),
    )


def seasonality_parameters(models: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """period, order, prior scale, mode and coefficients of each season as a JSON text."""
    rows = [
        F.struct(
            F.lit(name).alias("component"),
            F.to_json(
                F.struct(
                    F.lit(period).alias("period"),
                    F.lit(order).alias("fourier_order"),
                    _param("SEASONALITY_PRIOR_SCALE").cast("double").alias("prior_scale"),
                    _param("SEASONALITY_MODE").alias("mode"),
                    F.col(f"b_{name}").alias("coefficients"),
                )
            ).alias("parameters"),
        )
        for name, (period, order) in calendar.SEASONS.items()
    ]
    return models.select(*by, F.inline(F.array(*rows)))


def with_holidays(
    calendar_table: DataFrame | None, names: Mapping[str, str], df: DataFrame, ds: str = "ds"
) -> DataFrame:
    return series.holiday_flags(df, calendar_table, names, ds) if names else df


def forecaster(calendar_table: DataFrame | None = None, names: Mapping[str, str] | None = None) -> Forecaster:
    """The additive model with a holiday calendar, in the form the searches take."""
    names = dict(names or {})
    flags = list(names.values())

    def evaluate(df, by, ds, value):
        ready = with_holidays(calendar_table, names, df, ds)
        models = fit(ready.filter("role = 'train'"), by, flags, ds, value)
        scored = components(ready, models, by, flags, ds)
        return evaluation.evaluate_by_date(df.drop(PARAMS), scored, by, ds, value).withColumn(
            "test_pred", F.lit(None).cast("double")
        )

    def fit_all(df, by, ds, value):
        return fit(with_holidays(calendar_table, names, df, ds), by, flags, ds, value).withColumn(
            "model", F.lit(NAME)
        )

    def ahead(models, days, by, ds):
        dates = series.future_spine(models.select(*by, F.col("last_ds").alias(ds)), days, False, by, ds)
        scored = components(with_holidays(calendar_table, names, dates, ds), models.drop("model"), by, flags, ds)
        return scored.select(*by, F.lit(NAME).alias("model"), ds, "yhat")

    return Forecaster(NAME, None, DEFAULTS, evaluate, fit_all, ahead)


register(forecaster())
