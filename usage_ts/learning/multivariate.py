"""Lag regression of several features on the lags of all of them.

Each feature of a day is regressed on the last ``T_X`` days of every feature; a forecast feeds all predicted
features back. The normal equations follow block by block from one product of features per lag with
corrections at the ends, so no window is laid out. A fitted series is one row: scaler, coefficients and last
days of all features. Forecasts step all series of a batch at once.

Defined cases: a row in which any feature is null or not finite is passed over; a series with ``T_X`` rows or
fewer gets empty ``coef`` and ``state`` and null predictions; a feature that does not vary is scaled by one.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usage_ts.learning.forecasters import PARAMS, Forecaster
from usage_ts.learning.solvers import solve_symmetric

KEYS = ("series_key",)
NAME = "linear_features"
#: Series whose forecasts are stepped together.
TOGETHER = 256
_NAMED = "_feature{}"


def block_gram(z: np.ndarray, width: int) -> np.ndarray:
    """Products of the columns (features, features at lag 1, ..., at lag ``width``) over the rows with all lags."""
    n, f = z.shape
    blocks = np.empty((width + 1, width + 1, f, f))
    for k in range(width + 1):
        blocks[0, k] = z[width:].T @ z[width - k : n - k]
    early, late = z[:width][::-1], z[n - width :][::-1]
    for i in range(width):
        # Block (i + 1, j + 1) from block (i, j): the last day leaves, the one before the first joins.
        ends = np.einsum("a,jb->jab", early[i], early[i:]) - np.einsum("a,jb->jab", late[i], late[i:])
        blocks[i + 1, i + 1 :] = blocks[i, i:-1] + ends
    for i in range(1, width + 1):
        for j in range(i):
            blocks[i, j] = blocks[j, i].T
    return blocks.transpose(0, 2, 1, 3).reshape((width + 1) * f, (width + 1) * f)


def windows_of(z: np.ndarray, width: int) -> np.ndarray:
    """Row t holds the features of day t + width - 1, then of the day before, down to day t."""
    n, f = z.shape
    return np.column_stack([z[width - k : n - k + 1] for k in range(1, width + 1)]) if width else np.empty((n + 1, 0))


def fit(y: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(means, scales, coefficients) of the columns of ``y``; None for too short a series.

    Row j of the coefficients is the intercept of feature j, then its weights: all features at lag 1, at lag 2, ...
    """
    n, f = y.shape
    if n <= width:
        return None
    mean, scale = y.mean(axis=0), y.std(axis=0)
    scale[scale == 0] = 1.0
    z = (y - mean) / scale
    rows, gram = n - width, block_gram(z, width)
    ends = np.vstack([np.zeros(f), np.cumsum(z, axis=0)])
    sums = np.concatenate([ends[n - k] - ends[width - k] for k in range(width + 1)])
    centred = gram - np.outer(sums, sums) / rows
    weights = solve_symmetric(centred[f:, f:], centred[f:, :f])
    intercept = (sums[:f] - sums[f:] @ weights) / rows
    return mean, scale, np.column_stack([intercept, weights.T])


def predicted(y: np.ndarray, width: int, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Each row after the first ``width`` predicted from its actual predecessors."""
    mean, scale, coef = model
    x = windows_of((y - mean) / scale, width)[:-1]
    return (coef[:, 0] + x @ coef[:, 1:].T) * scale + mean


def steps_ahead(coef: np.ndarray, recent: np.ndarray, days: int) -> np.ndarray:
    """Scaled features of ``days`` days after ``recent``, for many series at once.

    ``coef``: (series, feature, 1 + feature * width); ``recent``: (series, width, feature), oldest day first.
    """
    m, width, f = recent.shape
    x = recent[:, ::-1].reshape(m, width * f)
    out = np.empty((m, days, f))
    for t in range(days):
        out[:, t] = coef[:, :, 0] + np.matmul(coef[:, :, 1:], x[:, :, None])[:, :, 0]
        x = np.concatenate([out[:, t], x[:, : (width - 1) * f]], axis=1) if width else x
    return out


def _rows(df: DataFrame, features: Sequence[str], others: Sequence[str]) -> DataFrame:
    """Rows whose features are all known and finite, as doubles; numbered, as a name may hold a dot."""
    values = {_NAMED.format(j): F.col(f"`{c}`").cast("double") for j, c in enumerate(features)}
    known = [v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")) for v in values.values()]
    kept = known[0]
    for k in known[1:]:
        kept = kept & k
    return df.filter(kept).select(*others, *[v.alias(c) for c, v in values.items()])


def fit_features(df: DataFrame, features: Sequence[str], by: Sequence[str] = KEYS, ds: str = "ds") -> DataFrame:
    """One row per series of ``df``, which has a column ``params`` with ``T_X``.

    ``coef`` is means, scales, then the coefficients of each feature (see :func:`fit`); ``state`` the last days.
    """
    keys, names = list(by), [_NAMED.format(j) for j in range(len(features))]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ds)
        y, width = pdf[names].to_numpy(float), int(json.loads(pdf[PARAMS].iloc[0])["T_X"])
        model = fit(y, width)
        out = pdf.iloc[[-1]][[*keys, PARAMS, ds]].copy()
        out["model"], out["n_rows"], out["aic"] = NAME, len(pdf), None
        out["coef"] = [np.concatenate([m.ravel() for m in model]) if model else np.empty(0)]
        out["state"] = [y[len(y) - width :].ravel() if model else np.empty(0)]
        return out

    doubles = T.ArrayType(T.DoubleType())
    fields = [T.StructField("model", T.StringType()), T.StructField("n_rows", T.LongType())]
    fields += [T.StructField("aic", T.DoubleType()), T.StructField("coef", doubles), T.StructField("state", doubles)]
    schema = T.StructType([df.schema[c] for c in (*keys, PARAMS, ds)] + fields)
    return _rows(df, features, [*keys, PARAMS, ds]).groupBy(*keys).applyInPandas(one, schema)


def forecast_features(
    models: DataFrame, features: Sequence[str], days: int, by: Sequence[str] = KEYS, ds: str = "ds"
) -> DataFrame:
    """M4: (``by``, ds, features) of the ``days`` dates after the last of each model row; no shuffle."""
    keys, names = list(by), [_NAMED.format(j) for j in range(len(features))]
    f = len(names)

    def together(part: pd.DataFrame) -> pd.DataFrame:
        """Forecasts of rows with coefficients of one length."""
        out = part[[*keys, ds]].loc[part.index.repeat(days)].reset_index(drop=True)
        out["_step"] = np.tile(np.arange(1, days + 1), len(part))
        coef = np.stack(part["coef"].to_list()).astype(float)
        if not coef.shape[1]:
            return out.assign(**{c: np.nan for c in names})
        mean, scale = coef[:, None, :f], coef[:, None, f : 2 * f]
        recent = np.stack(part["state"].to_list()).astype(float).reshape(len(part), -1, f)
        ahead = steps_ahead(coef[:, 2 * f :].reshape(len(part), f, -1), (recent - mean) / scale, days) * scale + mean
        return out.assign(**{c: ahead[:, :, j].ravel() for j, c in enumerate(names)})

    def run(batches):
        for pdf in batches:
            for _, same in pdf.groupby(pdf["coef"].map(len)):
                for at in range(0, len(same), TOGETHER):
                    yield together(same.iloc[at : at + TOGETHER])

    extra = [T.StructField("_step", T.IntegerType())] + [T.StructField(c, T.DoubleType()) for c in names]
    schema = T.StructType([models.schema[c] for c in (*keys, ds)] + extra)
    rows = models.select(*keys, ds, "coef", "state").mapInPandas(run, schema)
    values = [F.when(~F.isnan(n), F.col(n)).alias(c) for n, c in zip(names, features, strict=True)]
    return rows.select(*keys, F.date_add(ds, F.col("_step")).alias(ds), *values)


def evaluate_features(
    df: DataFrame, features: Sequence[str], by: Sequence[str] = KEYS, ds: str = "ds", value: str = "y"
) -> DataFrame:
    """Evaluation rows of the feature ``value``: fitted on ``train`` rows, predicted and forecast on ``test`` rows."""
    keys, names = list(by), [_NAMED.format(j) for j in range(len(features))]
    target, columns = list(features).index(value), ("gt", "model", "forecast", "test_pred")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ds)
        y, width = pdf[names].to_numpy(float), int(json.loads(pdf[PARAMS].iloc[0])["T_X"])
        n = int((pdf["role"] == "train").sum())
        out = pdf[[*keys, ds]].assign(gt=y[:, target], model=np.nan, forecast=np.nan, test_pred=np.nan)
        model = fit(y[:n], width)
        if model is None:
            return out
        known = predicted(y, width, model)[:, target]
        mean, scale, coef = model
        ahead = steps_ahead(coef[None], ((y[n - width : n] - mean) / scale)[None], len(y) - n)[0] * scale + mean
        place = [out.columns.get_loc(c) for c in columns[1:]]
        out.iloc[width:n, place[0]] = known[: n - width]
        out.iloc[n:, place[1]] = ahead[:, target]
        out.iloc[n:, place[2]] = known[n - width :]
        return out

    fields = [T.StructField(c, T.DoubleType()) for c in columns]
    schema = T.StructType([df.schema[c] for c in (*keys, ds)] + fields)
    rows = _rows(df, features, [*keys, ds, "role", PARAMS]).groupBy(*keys).applyInPandas(one, schema)
    return rows.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns[1:]})


def forecaster(features: Sequence[str], width: int = 300) -> Forecaster:
    """The model as a forecaster of the value column, with ``features`` beside it."""
    others = list(features)

    def evaluate(df, by, ds, value):
        return evaluate_features(df, [value, *others], by, ds, value)

    def fit_models(df, by, ds, value):
        return fit_features(df, [value, *others], by, ds)

    def forecast(models, days, by, ds):
        ahead = forecast_features(models, ["_value", *[f"_other{j}" for j in range(len(others))]], days, by, ds)
        return ahead.select(*by, F.lit(NAME).alias("model"), ds, F.col("_value").alias("yhat"))

    return Forecaster(NAME, None, {"T_X": width}, evaluate, fit_models, forecast)
