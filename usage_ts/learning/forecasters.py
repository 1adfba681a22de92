"""Pluggable forecasters, run over a table of series in one job.

A forecaster is a function of one series, registered by name. Groups are
(series) or (series, fold, trial); each holds at most one row per day, and
Spark spreads the groups over the cluster. Copies of a series for folds and
trials cost a few bytes per day, far less than the fit they feed, and let all
fits run at the same time.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usage_ts.learning import lagged, seasonal

KEYS = ("series_key",)
PARAMS = "params"
#: What an evaluation table says of each day.
SCORED = ("model", "forecast", "test_pred")
#: Days that a batch of series holds as arrays before it is handed on.
PACKED_DAYS = 500_000


@dataclass(frozen=True)
class Forecaster:
    """``method`` offers fit, ahead and one_step on one series; ``defaults`` are its hyperparameters.

    A model that works on whole tables gives ``evaluate``, ``fit_models`` and
    ``forecast`` instead.
    """

    name: str
    method: object = None
    defaults: Mapping[str, object] = field(default_factory=dict)
    evaluate: Callable | None = None
    fit_models: Callable | None = None
    forecast: Callable | None = None


REGISTRY: dict[str, Forecaster] = {}


def register(forecaster: Forecaster) -> Forecaster:
    REGISTRY[forecaster.name] = forecaster
    return forecaster


# The default orders and window width of each model.
register(Forecaster("last_value", lagged.LastValue))
register(Forecaster("linear_regression", lagged.LinearLags, {"T_X": 300}))
register(Forecaster("arima", seasonal.SeasonalArma, {"P": 7, "D": 1, "Q": 30}))
register(
    Forecaster(
        "sarimax",
        seasonal.SeasonalArma,
        {"P": 7, "D": 1, "Q": 0, "SEASONAL_P": 1, "SEASONAL_D": 1, "SEASONAL_Q": 0, "M": 365},
    )
)


def resolve(model: str | Forecaster) -> Forecaster:
    return model if isinstance(model, Forecaster) else REGISTRY[model]


def params_json(model: str | Forecaster, params: Mapping[str, object] | None = None) -> str:
    """Hyperparameters as JSON; given values override the configured ones."""
    return json.dumps({**resolve(model).defaults, **(params or {})}, sort_keys=True)


def with_params(df: DataFrame, model: str | Forecaster, params: Mapping[str, object] | None = None) -> DataFrame:
    """Add the hyperparameters as one JSON column."""
    return df.withColumn(PARAMS, F.lit(params_json(model, params)))


def _doubles(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.DoubleType()) for n in names]


def _schema(df: DataFrame, cols: Sequence[str], extra: Sequence[T.StructField]) -> T.StructType:
    return T.StructType([df.schema[c] for c in cols] + list(extra))


def _nan_to_null(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in cols})


def _scored(method, y: np.ndarray, train: np.ndarray, params: Mapping[str, object]) -> dict[str, np.ndarray]:
    """The columns ``SCORED`` of one series whose rows of ``train`` are fitted."""
    out = {c: np.full(len(y), np.nan) for c in SCORED}
    if train.any():
        fit = method.fit(y[train], params)
        out["model"][train] = fit.fitted
        if len(fit.coef) and not train.all():
            out["forecast"][~train] = method.ahead(fit.coef, fit.state, int((~train).sum()), params)
            if method.one_step:
                out["test_pred"][~train] = method.one_step(fit.coef, fit.state, y[~train], params)
    return out


def evaluate(
    df: DataFrame,
    model: str | Forecaster,
    by: Sequence[str] = KEYS,
    ds: str = "ds",
    value: str = "y",
    until: str | None = None,
) -> DataFrame:
    """Fit on the ``train`` rows of each group and predict its ``test`` rows.

    Needs columns ``role`` and ``params`` (see :func:`with_params`); returns an
    evaluation table with ``test_pred``. With ``until`` a row of ``df`` stands for
    every day from ``ds`` to that one, and the result has one row per group with
    an array of its days in each column: days are laid out in the task that fits
    them alone, so they are neither sorted nor shuffled.
    """
    keys = list(by)
    if resolve(model).evaluate:
        if until:
            raise ValueError(f"{resolve(model).name!r} works on whole tables, give it single days")
        return resolve(model).evaluate(df, keys, ds, value)
    method = resolve(model).method
    if until:
        return _evaluate_packed(df, method, keys, ds, value, until)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ds)
        y = pdf[value].to_numpy(dtype=float)
        scored = _scored(method, y, pdf["role"].to_numpy(dtype=bool), json.loads(pdf[PARAMS].iloc[0]))
        return pdf[[*keys, ds]].assign(gt=y, **scored)

    rows = (
        df.select(*keys, ds, F.col(value).cast("double").alias(value), F.col("role").eqNullSafe("train").alias("role"), PARAMS)
        .groupBy(*keys)
        .applyInPandas(one, _schema(df, [*keys, ds], _doubles("gt", *SCORED)))
    )
    return _nan_to_null(rows, *SCORED)


def _evaluate_packed(df: DataFrame, method, keys: Sequence[str], ds: str, value: str, until: str) -> DataFrame:
    run = F.struct(
        F.col(ds).alias("first"), F.col(until).alias("last"),
        F.col(value).cast("double").alias("y"), F.col("role").eqNullSafe("train").alias("train"),
    )
    series = df.groupBy(*keys).agg(F.min_by(PARAMS, ds).alias(PARAMS), F.array_sort(F.collect_list(run)).alias("_runs"))
    days = T.ArrayType(T.DateType())
    doubles = T.ArrayType(T.DoubleType())
    schema = _schema(df, keys, [T.StructField(ds, days), *(T.StructField(c, doubles) for c in ("gt", *SCORED))])

    def table(batch: pa.RecordBatch, begin: int, parts: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
        ends = np.cumsum([0, *(len(p[ds]) for p in parts)]).astype(np.int32)
        of_keys = [batch.column(i).slice(begin, len(parts)) for i in range(len(keys))]
        lists = []
        for c in (ds, "gt", *SCORED):
            flat = np.concatenate([p[c] for p in parts])
            items = pa.array(flat.astype(np.int32)).cast(pa.date32()) if c == ds else pa.array(flat, from_pandas=True)
            lists.append(pa.ListArray.from_arrays(pa.array(ends), items))
        return pa.RecordBatch.from_arrays([*of_keys, *lists], names=schema.names)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed: dict[str, dict] = {}
        for b in batches:
            runs = b.column(len(keys) + 1)
            at = runs.offsets.to_numpy() - runs.offsets[0].as_py()
            first, last, y, train = runs.flatten().flatten()
            first, last = (d.cast(pa.int32()).to_numpy() for d in (first, last))
            y, train = (v.to_numpy(zero_copy_only=False) for v in (y, train))
            begin, held, parts = 0, 0, []
            for i, text in enumerate(b.column(len(keys)).to_pylist()):
                own = slice(at[i], at[i + 1])
                lasting = last[own] - first[own] + 1
                ends = np.cumsum(lasting)
                day = np.arange(ends[-1]) + np.repeat(first[own] - ends + lasting, lasting)
                gt = np.repeat(y[own], lasting)
                if text not in parsed:
                    parsed[text] = json.loads(text)
                parts.append({ds: day, "gt": gt} | _scored(method, gt, np.repeat(train[own], lasting), parsed[text]))
                held += len(gt)
                if held > PACKED_DAYS:
                    yield table(b, begin, parts)
                    begin, held, parts = i + 1, 0, []
            if parts:
                yield table(b, begin, parts)

    return series.select(*keys, PARAMS, "_runs").mapInArrow(fit, schema)


def fit_models(
    df: DataFrame, model: str | Forecaster, by: Sequence[str] = KEYS, ds: str = "ds", value: str = "y"
) -> DataFrame:
    """Fit every group on all its rows; one row per group is the saved model.

    ``coef`` and ``state`` (recent values, recent errors) are all that
    :func:`forecast` needs; a group too short for the model has empty ones.
    """
    keys, name = list(by), resolve(model).name
    if resolve(model).fit_models:
        return resolve(model).fit_models(df, keys, ds, value)
    method = resolve(model).method

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ds)
        fit = method.fit(pdf[value].to_numpy(dtype=float), json.loads(pdf[PARAMS].iloc[0]))
        out = pdf.iloc[[-1]][[*keys, PARAMS, ds]].copy()
        out["model"], out["n_rows"], out["aic"] = name, len(pdf), fit.aic
        out["coef"], out["state"] = [fit.coef], [fit.state]
        return out

    doubles = T.ArrayType(T.DoubleType())
    fields = [
        T.StructField("model", T.StringType()),
        T.StructField("n_rows", T.LongType()),
        *_doubles("aic"),
        T.StructField("coef", doubles),
        T.StructField("state", doubles),
    ]
    rows = (
        df.select(*keys, PARAMS, ds, F.col(value).cast("double").alias(value))
        .groupBy(*keys)
        .applyInPandas(one, _schema(df, [*keys, PARAMS, ds], fields))
    )
    return _nan_to_null(rows, "aic")


def forecast(
    models: DataFrame, days: int, by: Sequence[str] = KEYS, ds: str = "ds", model: str | Forecaster | None = None
) -> DataFrame:
    """(``by``, model, ds, yhat) for the ``days`` dates after the last one of each model row.

    Works row by row on the model table: no shuffle, and no second look at the
    series it was fitted on. ``model`` is needed only for one that works on tables.
    """
    keys = list(by)
    if model is not None and resolve(model).forecast:
        return resolve(model).forecast(models, days, keys, ds)

    methods = {f.name: f.method for f in REGISTRY.values() if f.method}

    def run(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                method, coef = methods[row["model"]], np.asarray(row["coef"])
                params = json.loads(row[PARAMS])
                yhat = method.ahead(coef, np.asarray(row["state"]), days, params) if len(coef) else np.nan
                yield pd.DataFrame({k: row[k] for k in (*keys, "model", ds)} | {"yhat": yhat, "_step": range(1, days + 1)})

    schema = _schema(
        models, [*keys, "model", ds], [*_doubles("yhat"), T.StructField("_step", T.IntegerType())]
    )
    rows = models.select(*keys, "model", ds, PARAMS, "coef", "state").mapInPandas(run, schema)
    return _nan_to_null(rows.withColumn(ds, F.date_add(ds, F.col("_step"))).drop("_step"), "yhat")


def select_order(
    df: DataFrame,
    model: str | Forecaster,
    grid: Sequence[Mapping[str, object]],
    by: Sequence[str] = KEYS,
    ds: str = "ds",
    value: str = "y",
    decimals: int = 9,
) -> DataFrame:
    """Fit every order of the grid to every series at once and keep the least AIC of each.

    AICs equal to ``decimals`` places tie and the earlier order wins. ``fits`` counts the orders that
    could be fitted; a series none fits keeps its row, with nulls and ``fits`` 0.
    """
    trials = F.array(*[F.lit(params_json(model, g)) for g in grid])
    spread = df.select("*", F.posexplode(trials).alias("trial", PARAMS))
    fits = fit_models(spread, model, [*by, "trial"], ds, value)
    order = F.when(F.col("aic").isNotNull(), F.struct(F.round("aic", decimals), "trial"))
    return (
        fits.groupBy(*by)
        .agg(
            F.min_by(F.struct(PARAMS, "aic", "coef"), order).alias("best"),
            F.count("aic").alias("fits"),
        )
        .select(*by, "best.*", "fits")
    )
