"""Random forest and pooled regression on lag windows, trained over all series.

One forest serves all series of a table. To forecast, the last windows of all series are a table of states:
a step scores it with the fitted model and moves each window on by its prediction. Some steps share a plan,
then the states are written to a folder, so that neither the plan nor what a lost executor costs grows with
the horizon.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usage_ts.functions.arrays import scaled
from usage_ts.learning.forecasters import PARAMS, Forecaster, register
from usage_ts.operators import series
from usage_ts.sources.lineage import shared_folder
from usage_ts.sources.store import load_ml_model, save_ml_model

KEYS = ("series_key",)
NAME = "random_forest"

# Default number of trees and window width.
TREES = 100
WIDTH = 365

#: ``FEATURES`` is how many lags a split may choose from; ``MAX_BINS`` how many thresholds of a lag it tries.
DEFAULTS = {
    "T_X": WIDTH, "N_ESTIMATORS": TREES, "MAX_DEPTH": 10, "MAX_BINS": 32, "FEATURES": "auto", "BOOTSTRAP": True, "SEED": 0,
}
#: Keys that stand for another model, not for another series of the same one.
APART = ("fold", "trial")
#: Steps of a forecast in one plan.
EVERY = 10


def windows(
    df: DataFrame, stats: DataFrame, width: int, by: Sequence[str] = KEYS, ds: str = "ds", value: str = "y"
) -> DataFrame:
    """Lag windows of scaled values as vectors, with the scaled label."""
    z = series.apply_scale(df, stats, [value], by, "_z")
    return series.lag_windows(z, width, [f"{value}_z"], by, ds).withColumn(
        "features", array_to_vector("window")
    )


def fit_forest(
    windowed: DataFrame,
    label: str = "y_z",
    trees: int = TREES,
    depth: int = 10,
    seed: int = 0,
    bins: int = 32,
    features: str = "auto",
    bootstrap: bool = True,
) -> RandomForestRegressionModel:
    """M2: one forest for all series; the tree building is distributed over the rows."""
    return RandomForestRegressor(
        featuresCol="features",
        labelCol=label,
        numTrees=trees,
        maxDepth=depth,
        maxBins=bins,
        featureSubsetStrategy=features,
        bootstrap=bootstrap,
        seed=seed,
    ).fit(windowed)


def fit_linear(windowed: DataFrame, label: str = "y_z"):
    """M1 pooled: one linear model for all series by the normal equations."""
    return LinearRegression(featuresCol="features", labelCol=label, solver="normal").fit(windowed)


def predictions(
    model, windowed: DataFrame, stats: DataFrame, by: Sequence[str] = KEYS, value: str = "y"
) -> DataFrame:
    """M3: one-step prediction of every window in the unit of the series, as ``yhat``."""
    scored = model.transform(windowed).drop("features", "window")
    back = F.col("prediction") * F.col(f"{value}_scale") + F.col(f"{value}_mean")
    return (
        scored.join(stats, [*by])
        .withColumn("yhat", back)
        .drop("prediction", f"{value}_scale", f"{value}_mean", f"{value}_z")
    )


def walk(model, states: DataFrame, steps: int, folder: str | None = None, every: int = EVERY) -> DataFrame:
    """Predictions of ``steps`` rows after each state, every step scored by ``model.transform``.

    ``states`` has a column ``window``; the result has the other columns, ``step`` from 1 on and
    ``prediction``. States are written to ``folder`` after every ``every`` steps.
    """
    spark = states.sparkSession
    folder = folder or shared_folder(spark, "walk")
    carried = [c for c in states.columns if c != "window"]
    parts = []
    for first in range(0, steps, every):
        now = states.withColumn("path", F.array().cast("array<double>"))
        for _ in range(min(every, steps - first)):
            scored = model.transform(now.withColumn("features", array_to_vector("window")))
            rest = F.slice("window", F.lit(2), F.size("window") - 1)
            now = scored.select(
                *carried,
                F.concat(rest, F.array("prediction")).alias("window"),
                F.concat("path", F.array("prediction")).alias("path"),
            )
        parts.append(f"{folder}/from-{first + 1:07d}")
        now.withColumn("first", F.lit(first)).write.mode("overwrite").parquet(parts[-1])
        states = spark.read.parquet(parts[-1]).select(*carried, "window")
    if not parts:
        return states.select(*carried, F.lit(0).alias("step"), F.lit(0.0).alias("prediction")).limit(0)
    steps_of = spark.read.parquet(*parts).select(*carried, "first", F.posexplode("path").alias("_at", "prediction"))
    return steps_of.select(*carried, (F.col("first") + F.col("_at") + 1).alias("step"), "prediction")


def recursive_forecast(
    model,
    df: DataFrame,
    stats: DataFrame,
    width: int,
    days: int,
    by: Sequence[str] = KEYS,
    ds: str = "ds",
    value: str = "y",
    folder: str | None = None,
) -> DataFrame:
    """M4: predict, roll the window, repeat, for all series at once."""
    keys = list(by)
    mean, scale = F.col(f"{value}_mean"), F.col(f"{value}_scale")
    states = (
        series.recent_window(df, width, [value], by, ds)
        .join(stats, keys)
        .select(*keys, ds, mean.alias("_mean"), scale.alias("_scale"), scaled(F.col("window"), mean, scale).alias("window"))
    )
    return (
        walk(model, states, days, folder)
        .withColumns({ds: F.date_add(ds, F.col("step")), "yhat": F.col("prediction") * F.col("_scale") + F.col("_mean")})
        .select(*keys, ds, "yhat")
    )


def _settings(params: str) -> tuple[int, dict]:
    """Width of the window and the settings of :func:`fit_forest`."""
    p = DEFAULTS | json.loads(params)
    return int(p["T_X"]), {
        "trees": int(p["N_ESTIMATORS"]),
        "depth": int(p["MAX_DEPTH"]),
        "seed": int(p["SEED"]),
        "bins": int(p["MAX_BINS"]),
        "features": str(p["FEATURES"]),
        "bootstrap": bool(p["BOOTSTRAP"]),
    }


def _models_of(df: DataFrame, by: Sequence[str]) -> list[tuple[DataFrame, str]]:
    """The rows of each model, and its settings; as many as there are folds and trials."""
    apart = [k for k in by if k in APART]
    found = []
    for r in df.select(*apart, PARAMS).distinct().collect():
        same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.lit(r[k])) for k in (*apart, PARAMS)])
        found.append((df.filter(same), r[PARAMS]))
    return found


def _train(rows: DataFrame, params: str, by: Sequence[str], ds: str, value: str):
    """(model or None if no series is long enough, scaler of each series)."""
    width, settings = _settings(params)
    stats = series.fit_scale(rows, [value], by)
    ready = windows(rows, stats, width, by, ds, value).filter(F.col(f"{value}_z").isNotNull())
    return (None if ready.isEmpty() else fit_forest(ready, f"{value}_z", **settings)), stats


def _evaluated(rows: DataFrame, params: str, by: Sequence[str], ds: str, value: str) -> DataFrame:
    """Evaluation rows of one model: one-step predictions on both parts, and the forecast of the test rows."""
    keys, width = list(by), _settings(params)[0]
    train = rows.filter("role = 'train'")
    model, stats = _train(train, params, by, ds, value)
    by_day = Window.partitionBy(*keys, "role").orderBy(ds)
    out = rows.select(*keys, ds, "role", F.col(value).alias("gt"), F.row_number().over(by_day).alias("step"))
    if model is None:
        nothing = F.lit(None).cast("double")
        return out.select(*keys, ds, "gt", *[nothing.alias(c) for c in ("model", "forecast", "test_pred")])
    known = predictions(model, windows(rows, stats, width, by, ds, value), stats, by, value).select(*keys, ds, F.col("yhat").alias("known"))
    steps = out.filter("role = 'test'").agg(F.max("step")).first()[0] or 0
    ahead = recursive_forecast(model, train, stats, width, steps, by, ds, value)
    ahead = ahead.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy(ds)).alias("step"), F.col("yhat").alias("forecast"))
    ahead = ahead.withColumn("role", F.lit("test"))
    both = out.join(known, [*keys, ds], "left").join(ahead, [*keys, "role", "step"], "left")
    return both.select(
        *keys,
        ds,
        "gt",
        F.when(F.col("role") == "train", F.col("known")).alias("model"),
        "forecast",
        F.when(F.col("role") == "test", F.col("known")).alias("test_pred"),
    )


def evaluate(df: DataFrame, by: Sequence[str], ds: str, value: str) -> DataFrame:
    """A forest per fold and trial, each over all series."""
    rows = df.select(*by, ds, F.col(value).cast("double").alias(value), "role", PARAMS)
    return reduce(DataFrame.unionByName, [_evaluated(part, params, by, ds, value) for part, params in _models_of(rows, by)])


def fit_models(df: DataFrame, by: Sequence[str], ds: str, value: str, folder: str | None = None) -> DataFrame:
    """Forests saved below ``folder``, and one row per series with its forest's ``path``, scaler and last window.

    A series too short for a window has an empty ``state``.
    """
    keys = list(by)
    folder = folder or shared_folder(df.sparkSession, "forests")
    rows = df.select(*keys, ds, F.col(value).cast("double").alias(value), PARAMS)
    tables = []
    for k, (part, params) in enumerate(_models_of(rows, by)):
        model, stats = _train(part, params, by, ds, value)
        path = None
        if model is not None:
            path = f"{folder}/forest-{k}"
            save_ml_model(model, path)
        tips = series.recent_window(part, _settings(params)[0], [value], by, ds, "state").drop(ds)
        last = part.groupBy(*keys).agg(F.max(ds).alias(ds), F.count(F.lit(1)).alias("n_rows"))
        tables.append(
            last.join(stats, keys)
            .join(tips, keys, "left")
            .select(
                *keys,
                F.lit(params).alias(PARAMS),
                ds,
                F.lit(NAME).alias("model"),
                "n_rows",
                F.lit(None).cast("double").alias("aic"),
                F.array(f"{value}_mean", f"{value}_scale").alias("coef"),
                F.coalesce("state", F.array().cast("array<double>")).alias("state"),
                F.lit(path).cast("string").alias("path"),
            )
        )
    return reduce(DataFrame.unionByName, tables)


def forecast(models: DataFrame, days: int, by: Sequence[str], ds: str) -> DataFrame:
    """The ``days`` dates after the last of each model row; null for a series without a window."""
    keys = list(by)
    able = F.col("path").isNotNull() & (F.size("state") > 0)
    mean, scale = F.get("coef", F.lit(0)), F.get("coef", F.lit(1))
    dated = lambda df, step, yhat: df.select(*keys, F.lit(NAME).alias("model"), F.date_add(ds, step).alias(ds), yhat.alias("yhat"))
    short = models.filter(~able).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(days))))
    parts = [dated(short, F.col("step"), F.lit(None).cast("double"))]
    for r in models.filter(able).select("path").distinct().collect():
        own = models.filter(able & (F.col("path") == r["path"]))
        states = own.select(*keys, ds, mean.alias("_mean"), scale.alias("_scale"), scaled(F.col("state"), mean, scale).alias("window"))
        steps = walk(load_ml_model(RandomForestRegressionModel, r["path"]), states, days)
        parts.append(dated(steps, F.col("step"), F.col("prediction") * F.col("_scale") + F.col("_mean")))
    return reduce(DataFrame.unionByName, parts)


register(Forecaster(NAME, None, DEFAULTS, evaluate, fit_models, forecast))
