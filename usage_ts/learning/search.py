"""Cross-validation, hyperparameter search and model comparison."""

from __future__ import annotations

import math
import random
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usage_ts.learning import forecasters as FC
from usage_ts.operators import evaluation, series
from usage_ts.sources.lineage import shared_folder

KEYS = ("series_key",)


def _every_series(df: DataFrame, found: DataFrame, by: Sequence[str]) -> DataFrame:
    """``found`` with a row of nulls for each series of ``df`` that it lacks."""
    named = found.withColumnsRenamed({b: f"_{b}" for b in by})
    keys = df.select(*by).distinct()
    same = reduce(Column.__and__, [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by])
    return keys.join(named, same, "left").select(*found.columns)


def cross_validate(
    df: DataFrame,
    model: str | FC.Forecaster,
    params: Mapping[str, object] | None = None,
    quantiles: int = 10,
    folds: int | None = 5,
    by: Sequence[str] = KEYS,
    ds: str = "ds",
    value: str = "y",
) -> DataFrame:
    """Metrics per series and fold, all folds of all series fitted in one job.

    A series too short for folds has one row of nulls.
    """
    chained = FC.with_params(series.cv_folds(df, quantiles, folds, by, ds), model, params)
    rows = FC.evaluate(chained, model, [*by, "fold"], ds, value)
    return _every_series(df, evaluation.forecast_metrics(rows, [*by, "fold"]), by)


def sample_trials(space: Mapping[str, Mapping], trials: int, seed: int) -> list[dict]:
    """Seeded draws from typed ranges; a parameter without a range is left at its default.

    Types: ``set`` (choice), ``int_uniform``, ``float_uniform``, ``float_log``.
    """
    rng = random.Random(seed)

    def draw(kind: str, bounds: Sequence):
        if kind == "set":
            return rng.choice(list(bounds))
        if kind == "int_uniform":
            return rng.randint(int(bounds[0]), int(bounds[1]))
        if kind == "float_uniform":
            return rng.uniform(bounds[0], bounds[1])
        if kind == "float_log":
            return math.exp(rng.uniform(math.log(bounds[0]), math.log(bounds[1])))
        raise ValueError(f"unknown range type {kind!r}")

    ranged = {k: v for k, v in space.items() if v.get("RANGE") is not None}
    return [{k: draw(v["TYPE"], v["RANGE"]) for k, v in ranged.items()} for _ in range(trials)]


def search(
    df: DataFrame,
    model: str | FC.Forecaster,
    trials: Sequence[Mapping[str, object]],
    objective: str | Column = "MAPE",
    quantiles: int = 10,
    folds: int | None = 5,
    by: Sequence[str] = KEYS,
    ds: str = "ds",
    value: str = "y",
    decimals: int = 9,
) -> DataFrame:
    """Mean score over the folds of each trial, then a ``Best`` row per series.

    Every (series, trial, fold) is its own group of one job. ``objective`` is a
    metric name or a column over the metrics table; least is best. Scores equal to
    ``decimals`` places tie, and the earlier trial wins, so that the order of
    summation does not pick the winner. A series no trial could score, or too
    short for folds, has a ``Best`` row of nulls.
    """
    options = F.array(*[F.lit(FC.params_json(model, t)) for t in trials])
    chained = series.cv_folds(df, quantiles, folds, by, ds).select(
        "*", F.posexplode(options).alias("trial", FC.PARAMS)
    )
    rows = FC.evaluate(chained, model, [*by, "trial", "fold"], ds, value)
    metrics = evaluation.forecast_metrics(rows, [*by, "trial", "fold"])
    score = F.col(objective) if isinstance(objective, str) else objective
    picked = F.element_at(options, F.col("trial") + 1)
    scores = (
        metrics.groupBy(*by, "trial")
        .agg(F.avg(score).alias("score"))
        .withColumn(FC.PARAMS, picked)
    )
    order = F.when(F.col("score").isNotNull(), F.struct(F.round("score", decimals), "trial"))
    best = (
        scores.groupBy(*by)
        .agg(F.min_by(F.struct("score", FC.PARAMS), order).alias("b"))
        .select(*by, "b.*")
    )
    best = _every_series(df, best, by).select(*by, F.lit("Best").alias("trial"), "score", FC.PARAMS)
    return scores.withColumn("trial", F.col("trial").cast("string")).unionByName(best)


def race(
    df: DataFrame,
    model: str | FC.Forecaster,
    trials: Sequence[Mapping[str, object]],
    objective: str | Column = "MAPE",
    keep: float = 1 / 3,
    quantiles: int = 10,
    folds: int | None = 5,
    by: Sequence[str] = KEYS,
    ds: str = "ds",
    value: str = "y",
    decimals: int = 9,
    folder: str | None = None,
) -> DataFrame:
    """:func:`search` by successive halving, so that hundreds of trials cost a few folds each.

    All trials are scored on the latest fold, which has most rows to learn from. After each fold the best
    ``keep`` of the trials of a series, by their mean score so far, go on to the fold before; a trial without a
    score comes last, and at least one goes on. Live trials are a table in ``folder``, a fold is one job over
    all series. ``keep`` 1 is the full search; below it, a trial nearly equal to the winner of the full search may
    win instead. Equal settings are fitted once, as the earliest of their trials.

    Returns (``by``, trial, score, params, folds): the mean over the folds a trial ran, how many these were,
    and a ``Best`` row per series from the trials that ran all; nulls where nothing could be scored.
    """
    if not 0 < keep <= 1:
        raise ValueError("keep must be above 0 and at most 1")
    spark, keys = df.sparkSession, list(by)
    folder = folder or shared_folder(spark, "race")
    settings: dict[str, int] = {}
    for number, trial in enumerate(trials):
        settings.setdefault(FC.params_json(model, trial), number)
    start = F.array(*[F.struct(F.lit(n).alias("trial"), F.lit(p).alias(FC.PARAMS)) for p, n in settings.items()])
    score = F.col(objective) if isinstance(objective, str) else objective
    chained = series.cv_folds(df, quantiles, folds, by, ds)
    live = df.select(*keys).distinct().withColumn("_live", start)
    first = 1 if folds is None else quantiles - folds + 1
    states = []
    for fold in range(quantiles, first - 1, -1):
        same = reduce(Column.__and__, [chained[k].eqNullSafe(live[k]) for k in keys])
        spread = chained.filter(F.col("fold") == fold).join(live, same).select(*[chained[c] for c in chained.columns], F.inline("_live"))
        metrics = evaluation.forecast_metrics(FC.evaluate(spread, model, [*keys, "trial"], ds, value), [*keys, "trial"])
        fresh = metrics.select(*keys, "trial", score.alias("_score"))
        # A trial that is in the race stays in the table, also where the fold gave it no score.
        entered = live.select(*keys, F.inline("_live")).withColumn("_score", F.lit(None).cast("double"))
        rows = entered.unionByName(fresh.withColumn(FC.PARAMS, F.lit(None).cast("string")))
        if states:
            before = spark.read.parquet(states[-1]).filter("_on").select(*keys, "trial", FC.PARAMS, "_sum", "_n", "_ran")
        else:
            before = entered.select(*keys, "trial", FC.PARAMS, F.lit(0.0).alias("_sum"), F.lit(0).cast("bigint").alias("_n"), F.lit(0).alias("_ran"))
        rows = rows.select(*keys, "trial", FC.PARAMS, F.coalesce("_score", F.lit(0.0)).alias("_sum"), F.col("_score").isNotNull().cast("bigint").alias("_n"), F.lit(0).alias("_ran"))
        total = before.unionByName(rows).groupBy(*keys, "trial").agg(
            F.max(FC.PARAMS).alias(FC.PARAMS), F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n"), (F.max("_ran") + 1).alias("_ran")
        )
        mean = F.round(F.try_divide(F.col("_sum"), F.col("_n")), decimals)
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(mean.asc_nulls_last(), "trial"))
        alive = F.count(F.lit(1)).over(Window.partitionBy(*keys))
        states.append(f"{folder}/fold-{fold}")
        total.withColumn("_on", rank <= F.ceil(alive * F.lit(keep))).write.mode("overwrite").parquet(states[-1])
        on = spark.read.parquet(states[-1]).filter("_on")
        live = on.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("trial", FC.PARAMS))).alias("_live"))
    # What stopped at a fold is final there; what went on is in the next table.
    ended = [spark.read.parquet(path).filter("NOT _on") for path in states[:-1]] + [spark.read.parquet(states[-1])]
    scores = reduce(DataFrame.unionByName, ended).select(
        *keys, "trial", F.try_divide(F.col("_sum"), F.col("_n")).alias("score"), FC.PARAMS, F.col("_ran").alias("folds")
    )
    order = F.when(F.col("score").isNotNull(), F.struct(F.round("score", decimals), "trial"))
    whole = F.col("folds") == quantiles + 1 - first
    best = scores.filter(whole).groupBy(*keys).agg(F.min_by(F.struct("score", FC.PARAMS, "folds"), order).alias("b")).select(*keys, "b.*")
    best = _every_series(df, best, by).select(*keys, F.lit("Best").alias("trial"), "score", FC.PARAMS, "folds")
    return scores.withColumn("trial", F.col("trial").cast("string")).unionByName(best)


def leaderboard(evaluations: Mapping[str, DataFrame], by: Sequence[str] = KEYS) -> DataFrame:
    """Metrics per series and model from one evaluation table of all models."""
    named = [e.drop("test_pred").withColumn("model_name", F.lit(n)) for n, e in evaluations.items()]
    return evaluation.forecast_metrics(reduce(DataFrame.unionByName, named), [*by, "model_name"])


def evaluate_all(
    split: DataFrame,
    models: Mapping[str, Mapping[str, object] | None],
    by: Sequence[str] = KEYS,
    ds: str = "ds",
    value: str = "y",
) -> DataFrame:
    """Fit every listed model on the training rows and compare them on the test rows."""
    return leaderboard(
        {n: FC.evaluate(FC.with_params(split, n, p), n, by, ds, value) for n, p in models.items()}, by
    )


def evaluate_refit_forecast(
    split: DataFrame,
    model: str | FC.Forecaster,
    days: int,
    params: Mapping[str, object] | None = None,
    by: Sequence[str] = KEYS,
    ds: str = "ds",
    value: str = "y",
) -> tuple[DataFrame, DataFrame]:
    """(metrics on the test rows, forecast from a model refitted on all rows)."""
    ready = FC.with_params(split, model, params)
    metrics = evaluation.forecast_metrics(FC.evaluate(ready, model, by, ds, value), by)
    ahead = FC.forecast(FC.fit_models(ready, model, by, ds, value), days, by, ds, model)
    return metrics, ahead

