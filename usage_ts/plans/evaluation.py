"""Registered queries: forecast evaluation, folds and leaderboard with simple forecasts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from usage_ts.learning import search
from usage_ts.operators import evaluation, series
from usage_ts.plans.timeseries import class_series
from usage_ts.plans.views import SERIES

SEASON = 7
TEST_ROWS = 183
ROUNDED = [*evaluation.METRICS]
W = "OVER (PARTITION BY series_key ORDER BY ds)"


def _round(df, cols, places=6):
    return df.withColumns({c: F.round(c, places) for c in cols})


def _split(spark, sf):
    return series.split_fixed(class_series(spark, sf), TEST_ROWS)


def forecast_eval_join(spark, sf):
    split = _split(spark, sf)
    by_day = Window.partitionBy("series_key").orderBy("ds")
    predicted = class_series(spark, sf).select("series_key", "ds", F.lag("y", SEASON).over(by_day).alias("yhat"))
    return evaluation.evaluate_by_date(split, predicted)


def naive_evaluation(spark, sf):
    """Fitted: the value a week before. Forecast: the last training week, repeated."""
    split = _split(spark, sf)
    is_train = F.col("role") == "train"
    by_day = Window.partitionBy("series_key").orderBy("ds")
    train = split.filter(is_train).select(
        "series_key", "ds", F.col("y").alias("gt"), F.lag("y", SEASON).over(by_day).alias("model")
    )
    week = series.recent_window(split.filter(is_train), SEASON)
    ahead = week.select(
        "series_key", F.col("ds").alias("_last"), "window", F.explode(F.sequence(F.lit(0), F.lit(TEST_ROWS - 1))).alias("_h")
    ).select(
        "series_key",
        F.date_add("_last", F.col("_h") + 1).alias("ds"),
        F.get("window", F.col("_h") % SEASON).alias("forecast"),
    )
    test = split.filter(~is_train).select("series_key", "ds", F.col("y").alias("gt"))
    return evaluation.evaluation_rows(train, evaluation.attach_by_position(test, ahead))


def seasonal_naive_eval(spark, sf):
    return naive_evaluation(spark, sf)


def forecast_metrics(spark, sf):
    return _round(evaluation.forecast_metrics(naive_evaluation(spark, sf)), ROUNDED)


def forecast_bands(spark, sf):
    bands = evaluation.forecast_bands(naive_evaluation(spark, sf))
    cols = ["residuals", "error", "error_pct", "conf_int_low", "conf_int_up", "pred_int_low", "pred_int_up"]
    return _round(bands, cols)


def fold_metrics(spark, sf):
    """Last training value of the fold as forecast, the day before as fitted value."""
    folds = series.cv_folds(class_series(spark, sf), 10, 5)
    fold = Window.partitionBy("series_key", "fold")
    is_train = F.col("role") == "train"
    last = F.max_by(F.when(is_train, F.col("y")), F.when(is_train, F.col("ds"))).over(fold)
    rows = folds.select(
        "series_key",
        "fold",
        "ds",
        F.col("y").alias("gt"),
        F.when(is_train, F.lag("y", 1).over(fold.orderBy("ds"))).alias("model"),
        F.when(~is_train, last).alias("forecast"),
    )
    return evaluation.forecast_metrics(rows, ["series_key", "fold"])


def cv_naive(spark, sf):
    return _round(fold_metrics(spark, sf), ROUNDED)


def cv_summary(spark, sf):
    return _round(evaluation.fold_summary(fold_metrics(spark, sf)), ROUNDED)


def model_leaderboard(spark, sf):
    split = _split(spark, sf)
    of = Window.partitionBy("series_key")
    is_train = F.col("role") == "train"

    def constant(value):
        return split.select(
            "series_key", "ds", F.col("y").alias("gt"),
            F.when(is_train, value).alias("model"), F.when(~is_train, value).alias("forecast"),
        )

    tables = {
        "mean": constant(F.avg(F.when(is_train, F.col("y"))).over(of)),
        "last": constant(F.max_by(F.when(is_train, F.col("y")), F.when(is_train, F.col("ds"))).over(of)),
        "week": naive_evaluation(spark, sf),
    }
    return _round(search.leaderboard(tables), ROUNDED)


def metrics_sql(source: str, by: str) -> str:
    """The eight metrics over a relation with gt, model, forecast."""
    err = "(gt - forecast)"
    return f"""SELECT {by}, round(avg(gt - model), 6) AS residuals_mean, round(stddev_samp(gt - model), 6) AS residuals_std,
  round(avg({err}), 6) AS error_mean, round(stddev_samp({err}), 6) AS error_std, round(avg(abs({err})), 6) AS "MAE",
  round(avg(abs({err} / nullif(gt, 0))), 6) AS "MAPE", round(avg({err} * {err}), 6) AS "MSE",
  round(sqrt(avg({err} * {err})), 6) AS "RMSE", count(*) FILTER (WHERE forecast IS NOT NULL AND gt = 0) AS zero_actuals
FROM {source} GROUP BY {by}"""


NAIVE = f"""{SERIES},
naive AS (SELECT a.series_key, a.ds, a.y AS gt, CASE WHEN a.rn <= a.n - {TEST_ROWS} THEN b.y END AS model, c.y AS forecast
  FROM series a LEFT JOIN series b ON a.series_key = b.series_key AND b.rn = a.rn - {SEASON}
  LEFT JOIN series c ON a.series_key = c.series_key AND a.rn > a.n - {TEST_ROWS}
    AND c.rn = a.n - {TEST_ROWS} - {SEASON} + 1 + (a.rn - (a.n - {TEST_ROWS}) - 1) % {SEASON})"""

FOLDS = f"""{SERIES},
f AS (SELECT *, n // 11 AS b, CAST(unnest(range(6, 11)) AS INTEGER) AS fold FROM series),
g AS (SELECT *, n - (11 - fold) * b AS cut FROM f WHERE rn <= n - (11 - fold) * b + b),
folds AS (SELECT series_key, fold, ds, y AS gt, rn, cut,
  CASE WHEN rn <= cut THEN lag(y) OVER (PARTITION BY series_key, fold ORDER BY ds) END AS model,
  CASE WHEN rn > cut THEN max(CASE WHEN rn = cut THEN y END) OVER (PARTITION BY series_key, fold) END AS forecast FROM g)"""


def _summary_sql():
    names = [f'"{m}"' for m in evaluation.METRICS]
    raw = metrics_sql("folds", "series_key, fold").replace("round(", "(").replace(", 6)", ")")
    rows = ", ".join(f"round({n}, 6) AS {n}" for n in names)
    mean = ", ".join(f"round(avg({n}), 6) AS {n}" for n in names)
    std = ", ".join(f"round(stddev_samp({n}), 6) AS {n}" for n in names)
    return f"""WITH {FOLDS}, m AS ({raw})
SELECT series_key, CAST(fold AS VARCHAR) AS fold, {rows} FROM m
UNION ALL SELECT series_key, 'mean', {mean} FROM m GROUP BY series_key
UNION ALL SELECT series_key, 'std', {std} FROM m GROUP BY series_key"""


QUERIES = {
    "forecast_eval_join": forecast_eval_join,
    "seasonal_naive_eval": seasonal_naive_eval,
    "forecast_metrics": forecast_metrics,
    "forecast_bands": forecast_bands,
    "cv_naive": cv_naive,
    "cv_summary": cv_summary,
    "model_leaderboard": model_leaderboard,
}

ORACLES = {
    "forecast_eval_join": f"""WITH {SERIES}, p AS (SELECT *, lag(y, {SEASON}) {W} AS yhat FROM series)
SELECT series_key, ds, y AS gt, CASE WHEN rn <= n - {TEST_ROWS} THEN yhat END AS model,
       CASE WHEN rn > n - {TEST_ROWS} THEN yhat END AS forecast FROM p""",
    "seasonal_naive_eval": f"WITH {NAIVE} SELECT * FROM naive",
    "forecast_metrics": f"WITH {NAIVE} {metrics_sql('naive', 'series_key')}",
    "forecast_bands": f"""WITH {NAIVE},
s AS (SELECT series_key, 1.96 * stddev_samp(gt - model) AS r, 1.96 * stddev_samp(gt - forecast) AS e FROM naive GROUP BY 1)
SELECT naive.*, round(gt - model, 6) AS residuals, round(gt - forecast, 6) AS error,
       round((gt - forecast) / nullif(gt, 0), 6) AS error_pct, round(forecast - r, 6) AS conf_int_low,
       round(forecast + r, 6) AS conf_int_up, round(forecast - e, 6) AS pred_int_low, round(forecast + e, 6) AS pred_int_up
FROM naive JOIN s USING (series_key)""",
    "cv_naive": f"WITH {FOLDS} {metrics_sql('folds', 'series_key, fold')}",
    "cv_summary": _summary_sql(),
    "model_leaderboard": f"""WITH {NAIVE},
t AS (SELECT series_key, avg(y) AS m, max_by(y, ds) AS l FROM series WHERE rn <= n - {TEST_ROWS} GROUP BY series_key),
c AS (SELECT series_key, rn <= n - {TEST_ROWS} AS tr, y, unnest(['mean', 'last']) AS model_name FROM series),
u AS (SELECT series_key, model_name, y AS gt, CASE WHEN tr THEN v END AS model, CASE WHEN NOT tr THEN v END AS forecast
      FROM (SELECT c.*, CASE WHEN model_name = 'mean' THEN m ELSE l END AS v FROM c JOIN t USING (series_key))
      UNION ALL SELECT series_key, 'week', gt, model, forecast FROM naive)
{metrics_sql('u', 'series_key, model_name')}""",
}
