"""Registered queries: forecasters, cross-validation, search, refit and forecast."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from usage_ts.functions.arrays import dot
from usage_ts.functions import columns as C
from usage_ts.learning import additive, forest, multivariate, orders, search
from usage_ts.learning import forecasters as FC
from usage_ts.operators import evaluation, intervals, series
from usage_ts.plans.evaluation import FOLDS, TEST_ROWS, metrics_sql
from usage_ts.plans.timeseries import HOLIDAY_COLUMNS, class_series, event_series, holiday_calendar
from usage_ts.plans.views import DAYS, DEDUP, SERIES
from usage_ts.sources import testtables

AHEAD = 60
LAGS = 28
LONG_LAGS = 300
TWO_LAGS = {"T_X": 2}
WALK = {"P": 0, "D": 1, "Q": 0}
AR1 = {"P": 1, "D": 1, "Q": 0}
AR2 = {"P": 2, "D": 1, "Q": 0}
MONTHLY = {"P": 7, "D": 1, "Q": 14}
FOREST = {"T_X": LAGS, "N_ESTIMATORS": 20, "MAX_DEPTH": 5}
ONE_SPLIT = {"T_X": 1, "N_ESTIMATORS": 1, "MAX_DEPTH": 1, "MAX_BINS": 256, "BOOTSTRAP": False}


def _split(spark, sf):
    return series.split_fixed(class_series(spark, sf), TEST_ROWS)


def _exploded(models, places=6):
    return models.select("series_key", "model", "n_rows", F.posexplode("coef").alias("pos", "b")).withColumn(
        "b", F.round("b", places) + 0.0
    )


def _round(df, *cols, places=6):
    return df.withColumns({c: F.round(c, places) + 0.0 for c in cols})


def ar1_by_series(spark, sf):
    """One-lag regression per series as plain aggregates."""
    by_day = Window.partitionBy("series_key").orderBy("ds")
    s = class_series(spark, sf).withColumn("x", F.lag("y", 1).over(by_day))
    return s.groupBy("series_key").agg(
        F.round(F.regr_slope("y", "x"), 6).alias("slope"),
        F.round(F.regr_intercept("y", "x"), 4).alias("intercept"),
        F.regr_count("y", "x").alias("n"),
    )


def ols_two_lag_fit(spark, sf):
    s = FC.with_params(class_series(spark, sf), "linear_regression", TWO_LAGS)
    return _exploded(FC.fit_models(s, "linear_regression"), 5)


def ols_lag_fit(spark, sf):
    s = FC.with_params(class_series(spark, sf), "linear_regression", {"T_X": LAGS})
    return _exploded(FC.fit_models(s, "linear_regression"))


def pooled_lag_fit(spark, sf):
    """One linear model for all series on scaled lag windows, scored as a dot product."""
    s = class_series(spark, sf)
    stats = series.fit_scale(s, ["y"])
    windowed = forest.windows(s, stats, LAGS)
    model = forest.fit_linear(windowed)
    weights = F.array(*[F.lit(float(c)) for c in model.coefficients])
    z = dot(F.col("window"), weights) + F.lit(float(model.intercept))
    return windowed.join(stats, "series_key").select(
        "series_key", "ds", "y", (z * F.col("y_scale") + F.col("y_mean")).alias("yhat")
    )


def forest_lag_fit(spark, sf):
    """One forest over all series; its predictions of every window."""
    s = class_series(spark, sf)
    stats = series.fit_scale(s, ["y"])
    windowed = forest.windows(s, stats, LAGS)
    return forest.predictions(forest.fit_forest(windowed, trees=20, depth=5, seed=7), windowed, stats).select("series_key", "ds", "y", "yhat")


def forest_forecast(spark, sf):
    s = FC.with_params(class_series(spark, sf), "random_forest", FOREST)
    return FC.forecast(FC.fit_models(s, "random_forest"), AHEAD, model="random_forest")


def _one_split(spark, sf):
    """A forest of one tree with one split, chosen among all thresholds, on yesterday's value."""
    return FC.with_params(event_series(spark, sf), "random_forest", ONE_SPLIT)


def forest_one_split(spark, sf):
    """With the last seven days held out: one-step predictions of both parts and the forecast of the test rows."""
    ready = series.split_fixed(_one_split(spark, sf), 7)
    return _round(FC.evaluate(ready, "random_forest"), "gt", "model", "forecast", "test_pred", places=4)


def forest_one_split_forecast(spark, sf):
    """Fitted on all rows, saved, loaded and walked forward."""
    ahead = FC.forecast(FC.fit_models(_one_split(spark, sf), "random_forest"), AHEAD, model="random_forest")
    return _round(ahead, "yhat", places=4)


def one_step_predictions(spark, sf):
    ready = FC.with_params(_split(spark, sf), "linear_regression", TWO_LAGS)
    rows = FC.evaluate(ready, "linear_regression")
    return _round(rows.select("series_key", "ds", "gt", "model", "test_pred"), "model", "test_pred", places=4)


def recursive_forecast(spark, sf):
    s = FC.with_params(class_series(spark, sf), "linear_regression", TWO_LAGS)
    ahead = FC.forecast(FC.fit_models(s, "linear_regression"), AHEAD)
    return _round(ahead, "yhat", places=4)


def _additive(spark, sf):
    s = class_series(spark, sf)
    model = additive.forecaster(holiday_calendar(s), HOLIDAY_COLUMNS)
    return s, model


def additive_fit(spark, sf):
    s, model = _additive(spark, sf)
    models = FC.fit_models(FC.with_params(s, model), model)
    blocks = [
        F.struct(F.lit(b).alias("block"), F.col(f"b_{b}").alias("coef")) for b in additive.BLOCKS
    ]
    return models.select("series_key", F.inline(F.array(*blocks))).select(
        "series_key", "block", F.posexplode("coef").alias("pos", "b")
    )


def decompose(spark, sf):
    s, model = _additive(spark, sf)
    models = FC.fit_models(FC.with_params(s, model), model)
    flags = list(HOLIDAY_COLUMNS.values())
    dates = series.holiday_flags(s.select("series_key", "ds"), holiday_calendar(s), HOLIDAY_COLUMNS)
    return additive.decompose(dates.withColumn("params", F.lit(None)), models.drop("model"), holidays=flags)


def additive_forecast(spark, sf):
    s, model = _additive(spark, sf)
    models = FC.fit_models(FC.with_params(s, model), model)
    return FC.forecast(models, AHEAD, model=model)


def _additive_terms(s, calendar, mode):
    """One row per series and coefficient: slope of the squares against it, and the slope that its prior asks for."""
    flags = list(HOLIDAY_COLUMNS.values())
    model = additive.forecaster(calendar, HOLIDAY_COLUMNS)
    priors = {"CHANGEPOINT_PRIOR_SCALE": 0.05, "SEASONALITY_PRIOR_SCALE": 0.1, "HOLIDAYS_PRIOR_SCALE": 0.1}
    models = FC.fit_models(FC.with_params(s, model, {**priors, "SEASONALITY_MODE": mode}), model).drop("model")
    dates = series.holiday_flags(s, calendar, HOLIDAY_COLUMNS)
    rows = additive.design(dates.join(models, "series_key"), flags)
    part = {b: dot(F.col(f"x_{b}"), F.col(f"b_{b}")) for b in additive.BLOCKS}
    rows = rows.withColumns({"level": part["trend"], "effect": part["yearly"] + part["weekly"] + part["holidays"]})
    share = mode == "multiplicative"
    yhat = F.col("level") * (1 + F.col("effect")) if share else F.col("level") + F.col("effect")
    by_level = F.col("level") if share else F.lit(1.0)
    by_effect = 1 + F.col("effect") if share else F.lit(1.0)

    def terms(b):
        factor = by_effect if b == "trend" else by_level
        return F.transform(
            F.arrays_zip(F.col(f"x_{b}").alias("x"), F.col(f"b_{b}").alias("b")),
            lambda z, i: F.struct(F.lit(b).alias("block"), i.alias("pos"), z["b"].alias("b"), (z["x"] * factor).alias("x")),
        )

    long = rows.select("series_key", "y", "noise", (F.col("y") - yhat).alias("r"), F.inline(F.concat(*map(terms, additive.BLOCKS))))
    sums = long.groupBy("series_key", "block", "pos").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.abs("y")).alias("scale"), F.max("noise").alias("noise"), F.max("b").alias("b"),
        F.sum(F.col("r") * F.col("x")).alias("slope"), F.sqrt(F.sum(F.col("r") ** 2) * F.sum(F.col("x") ** 2)).alias("size"),
    )
    price = F.col("noise") / (F.col("scale") * priors["CHANGEPOINT_PRIOR_SCALE"])
    unit = F.lit(1.0) if share else F.col("scale") ** 2
    ridge = F.col("noise") * F.col("b") / (unit * priors["SEASONALITY_PRIOR_SCALE"] ** 2)
    asked = F.when(F.col("block") != "trend", ridge).when(F.col("pos") < 2, 0.0).when(F.col("b") != 0, F.signum("b") * price)
    gap = F.coalesce(F.abs(F.col("slope") - asked), F.greatest(F.abs("slope") - price, F.lit(0.0)))
    return sums.withColumns({"gap": F.coalesce(F.try_divide(gap, F.col("size")), F.lit(0.0)), "mode": F.lit(mode)})


def additive_conditions(spark, sf):
    """Both modes of the additive model on every class: what makes the coefficients the posterior's maximum.

    The slope of the squares is zero against offset and slope of the trend, the ridge's against seasons and
    holidays, the price against a change of the trend that is not zero, and within the price against one that is.
    """
    s = class_series(spark, sf)
    calendar = holiday_calendar(s)
    terms = _additive_terms(s, calendar, "additive").unionByName(_additive_terms(s, calendar, "multiplicative"))
    return terms.groupBy("series_key", "mode").agg(
        F.max("n").alias("n_rows"), F.count(F.lit(1)).alias("n_terms"), (F.round(F.max("gap"), 4) + 0.0).alias("condition")
    )


def additive_trend_forecast(spark, sf):
    """With every prior but the line's near zero the model is a straight line: its forecast has a closed form."""
    s = class_series(spark, sf)
    none = {k: 1e-9 for k in ("CHANGEPOINT_PRIOR_SCALE", "SEASONALITY_PRIOR_SCALE", "HOLIDAYS_PRIOR_SCALE")}
    models = FC.fit_models(FC.with_params(s, "additive", none), "additive")
    return _round(FC.forecast(models, AHEAD, model="additive"), "yhat", places=3)


def additive_evaluate(spark, sf):
    s, model = _additive(spark, sf)
    split = series.split_fixed(s, TEST_ROWS)
    return evaluation.forecast_metrics(FC.evaluate(FC.with_params(split, model), model))


def arma_fit(spark, sf):
    """ARIMA(1,1,0): the one coefficient of each series and its forecast have closed forms."""
    s = FC.with_params(class_series(spark, sf), "arima", AR1)
    models = FC.fit_models(s, "arima")
    ahead = FC.forecast(models, AHEAD)
    coef = models.select("series_key", F.get("coef", F.lit(1)).alias("phi"), "aic")
    return _round(ahead.join(coef, "series_key").drop("model"), "phi", "aic", "yhat", places=5)


def arma_with_errors_fit(spark, sf):
    s = FC.with_params(class_series(spark, sf), "arima", MONTHLY)
    models = FC.fit_models(s, "arima")
    return FC.forecast(models, AHEAD).join(models.select("series_key", "aic", "n_rows"), "series_key")


def seasonal_arma_fit(spark, sf):
    s = FC.with_params(class_series(spark, sf), "sarimax")
    return FC.forecast(FC.fit_models(s, "sarimax"), AHEAD)


def seasonal_arma_annual(spark, sf):
    """One annual lag on annual differences: coefficient and forecast have closed forms."""
    annual = {"P": 0, "D": 0, "Q": 0, "SEASONAL_P": 1, "SEASONAL_D": 1, "SEASONAL_Q": 0, "M": 365}
    models = FC.fit_models(FC.with_params(class_series(spark, sf), "sarimax", annual), "sarimax")
    coef = models.select("series_key", F.get("coef", F.lit(1)).alias("phi"))
    return _round(FC.forecast(models, AHEAD).join(coef, "series_key").drop("model"), "phi", "yhat", places=5)


def _worst(e, columns):
    """Largest absolute cosine between ``e`` and any of the columns, over the rows of the group."""
    size = lambda c: F.sqrt(F.sum(c * c))
    return F.greatest(F.lit(0.0), *[F.abs(F.try_divide(F.sum(e * c), size(e) * size(c))) for c in columns])


def seasonal_arma_conditions(spark, sf):
    """The default seasonal model, (7,1,0)x(1,1,0,365), on every class: what makes it a least-squares fit.

    ``condition`` is the largest cosine of the errors with the derivatives, ``recursion`` the largest error
    that the forecast days leave in the model's equation, as a share of the largest value.
    """
    s = FC.with_params(class_series(spark, sf), "sarimax")
    models = FC.fit_models(s, "sarimax")
    phi, seasonal = [F.get("coef", F.lit(i)) for i in range(1, 8)], F.get("coef", F.lit(8))
    days = s.select("series_key", "ds", "y", F.lit(False).alias("ahead")).unionByName(
        FC.forecast(models, AHEAD).select("series_key", "ds", F.col("yhat").alias("y"), F.lit(True).alias("ahead"))
    )
    w = Window.partitionBy("series_key").orderBy("ds")
    back = lambda c, k: F.lag(c, k).over(w)
    rows = days.join(models.select("series_key", "coef"), "series_key")
    rows = rows.withColumn("w", F.col("y") - back("y", 1) - back("y", 365) + back("y", 366))
    rows = rows.withColumn("plain", F.col("w") - seasonal * back("w", 365))
    rows = rows.withColumn("annual", F.col("w") - sum(phi[i - 1] * back("w", i) for i in range(1, 8)))
    rows = rows.withColumns({f"x{i}": back("plain", i) for i in range(1, 8)} | {"x8": back("annual", 365)})
    rows = rows.withColumn("e", F.col("plain") - sum(phi[i - 1] * F.col(f"x{i}") for i in range(1, 8)))
    past = lambda c: F.when(~F.col("ahead"), F.col(c))
    gap = F.max(F.when(F.col("ahead"), F.abs("e"))) / F.max(F.abs("y"))
    return rows.groupBy("series_key").agg(
        F.count(past("e")).alias("n_errors"),
        (F.round(_worst(past("e"), [past(f"x{i}") for i in range(1, 9)]), 5) + 0.0).alias("condition"),
        (F.round(gap, 7) + 0.0).alias("recursion"),
    )


def arma_error_conditions(spark, sf):
    """(1,1,1) on every class: errors and their derivatives recomputed by the recursion, value after value."""
    s = FC.with_params(class_series(spark, sf), "arima", {"P": 1, "D": 1, "Q": 1})
    models = FC.fit_models(s, "arima")
    by_day = Window.partitionBy("series_key").orderBy("ds")
    changes = s.withColumn("w", F.col("y") - F.lag("y", 1).over(by_day)).filter("w IS NOT NULL")
    lists = changes.groupBy("series_key").agg(F.array_sort(F.collect_list(F.struct("ds", "w")))["w"].alias("w"))
    ahead = FC.forecast(models, 1).select("series_key", "yhat")
    tip = s.groupBy("series_key").agg(F.max_by("y", "ds").alias("tip"))
    zero, phi, theta = F.lit(0.0), F.get("coef", F.lit(1)), F.get("coef", F.lit(2))
    names = ("w", "e", "dp", "dt", "ee", "ep", "et", "pp", "tt")

    def step(acc, w):
        e = w - phi * acc["w"] - theta * acc["e"]
        dp, dt = -acc["w"] - theta * acc["dp"], -acc["e"] - theta * acc["dt"]
        sums = (acc["ee"] + e * e, acc["ep"] + e * dp, acc["et"] + e * dt, acc["pp"] + dp * dp, acc["tt"] + dt * dt)
        return F.struct(*[v.alias(n) for n, v in zip(names, (w, e, dp, dt, *sums), strict=True)])

    first = F.struct(F.get("w", F.lit(0)).alias("w"), *[zero.alias(n) for n in names[1:]])
    rows = lists.join(models.select("series_key", "coef"), "series_key").join(ahead, "series_key").join(tip, "series_key")
    rows = rows.withColumn("end", F.aggregate(F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), first, step))
    cosine = lambda x, xx: F.abs(F.try_divide(F.col(f"end.{x}"), F.sqrt(F.col("end.ee") * F.col(f"end.{xx}"))))
    gap = F.col("yhat") - F.col("tip") - phi * F.col("end.w") - theta * F.col("end.e")
    return rows.select(
        "series_key",
        (F.size("w") - 1).cast("long").alias("n_errors"),
        (F.round(F.greatest(cosine("ep", "pp"), cosine("et", "tt")), 5) + 0.0).alias("condition"),
        (F.round(F.abs(gap / F.col("tip")), 7) + 0.0).alias("recursion"),
    )


def train_simple_models(spark, sf):
    return _round(
        search.evaluate_all(_split(spark, sf), {"last_value": None, "arima": AR1}), *evaluation.METRICS, places=4
    )


def order_search(spark, sf):
    best = FC.select_order(class_series(spark, sf), "arima", [AR1, AR2])
    return _round(
        best.select("series_key", F.get_json_object("params", "$.P").cast("int").alias("p"), "aic", "fits"), "aic", places=4
    )


def all_orders(spark, sf):
    """Every autoregressive order from 0 to 30 of each series: AIC and the coefficient of the longest lag."""
    fits = orders.all_orders(class_series(spark, sf), 30)
    last = F.try_element_at("coef", F.lit(-1))
    rows = fits.select("series_key", "order", "n_rows", "aic", last.alias("last_weight"))
    return _round(rows, "aic", "last_weight", places=5)


def lag_regression_by_account(spark, sf):
    """300 lags on the daily series of every account: what is left correlates with no lag and has mean zero.

    ``condition`` is the largest product sum of the residuals with the constant and with lags 1, 7, 100 and 300,
    as a share of the absolute sum of the values' products with them. The days of an account stay one row of arrays
    between the fit and these sums, so a lag is a place in the array.
    """
    days = intervals.daily_consumption(testtables.billing_dedup(spark, sf, by_account=True), ["account"], spine=True, until="upto")
    s = days.select(F.col("account").alias("series_key"), F.col("d").alias("ds"), "upto", C.plain(F.col("consumption")).alias("y"))
    ready = FC.with_params(s.withColumn("role", F.lit("train")), "linear_regression", {"T_X": LONG_LAGS})
    fitted = FC.evaluate(ready, "linear_regression", until="upto")
    each = fitted.select("series_key", F.col("gt").alias("all"), F.posexplode("model").alias("at", "model"))
    lags = {f"x{k}": F.get("all", F.col("at") - k) for k in (1, 7, 100, LONG_LAGS)}
    rows = each.withColumns({**lags, "x0": F.lit(1.0), "gt": F.get("all", F.col("at"))}).withColumn("e", F.col("gt") - F.col("model"))
    share = lambda x: F.try_divide(F.abs(F.sum(F.col("e") * F.col(x))), F.sum(F.abs(F.when(F.col("e").isNotNull(), F.col("gt")) * F.col(x))))
    worst = F.greatest(*[F.coalesce(share(x), F.lit(0.0)) for x in ("x0", *lags)])
    return rows.groupBy("series_key").agg(
        F.count(F.lit(1)).alias("n_rows"), F.when(F.count("e") > 0, F.round(worst, 5) + 0.0).alias("condition")
    )


def _two_features(spark, sf):
    """Daily consumption and number of active records of each class."""
    days = intervals.daily_consumption(testtables.billing_dedup(spark, sf), ["rate_class"])
    return days.select(
        F.col("rate_class").alias("series_key"), F.col("d").alias("ds"),
        C.plain(F.col("consumption")).alias("y"), F.col("n").cast("double").alias("active"),
    )


def feature_lag_forecast(spark, sf):
    """Two features on yesterday's two features, both fed back over the horizon."""
    s = FC.with_params(_two_features(spark, sf), multivariate.forecaster(["active"]), {"T_X": 1})
    models = multivariate.fit_features(s, ["y", "active"])
    return _round(multivariate.forecast_features(models, ["y", "active"], AHEAD), "y", "active", places=4)


def feature_lag_evaluate(spark, sf):
    """The same with the last half year held out: one-step predictions and the forecast of the test rows."""
    model = multivariate.forecaster(["active"])
    split = series.split_fixed(_two_features(spark, sf), TEST_ROWS)
    rows = FC.evaluate(FC.with_params(split, model, {"T_X": 1}), model)
    return _round(rows, "model", "forecast", "test_pred", places=4)


def cv_evaluate(spark, sf):
    metrics = search.cross_validate(class_series(spark, sf), "arima", AR1)
    return _round(metrics, *evaluation.METRICS, places=4)


def hparam_search(spark, sf):
    trials = search.search(class_series(spark, sf), "arima", [WALK, AR1], "MAE")
    return _round(
        trials.select("series_key", "trial", F.get_json_object("params", "$.P").cast("int").alias("p"), "score"),
        "score",
        places=5,
    )


def hparam_search_lags(spark, sf):
    space = {"T_X": {"TYPE": "int_uniform", "RANGE": [7, 60]}}
    trials = search.sample_trials(space, 4, seed=11)
    return search.search(class_series(spark, sf), "linear_regression", trials)


def hparam_race(spark, sf):
    """The two trials of the search as a race: one of them leaves after the latest fold."""
    rows = search.race(class_series(spark, sf), "arima", [WALK, AR1], "MAE", keep=0.5)
    p = F.get_json_object("params", "$.P").cast("int")
    return _round(rows.select("series_key", "trial", p.alias("p"), "score", "folds"), "score", places=5)


def hparam_race_lags(spark, sf):
    """500 draws of the window width on all series."""
    space = {"T_X": {"TYPE": "int_uniform", "RANGE": [7, 366]}}
    return search.race(class_series(spark, sf), "linear_regression", search.sample_trials(space, 500, seed=11))


def evaluate_refit_forecast(spark, sf):
    metrics, ahead = search.evaluate_refit_forecast(_split(spark, sf), "arima", AHEAD, AR1)
    both = ahead.join(metrics.select("series_key", "MAE", "RMSE"), "series_key").drop("model")
    return _round(both, "MAE", "RMSE", "yhat", places=5)


def train_all_models(spark, sf):
    models = {name: None for name in FC.REGISTRY} | {"random_forest": FOREST, "arima": MONTHLY, "linear_regression": {"T_X": LAGS}}
    return search.evaluate_all(_split(spark, sf), models)


LAG2 = f"""{SERIES},
part AS (SELECT *, {{train}} AS tr FROM series),
st AS (SELECT series_key, avg(y) AS m, stddev_pop(y) AS s, max(rn) AS last FROM part WHERE tr GROUP BY series_key),
z AS (SELECT series_key, ds, rn, tr, y, (y - m) / s AS z, lag((y - m) / s, 1) OVER w AS z1, lag((y - m) / s, 2) OVER w AS z2
      FROM part JOIN st USING (series_key) WINDOW w AS (PARTITION BY series_key ORDER BY ds)),
c AS (SELECT series_key, covar_pop(z, z1) AS y1, covar_pop(z, z2) AS y2, var_pop(z1) AS v1, var_pop(z2) AS v2,
        covar_pop(z1, z2) AS v12, avg(z) AS mz, avg(z1) AS m1, avg(z2) AS m2 FROM z WHERE rn > 2 AND tr GROUP BY series_key),
b AS (SELECT series_key, m, s, last, (v2 * y1 - v12 * y2) / (v1 * v2 - v12 * v12) AS b1,
        (v1 * y2 - v12 * y1) / (v1 * v2 - v12 * v12) AS b2, mz, m1, m2 FROM c JOIN st USING (series_key)),
fit AS (SELECT *, mz - b1 * m1 - b2 * m2 AS b0 FROM b)"""


def _diff(train: str) -> str:
    """AR(1) on differences without a constant, per series: phi, aic, last level and change."""
    return f"""{SERIES},
part AS (SELECT *, {train} AS tr FROM series),
w AS (SELECT *, y - lag(y) OVER (PARTITION BY series_key ORDER BY ds) AS d FROM part WHERE tr),
x AS (SELECT *, lag(d, 1) OVER v AS d1, lag(d, 2) OVER v AS d2 FROM w WINDOW v AS (PARTITION BY series_key ORDER BY ds)),
f AS (SELECT series_key, sum(d * d1) / sum(d1 * d1) AS phi FROM x WHERE d1 IS NOT NULL GROUP BY series_key),
ar1 AS (SELECT x.series_key, any_value(phi) AS phi,
   count(*) * ln(sum((d - phi * d1) * (d - phi * d1)) / count(*)) + 4 AS aic
   FROM x JOIN f USING (series_key) WHERE d1 IS NOT NULL GROUP BY x.series_key),
tip AS (SELECT series_key, max_by(y, ds) AS y, max_by(d, ds) AS d, max(ds) AS ds FROM x GROUP BY series_key)"""


def _path(h: str) -> str:
    """Level after h steps of an AR(1) difference: y + d (phi + ... + phi^h)."""
    return f"(tip.y + tip.d * phi * (1 - pow(phi, {h})) / (1 - phi))"


CV_AR1 = f"""{FOLDS},
w AS (SELECT *, gt - lag(gt) OVER (PARTITION BY series_key, fold ORDER BY ds) AS d FROM folds),
x AS (SELECT *, lag(d) OVER (PARTITION BY series_key, fold ORDER BY ds) AS d1 FROM w),
fphi AS (SELECT series_key, fold, sum(d * d1) / sum(d1 * d1) AS phi FROM x WHERE d1 IS NOT NULL AND rn <= cut GROUP BY ALL),
tip AS (SELECT series_key, fold, gt AS y, d FROM x WHERE rn = cut),
ev AS (SELECT x.series_key, x.fold, gt, CASE WHEN rn <= cut THEN gt - (x.d - phi * d1) END AS model,
   CASE WHEN rn > cut THEN {_path('rn - cut')} END AS forecast, CASE WHEN rn > cut THEN tip.y END AS walk
   FROM x JOIN fphi USING (series_key, fold) JOIN tip USING (series_key, fold))"""

HPARAM_SQL = f"""WITH {CV_AR1},
m AS (SELECT series_key, fold, avg(abs(gt - walk)) AS a, avg(abs(gt - forecast)) AS b FROM ev GROUP BY ALL),
t AS (SELECT series_key, '0' AS trial, 0 AS p, avg(a) AS score FROM m GROUP BY series_key
      UNION ALL SELECT series_key, '1', 1, avg(b) FROM m GROUP BY series_key),
u AS (SELECT * FROM t UNION ALL
      SELECT series_key, 'Best', arg_min(p, struct_pack(score := round(score, 9), trial := p)), arg_min(score, struct_pack(score := round(score, 9), trial := p))
      FROM t GROUP BY series_key)
SELECT series_key, trial, CAST(p AS INTEGER) AS p, round(score, 5) AS score FROM u"""

RACE_SQL = f"""WITH {CV_AR1},
m AS (SELECT series_key, fold, 0 AS p, avg(abs(gt - walk)) AS e FROM ev GROUP BY ALL
      UNION ALL SELECT series_key, fold, 1, avg(abs(gt - forecast)) FROM ev GROUP BY ALL),
t AS (SELECT series_key, p, max(e) FILTER (fold = 10) AS latest, avg(e) AS mean FROM m GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY round(latest, 9), p) AS place FROM t),
u AS (SELECT series_key, CAST(p AS VARCHAR) AS trial, p, CASE WHEN place = 1 THEN mean ELSE latest END AS score, CASE WHEN place = 1 THEN 5 ELSE 1 END AS folds FROM r
      UNION ALL SELECT series_key, 'Best', p, mean, 5 FROM r WHERE place = 1)
SELECT series_key, trial, CAST(p AS INTEGER) AS p, round(score, 5) AS score, CAST(folds AS INTEGER) AS folds FROM u"""

ORDER_SQL = f"""WITH {_diff('TRUE')},
s2 AS (SELECT series_key, sum(d * d1) AS y1, sum(d * d2) AS y2, sum(d1 * d1) AS v1, sum(d2 * d2) AS v2, sum(d1 * d2) AS v12
       FROM x WHERE d2 IS NOT NULL GROUP BY series_key),
b2 AS (SELECT series_key, (v2 * y1 - v12 * y2) / (v1 * v2 - v12 * v12) AS p1,
         (v1 * y2 - v12 * y1) / (v1 * v2 - v12 * v12) AS p2 FROM s2),
ar2 AS (SELECT x.series_key, count(*) * ln(sum(pow(d - p1 * d1 - p2 * d2, 2)) / count(*)) + 6 AS aic
        FROM x JOIN b2 USING (series_key) WHERE d2 IS NOT NULL GROUP BY x.series_key)
SELECT series_key, CAST(CASE WHEN round(ar1.aic, 9) <= round(ar2.aic, 9) THEN 1 ELSE 2 END AS INTEGER) AS p,
       round(least(ar1.aic, ar2.aic), 4) AS aic, CAST(2 AS BIGINT) AS fits
FROM ar1 JOIN ar2 USING (series_key)"""

ALL_ORDERS_SQL = f"""WITH RECURSIVE {SERIES},
c AS (SELECT series_key, rn, n, y - avg(y) OVER (PARTITION BY series_key) AS c FROM series),
k AS (SELECT CAST(unnest(range(31)) AS INTEGER) AS k),
r AS (SELECT a.series_key, k, any_value(a.n) AS n, sum(a.c * b.c) / any_value(a.n) AS r FROM c a CROSS JOIN k
      JOIN c b ON b.series_key = a.series_key AND b.rn = a.rn - k GROUP BY a.series_key, k),
l AS (SELECT series_key, any_value(n) AS n, list(r ORDER BY k) AS r FROM r GROUP BY series_key),
go AS (SELECT series_key, n, r, 0 AS m, CAST([] AS DOUBLE[]) AS phi, r[1] AS v FROM l
  UNION ALL SELECT series_key, n, r, m + 1, list_append(list_transform(range(1, m + 1), lambda j: phi[j] - k * phi[m + 1 - j]), k), v * (1 - k * k)
  FROM (SELECT *, (r[m + 2] - coalesce(list_sum(list_transform(range(1, m + 1), lambda j: phi[j] * r[m + 2 - j])), 0)) / v AS k
        FROM go WHERE m < 30))
SELECT series_key, m AS "order", n AS n_rows, round(n * ln(v) + 2 * (m + 1), 5) + 0.0 AS aic, round(phi[m], 5) + 0.0 AS last_weight FROM go"""

REFIT_SQL = f"""WITH {_diff(f'rn <= n - {TEST_ROWS}')},
ev AS (SELECT p.series_key, p.y - {_path(f'(p.rn - (p.n - {TEST_ROWS}))')} AS e
       FROM part p JOIN f USING (series_key) JOIN tip USING (series_key) WHERE NOT p.tr),
m AS (SELECT series_key, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse FROM ev GROUP BY series_key),
w_all AS (SELECT *, y - lag(y) OVER (PARTITION BY series_key ORDER BY ds) AS d FROM series),
x_all AS (SELECT *, lag(d) OVER (PARTITION BY series_key ORDER BY ds) AS d1 FROM w_all),
f_all AS (SELECT series_key, sum(d * d1) / sum(d1 * d1) AS phi, max_by(y, ds) AS y, max_by(d, ds) AS d, max(ds) AS ds
          FROM x_all WHERE d1 IS NOT NULL GROUP BY series_key),
h AS (SELECT *, CAST(unnest(range(1, {AHEAD + 1})) AS INTEGER) AS h FROM f_all)
SELECT series_key, ds + h AS ds, round(y + d * phi * (1 - pow(phi, h)) / (1 - phi), 5) AS yhat,
       round(mae, 5) AS "MAE", round(rmse, 5) AS "RMSE" FROM h JOIN m USING (series_key)"""

ANNUAL_SQL = f"""WITH {SERIES},
w AS (SELECT a.*, a.y - b.y AS w FROM series a LEFT JOIN series b ON a.series_key = b.series_key AND b.rn = a.rn - 365),
p AS (SELECT a.series_key, sum(a.w * b.w) / sum(b.w * b.w) AS phi FROM w a JOIN w b
      ON a.series_key = b.series_key AND b.rn = a.rn - 365 WHERE b.w IS NOT NULL GROUP BY a.series_key),
tip AS (SELECT series_key, max(ds) AS last FROM series GROUP BY series_key)
SELECT series_key, last + CAST(rn - (n - 365) AS INTEGER) AS ds, round(y + phi * w, 5) + 0.0 AS yhat, round(phi, 5) + 0.0 AS phi
FROM w JOIN p USING (series_key) JOIN tip USING (series_key) WHERE rn > n - 365 AND rn <= n - 365 + {AHEAD}"""

LINE_SQL = f"""WITH {SERIES},
t AS (SELECT *, date_diff('day', min(ds) OVER (PARTITION BY series_key), ds) AS t FROM series),
l AS (SELECT series_key, regr_slope(y, t) AS b, regr_intercept(y, t) AS a, max(t) AS z, max(ds) AS last FROM t GROUP BY series_key),
h AS (SELECT CAST(unnest(range(1, {AHEAD + 1})) AS INTEGER) AS h)
SELECT series_key, 'additive' AS model, last + h AS ds, round(a + b * (z + h), 3) + 0.0 AS yhat FROM l CROSS JOIN h"""

SIMPLE_SQL = f"""WITH {_diff(f'rn <= n - {TEST_ROWS}')},
r AS (SELECT p.*, lag(p.y) OVER v AS y1, lag(p.y, 2) OVER v AS y2 FROM part p WINDOW v AS (PARTITION BY series_key ORDER BY ds)),
ev AS (
  SELECT r.series_key, 'arima' AS model_name, r.y AS gt,
    CASE WHEN tr AND r.rn > 2 THEN y1 + phi * (y1 - y2) END AS model,
    CASE WHEN NOT tr THEN {_path(f'(r.rn - (r.n - {TEST_ROWS}))')} END AS forecast
  FROM r JOIN f USING (series_key) JOIN tip USING (series_key)
  UNION ALL
  SELECT r.series_key, 'last_value', r.y, CASE WHEN tr THEN y1 END, CASE WHEN NOT tr THEN tip.y END
  FROM r JOIN tip USING (series_key))
{metrics_sql('ev', 'series_key, model_name').replace(', 6)', ', 4)')}"""

def _vector_lag(train: str) -> str:
    """Both features on yesterday's: scaler, coefficients and the walk from the last training day."""
    return f"""{DAYS},
two AS (SELECT rate_class AS series_key, d AS ds, CAST(sum(rate) AS DOUBLE) AS a, CAST(count(*) AS DOUBLE) AS b,
          row_number() OVER (PARTITION BY rate_class ORDER BY d) AS rn, count(*) OVER (PARTITION BY rate_class) AS n
        FROM days GROUP BY rate_class, d),
part AS (SELECT *, {train} AS tr FROM two),
st AS (SELECT series_key, avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb, max(rn) AS last
       FROM part WHERE tr GROUP BY series_key),
z AS (SELECT part.*, last, (a - ma) / sa AS za, (b - mb) / sb AS zb, lag((a - ma) / sa) OVER w AS a1, lag((b - mb) / sb) OVER w AS b1
      FROM part JOIN st USING (series_key) WINDOW w AS (PARTITION BY series_key ORDER BY ds)),
c AS (SELECT series_key, var_pop(a1) AS v1, var_pop(b1) AS v2, covar_pop(a1, b1) AS v12, covar_pop(za, a1) AS aa, covar_pop(za, b1) AS ab,
        covar_pop(zb, a1) AS ba, covar_pop(zb, b1) AS bb, avg(za) AS m0a, avg(zb) AS m0b, avg(a1) AS m1a, avg(b1) AS m1b
      FROM z WHERE tr AND rn > 1 GROUP BY series_key),
w AS (SELECT *, (v2 * aa - v12 * ab) / (v1 * v2 - v12 * v12) AS waa, (v1 * ab - v12 * aa) / (v1 * v2 - v12 * v12) AS wab,
        (v2 * ba - v12 * bb) / (v1 * v2 - v12 * v12) AS wba, (v1 * bb - v12 * ba) / (v1 * v2 - v12 * v12) AS wbb FROM c),
fit AS (SELECT *, m0a - waa * m1a - wab * m1b AS ia, m0b - wba * m1a - wbb * m1b AS ib FROM w JOIN st USING (series_key))"""


def _vector_walk(steps) -> str:
    return f"""go AS (SELECT series_key, 0 AS h, za, zb FROM z WHERE rn = last
       UNION ALL SELECT go.series_key, h + 1, ia + waa * za + wab * zb, ib + wba * za + wbb * zb
       FROM go JOIN fit USING (series_key) WHERE h < {steps})"""


VECTOR_FORECAST_SQL = f"""WITH RECURSIVE {_vector_lag('TRUE')}, {_vector_walk(AHEAD)}
SELECT go.series_key, z.ds + go.h AS ds, round(go.za * sa + ma, 4) + 0.0 AS y, round(go.zb * sb + mb, 4) + 0.0 AS active
FROM go JOIN fit USING (series_key) JOIN z ON z.series_key = go.series_key AND z.rn = z.last WHERE go.h > 0"""

VECTOR_EVALUATE_SQL = f"""WITH RECURSIVE {_vector_lag(f'rn <= n - {TEST_ROWS}')}, {_vector_walk(TEST_ROWS)},
p AS (SELECT z.*, sa, ma, (ia + waa * a1 + wab * b1) * sa + ma AS p FROM z JOIN fit USING (series_key))
SELECT p.series_key, p.ds, a AS gt, round(CASE WHEN tr THEN p END, 4) + 0.0 AS model,
       round(CASE WHEN NOT tr THEN go.za * sa + ma END, 4) + 0.0 AS forecast, round(CASE WHEN NOT tr THEN p END, 4) + 0.0 AS test_pred
FROM p LEFT JOIN go ON go.series_key = p.series_key AND go.h = p.rn - p.last AND go.h > 0"""


def _stump(train: str) -> str:
    """The split of yesterday's scaled value that explains most, over all series, and the mean on either side."""
    return f"""ev AS (SELECT event_type AS series_key, CAST(ts AS DATE) AS ds, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS y
       FROM events GROUP BY ALL),
num AS (SELECT *, row_number() OVER v AS rn, count(*) OVER (PARTITION BY series_key) AS n FROM ev WINDOW v AS (PARTITION BY series_key ORDER BY ds)),
part AS (SELECT *, {train} AS tr FROM num),
st AS (SELECT series_key, avg(y) AS m, CASE WHEN stddev_pop(y) > 0 THEN stddev_pop(y) ELSE 1 END AS s, max(rn) AS last
       FROM part WHERE tr GROUP BY series_key),
z AS (SELECT part.*, m, s, last, (y - m) / s AS z, lag((y - m) / s) OVER (PARTITION BY series_key ORDER BY ds) AS x
      FROM part JOIN st USING (series_key)),
t AS (SELECT z, x FROM z WHERE tr AND x IS NOT NULL),
cum AS (SELECT x, sum(z) AS sz, count(*) AS c FROM t GROUP BY x),
cuts AS (SELECT (x + lead(x) OVER v) / 2 AS thr, sum(sz) OVER v AS ls, sum(c) OVER v AS lc, sum(sz) OVER () AS al, sum(c) OVER () AS ac
         FROM cum WINDOW v AS (ORDER BY x)),
best AS (SELECT thr FROM cuts WHERE thr IS NOT NULL ORDER BY ls * ls / lc + (al - ls) * (al - ls) / (ac - lc) DESC, thr LIMIT 1),
leaf AS (SELECT thr, (SELECT avg(z) FROM t WHERE x <= thr) AS lo, (SELECT avg(z) FROM t WHERE x > thr) AS hi FROM best)"""


def _stump_walk(steps: str) -> str:
    return f"""go AS (SELECT series_key, 0 AS h, z FROM z WHERE rn = last
       UNION ALL SELECT series_key, h + 1, CASE WHEN z <= thr THEN lo ELSE hi END FROM go CROSS JOIN leaf WHERE h < {steps})"""


ONE_SPLIT_SQL = f"""WITH RECURSIVE {_stump('rn <= n - 7')}, {_stump_walk('7')},
p AS (SELECT z.*, CASE WHEN x <= thr THEN lo WHEN x > thr THEN hi END * s + m AS p FROM z CROSS JOIN leaf)
SELECT p.series_key, p.ds, round(y, 4) + 0.0 AS gt, round(CASE WHEN tr THEN p END, 4) + 0.0 AS model,
       round(CASE WHEN NOT tr THEN go.z * s + m END, 4) + 0.0 AS forecast, round(CASE WHEN NOT tr THEN p END, 4) + 0.0 AS test_pred
FROM p LEFT JOIN go ON go.series_key = p.series_key AND go.h = p.rn - p.last AND go.h > 0"""

ONE_SPLIT_FORECAST_SQL = f"""WITH RECURSIVE {_stump('TRUE')}, {_stump_walk(str(AHEAD))}
SELECT go.series_key, 'random_forest' AS model, z.ds + go.h AS ds, round(go.z * s + m, 4) + 0.0 AS yhat
FROM go JOIN z ON z.series_key = go.series_key AND z.rn = z.last WHERE go.h > 0"""

QUERIES = {
    "ar1_by_series": ar1_by_series,
    "ols_two_lag_fit": ols_two_lag_fit,
    "ols_lag_fit": ols_lag_fit,
    "pooled_lag_fit": pooled_lag_fit,
    "forest_lag_fit": forest_lag_fit,
    "forest_forecast": forest_forecast,
    "forest_one_split": forest_one_split,
    "forest_one_split_forecast": forest_one_split_forecast,
    "one_step_predictions": one_step_predictions,
    "recursive_forecast": recursive_forecast,
    "additive_fit": additive_fit,
    "decompose": decompose,
    "additive_forecast": additive_forecast,
    "additive_trend_forecast": additive_trend_forecast,
    "additive_conditions": additive_conditions,
    "additive_evaluate": additive_evaluate,
    "arma_fit": arma_fit,
    "arma_with_errors_fit": arma_with_errors_fit,
    "seasonal_arma_fit": seasonal_arma_fit,
    "seasonal_arma_annual": seasonal_arma_annual,
    "seasonal_arma_conditions": seasonal_arma_conditions,
    "arma_error_conditions": arma_error_conditions,
    "order_search": order_search,
    "all_orders": all_orders,
    "lag_regression_by_account": lag_regression_by_account,
    "feature_lag_forecast": feature_lag_forecast,
    "feature_lag_evaluate": feature_lag_evaluate,
    "cv_evaluate": cv_evaluate,
    "hparam_search": hparam_search,
    "hparam_search_lags": hparam_search_lags,
    "hparam_race": hparam_race,
    "hparam_race_lags": hparam_race_lags,
    "evaluate_refit_forecast": evaluate_refit_forecast,
    "train_all_models": train_all_models,
    "train_simple_models": train_simple_models,
}

ORACLES = {
    "ar1_by_series": f"""WITH {SERIES},
a AS (SELECT series_key, y, lag(y) OVER (PARTITION BY series_key ORDER BY ds) AS x FROM series)
SELECT series_key, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 4) AS intercept,
       CAST(regr_count(y, x) AS BIGINT) AS n FROM a GROUP BY series_key""",
    "ols_two_lag_fit": f"""WITH {LAG2.replace('{train}', 'TRUE')},
l AS (SELECT series_key, last, unnest([m, s, b0, b2, b1]) AS b, CAST(unnest(range(5)) AS INTEGER) AS pos FROM fit)
SELECT series_key, 'linear_regression' AS model, last AS n_rows, pos, round(b, 5) + 0.0 AS b FROM l""",
    "one_step_predictions": f"""WITH {LAG2.replace('{train}', f'rn <= n - {TEST_ROWS}')},
p AS (SELECT series_key, ds, tr, y, (b0 + b1 * z1 + b2 * z2) * s + m AS p FROM z JOIN fit USING (series_key))
SELECT series_key, ds, y AS gt, round(CASE WHEN tr THEN p END, 4) + 0.0 AS model,
       round(CASE WHEN NOT tr THEN p END, 4) + 0.0 AS test_pred FROM p""",
    "recursive_forecast": f"""WITH RECURSIVE {LAG2.replace('{train}', 'TRUE')},
seed AS (SELECT z.series_key, z.ds, z.z AS a1, z.z1 AS a2 FROM z JOIN fit USING (series_key) WHERE z.rn = last),
go AS (SELECT series_key, 0 AS h, a1, a2 FROM seed
       UNION ALL SELECT go.series_key, h + 1, b0 + b1 * a1 + b2 * a2, a1 FROM go JOIN fit USING (series_key) WHERE h < {AHEAD})
SELECT go.series_key, 'linear_regression' AS model, ds + h AS ds, round(go.a1 * s + m, 4) + 0.0 AS yhat
FROM go JOIN fit USING (series_key) JOIN seed ON go.series_key = seed.series_key WHERE h > 0""",
    "forest_one_split": ONE_SPLIT_SQL,
    "forest_one_split_forecast": ONE_SPLIT_FORECAST_SQL,
    "arma_fit": f"""WITH {_diff('TRUE')}, h AS (SELECT CAST(unnest(range(1, {AHEAD + 1})) AS INTEGER) AS h)
SELECT series_key, tip.ds + h AS ds, round({_path('h')}, 5) AS yhat, round(phi, 5) AS phi, round(aic, 5) AS aic
FROM ar1 JOIN tip USING (series_key) CROSS JOIN h""",
    "order_search": ORDER_SQL,
    "all_orders": ALL_ORDERS_SQL,
    "feature_lag_forecast": VECTOR_FORECAST_SQL,
    "feature_lag_evaluate": VECTOR_EVALUATE_SQL,
    "lag_regression_by_account": f"""WITH {DEDUP},
a AS (SELECT account AS series_key, CAST(date_diff('day', min(start_d), max(end_d)) + 1 AS BIGINT) AS n_rows FROM dedup GROUP BY account)
SELECT series_key, n_rows, CASE WHEN n_rows > {LONG_LAGS} THEN 0.0 END AS condition FROM a""",
    "cv_evaluate": f"WITH {CV_AR1} {metrics_sql('ev', 'series_key, fold').replace(', 6)', ', 4)')}",
    "hparam_search": HPARAM_SQL,
    "hparam_race": RACE_SQL,
    "evaluate_refit_forecast": REFIT_SQL,
    "seasonal_arma_annual": ANNUAL_SQL,
    "seasonal_arma_conditions": f"""WITH {SERIES}
SELECT series_key, greatest(count(*) - 738, 0) AS n_errors, 0.0 AS condition, 0.0 AS recursion FROM series GROUP BY series_key""",
    "arma_error_conditions": f"""WITH {SERIES}
SELECT series_key, count(*) - 2 AS n_errors, 0.0 AS condition, 0.0 AS recursion FROM series GROUP BY series_key""",
    "additive_trend_forecast": LINE_SQL,
    "additive_conditions": f"""WITH {SERIES}
SELECT series_key, mode, count(*) AS n_rows, CAST(56 AS BIGINT) AS n_terms, 0.0 AS condition
FROM series CROSS JOIN (VALUES ('additive'), ('multiplicative')) AS m(mode) GROUP BY series_key, mode""",
    "train_simple_models": SIMPLE_SQL,
}
