"""Forecast evaluation.

An evaluation table has one row per (``by``, ds): ``gt`` the actual, ``model``
the fitted value on training rows, ``forecast`` on test rows and optionally
``test_pred`` the one-step prediction on test rows. Whichever does not apply is
null; that is also how training and test rows are told apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Metric names of a forecast report and the width of a 95 % band.
METRICS = ("residuals_mean", "residuals_std", "error_mean", "error_std", "MAE", "MAPE", "MSE", "RMSE")
BAND_WIDTH = 1.96

KEYS = ("series_key",)


def attach_by_date(
    actual: DataFrame, predicted: DataFrame, by: Sequence[str] = KEYS, ds: str = "ds"
) -> DataFrame:
    """Left join of a series with model output on the date."""
    return actual.join(predicted, [*by, ds], "left")


def attach_by_position(
    actual: DataFrame, predicted: DataFrame, by: Sequence[str] = KEYS, ds: str = "ds"
) -> DataFrame:
    """Pair the i-th actual row of a series with its i-th forecast row, whatever their dates."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(ds))
    numbered = predicted.withColumn("_pos", place).drop(ds)
    return actual.withColumn("_pos", place).join(numbered, [*by, "_pos"], "left").drop("_pos")


def evaluation_rows(train: DataFrame, test: DataFrame) -> DataFrame:
    """Stack training rows (with ``model``) and test rows (with ``forecast``)."""
    return train.unionByName(test, allowMissingColumns=True)


def evaluate_by_date(
    split: DataFrame, predicted: DataFrame, by: Sequence[str] = KEYS, ds: str = "ds", value: str = "y"
) -> DataFrame:
    """Evaluation table of a model that predicts any date: one join, ``role`` picks the column."""
    joined = attach_by_date(split, predicted.select(*by, ds, "yhat"), by, ds)
    is_train = F.col("role") == "train"
    return joined.select(
        *by,
        ds,
        F.col(value).alias("gt"),
        F.when(is_train, F.col("yhat")).alias("model"),
        F.when(~is_train, F.col("yhat")).alias("forecast"),
    )


def with_errors(df: DataFrame) -> DataFrame:
    """Residual, error and relative error of each row; a zero actual has no relative error."""
    return df.withColumns(
        {"residuals": F.col("gt") - F.col("model"), "error": F.col("gt") - F.col("forecast")}
    ).withColumn("error_pct", F.try_divide(F.col("error"), F.col("gt")))


def forecast_metrics(df: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """A10: the eight metrics per group in one aggregation, plus the zero actuals MAPE leaves out."""
    mse = F.avg(F.col("error") * F.col("error"))
    return (
        with_errors(df)
        .groupBy(*by)
        .agg(
            F.avg("residuals").alias("residuals_mean"),
            F.stddev_samp("residuals").alias("residuals_std"),
            F.avg("error").alias("error_mean"),
            F.stddev_samp("error").alias("error_std"),
            F.avg(F.abs("error")).alias("MAE"),
            F.avg(F.abs("error_pct")).alias("MAPE"),
            mse.alias("MSE"),
            F.sqrt(mse).alias("RMSE"),
            F.count_if(F.col("forecast").isNotNull() & (F.col("gt") == 0)).alias("zero_actuals"),
        )
    )


def forecast_bands(df: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """Confidence band from the residual deviation, prediction band from the error deviation."""
    group = Window.partitionBy(*by)
    sized = with_errors(df).withColumns(
        {
            "_r": F.stddev_samp("residuals").over(group) * BAND_WIDTH,
            "_e": F.stddev_samp("error").over(group) * BAND_WIDTH,
        }
    )
    return sized.withColumns(
        {
            "conf_int_low": F.col("forecast") - F.col("_r"),
            "conf_int_up": F.col("forecast") + F.col("_r"),
            "pred_int_low": F.col("forecast") - F.col("_e"),
            "pred_int_up": F.col("forecast") + F.col("_e"),
        }
    ).drop("_r", "_e")


def fold_summary(
    metrics: DataFrame,
    by: Sequence[str] = KEYS,
    fold: str = "fold",
    names: Sequence[str] = METRICS,
) -> DataFrame:
    """Fold rows followed by a ``mean`` and a ``std`` row per group (fold becomes text)."""
    rows = metrics.select(*by, F.col(fold).cast("string").alias(fold), *names)
    both = metrics.groupBy(*by).agg(
        F.array(
            F.struct(F.lit("mean").alias(fold), *[F.avg(m).alias(m) for m in names]),
            F.struct(F.lit("std").alias(fold), *[F.stddev_samp(m).alias(m) for m in names]),
        ).alias("_s")
    )
    return rows.unionByName(both.select(*by, F.inline("_s")))
