"""Operators on daily series.

A series table is unique on (``by``, ``ds``): it comes out of a grouping by
day, so one series holds at most one row per calendar day. That bounds every
window partition below, whatever the number of records behind it. Position, not
date distance, decides splits and lags, so removed ranges are jumped over.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("series_key",)


def _ordered(by: Sequence[str], ds: str):
    return Window.partitionBy(*by).orderBy(ds)


def with_position(df: DataFrame, by: Sequence[str] = KEYS, ds: str = "ds") -> DataFrame:
    """Add ``_pos`` (1-based) and ``_size``; both use one exchange."""
    return df.withColumns(
        {
            "_pos": F.row_number().over(_ordered(by, ds)),
            "_size": F.count(F.lit(1)).over(Window.partitionBy(*by)),
        }
    )


def drop_ranges(df: DataFrame, ranges: Sequence[tuple], day: str = "ds") -> DataFrame:
    """Remove rows dated inside any closed range; a filter, so it can be pushed down."""
    inside = [F.col(day).between(F.lit(a).cast("date"), F.lit(b).cast("date")) for a, b in ranges]
    return df.filter(~reduce(Column.__or__, inside)) if inside else df


def drop_ranges_table(
    df: DataFrame, ranges: DataFrame, day: str = "ds", lo: str = "lo", hi: str = "hi"
) -> DataFrame:
    """J7 with ranges in a table of any size: an equi anti-join on their days."""
    days = ranges.filter(F.col(lo) <= F.col(hi)).select(F.explode(F.sequence(lo, hi)).alias(day)).distinct()
    return df.join(days, day, "left_anti")


def trim(
    df: DataFrame, first: int, last: int, by: Sequence[str] = KEYS, ds: str = "ds"
) -> DataFrame:
    """Drop the first and last rows of each series; 0 drops none."""
    return (
        with_position(df, by, ds)
        .filter((F.col("_pos") > first) & (F.col("_pos") <= F.col("_size") - last))
        .drop("_pos", "_size")
    )


def _with_role(df, boundary: Column, by, ds) -> DataFrame:
    return (
        with_position(df, by, ds)
        .withColumn("role", F.when(F.col("_pos") <= boundary, "train").otherwise("test"))
        .drop("_pos", "_size")
    )


def split_fixed(df: DataFrame, test_rows: int = 183, by: Sequence[str] = KEYS, ds: str = "ds") -> DataFrame:
    """The last ``test_rows`` rows of each series are the test set; none if not positive."""
    return _with_role(df, F.col("_size") - max(test_rows, 0), by, ds)


def split_fraction(
    df: DataFrame, test_fraction: float = 0.1, by: Sequence[str] = KEYS, ds: str = "ds"
) -> DataFrame:
    """The last fraction of rows is the test set; the training size is rounded down."""
    return _with_role(df, F.floor((F.lit(1.0) - F.lit(float(test_fraction))) * F.col("_size")), by, ds)


def split_validation(
    df: DataFrame,
    fraction: float = 0.1,
    context: int = 32,
    by: Sequence[str] = KEYS,
    ds: str = "ds",
) -> DataFrame:
    """Role ``train`` / ``val`` of the training rows.

    ``is_context`` marks the training rows that also precede the validation
    set, so that its first row has a full lag window.
    """
    sized = with_position(df, by, ds).withColumn(
        "_cut", F.floor((F.lit(1.0) - F.lit(float(fraction))) * F.col("_size"))
    )
    train = F.col("_pos") <= F.col("_cut")
    return sized.select(
        *df.columns,
        F.when(train, "train").otherwise("val").alias("role"),
        (train & (F.col("_pos") > F.col("_cut") - context)).alias("is_context"),
    )


def lag_windows(
    df: DataFrame,
    width: int,
    features: Sequence[str] = ("y",),
    by: Sequence[str] = KEYS,
    ds: str = "ds",
    output: str = "window",
) -> DataFrame:
    """Each row with the previous ``width`` rows, oldest first and time-major; shorter ones dropped."""
    before = _ordered(by, ds).rowsBetween(-width, -1)
    row = F.array(*[F.col(f).cast("double") for f in features]) if len(features) > 1 else F.col(features[0]).cast("double")
    lags = F.collect_list(row).over(before)
    # collect_list skips nulls, which would shift the window; ask for full rows.
    windowed = df.withColumns({output: lags, "_seen": F.count(F.lit(1)).over(before)}).filter(
        (F.col("_seen") == width) & (F.size(output) == width)
    )
    if len(features) > 1:
        windowed = windowed.withColumn(output, F.flatten(output))
    return windowed.drop("_seen")


def recent_window(
    df: DataFrame,
    width: int,
    features: Sequence[str] = ("y",),
    by: Sequence[str] = KEYS,
    ds: str = "ds",
    output: str = "window",
) -> DataFrame:
    """The last ``width`` rows of each series, the seed of a forecast."""
    row = F.array(*[F.col(f).cast("double") for f in features])
    tail = with_position(df, by, ds).filter(F.col("_pos") > F.col("_size") - width)
    return (
        tail.groupBy(*by)
        .agg(F.max(ds).alias(ds), F.array_sort(F.collect_list(F.struct("_pos", row.alias("x")))).alias("_w"))
        .filter(F.size("_w") == width)
        .select(*by, ds, F.flatten(F.transform("_w", lambda s: s["x"])).alias(output))
    )


def cv_folds(
    df: DataFrame,
    quantiles: int = 10,
    folds: int | None = 5,
    by: Sequence[str] = KEYS,
    ds: str = "ds",
) -> DataFrame:
    """Forward-chaining folds, one row per (row, fold it belongs to) with its role.

    With n rows and K quantiles a block has n // (K + 1) rows; fold k tests the
    k-th block from the end of K blocks and trains on everything before it. Rows
    are copied only to folds they take part in.
    """
    first = 1 if folds is None else quantiles - folds + 1
    block = F.floor(F.col("_size") / (quantiles + 1)).cast("int")
    numbered = with_position(df, by, ds).withColumn("_block", block).filter("_block > 0")
    start_of = F.col("_size") - (quantiles + 1 - F.col("fold")) * F.col("_block")
    return (
        numbered.withColumn("fold", F.explode(F.sequence(F.lit(first), F.lit(quantiles))))
        .filter(F.col("_pos") <= start_of + F.col("_block"))
        .withColumn("role", F.when(F.col("_pos") <= start_of, "train").otherwise("test"))
        .drop("_pos", "_size", "_block")
    )


def difference(
    df: DataFrame,
    order: int = 1,
    lag: int = 1,
    value: str = "y",
    output: str = "dy",
    by: Sequence[str] = KEYS,
    ds: str = "ds",
) -> DataFrame:
    """``order`` times the difference to the row ``lag`` rows before; null where undefined."""
    w = _ordered(by, ds)
    out = df.withColumn(output, F.col(value))
    for _ in range(order):
        out = out.withColumn(output, F.col(output) - F.lag(output, lag).over(w))
    return out


def integrate(
    df: DataFrame,
    lag: int = 1,
    change: str = "dy",
    seed: str = "y",
    output: str = "y_back",
    by: Sequence[str] = KEYS,
    ds: str = "ds",
) -> DataFrame:
    """Inverse of one :func:`difference`: the first ``lag`` rows give the seed, then changes add up."""
    numbered = with_position(df, by, ds).withColumn("_phase", (F.col("_pos") - 1) % lag)
    chain = Window.partitionBy(*by, "_phase").orderBy(ds)
    step = F.when(F.col("_pos") <= lag, F.col(seed)).otherwise(F.col(change))
    return numbered.withColumn(output, F.sum(step).over(chain)).drop("_pos", "_size", "_phase")


def standard_scale(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = KEYS, suffix: str = "_z"
) -> DataFrame:
    """(x - mean) / population deviation within each series; a constant column is only centred."""
    stats = fit_scale(df, columns, by)
    return apply_scale(df, stats, columns, by, suffix)


def fit_scale(df: DataFrame, columns: Sequence[str], by: Sequence[str] = KEYS) -> DataFrame:
    """Mean and divisor of each column per series (the fitted scaler)."""
    return df.groupBy(*by).agg(
        *[F.avg(c).alias(f"{c}_mean") for c in columns],
        *[
            F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(F.lit(1.0)).alias(f"{c}_scale")
            for c in columns
        ],
    )


def apply_scale(
    df: DataFrame,
    stats: DataFrame,
    columns: Sequence[str],
    by: Sequence[str] = KEYS,
    suffix: str = "_z",
) -> DataFrame:
    """Transform with a fitted scaler; the stats table has one row per series."""
    scaled = {f"{c}{suffix}": (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_scale") for c in columns}
    helper = [f"{c}_{x}" for c in columns for x in ("mean", "scale")]
    return df.join(stats, [*by]).withColumns(scaled).drop(*helper)


def undo_scale(
    df: DataFrame,
    stats: DataFrame,
    columns: Sequence[str],
    by: Sequence[str] = KEYS,
    suffix: str = "_z",
    output_suffix: str = "_back",
) -> DataFrame:
    """Inverse of :func:`apply_scale`."""
    back = {
        f"{c}{output_suffix}": F.col(f"{c}{suffix}") * F.col(f"{c}_scale") + F.col(f"{c}_mean")
        for c in columns
    }
    helper = [f"{c}_{x}" for c in columns for x in ("mean", "scale")]
    return df.join(stats, [*by]).withColumns(back).drop(*helper)


def holiday_flags(
    df: DataFrame,
    calendar: DataFrame,
    names: Mapping[str, str],
    ds: str = "ds",
    lower: int = 0,
    upper: int = 1,
) -> DataFrame:
    """0/1 column per holiday, set from ``lower`` to ``upper`` days around each of its dates.

    ``calendar`` has (holiday, ds); ``names`` maps holiday to output column. The
    calendar becomes one row per date before the join, so rows never multiply.
    """
    spread = calendar.select(
        "holiday",
        F.explode(F.sequence(F.date_add(ds, lower), F.date_add(ds, upper))).alias(ds),
    )
    flags = spread.groupBy(ds).agg(
        *[F.max((F.col("holiday") == h).cast("int")).alias(c) for h, c in names.items()]
    )
    return df.join(flags, ds, "left").fillna(0, subset=list(names.values()))


def future_spine(
    df: DataFrame,
    days: int,
    include_history: bool = False,
    by: Sequence[str] = KEYS,
    ds: str = "ds",
) -> DataFrame:
    """The ``days`` dates after the last one of each series, optionally after its own dates."""
    ahead = (
        df.groupBy(*by)
        .agg(F.max(ds).alias("_last"))
        .select(
            *by,
            F.explode(F.sequence(F.date_add("_last", 1), F.date_add("_last", days))).alias(ds),
        )
    )
    return df.select(*by, ds).unionByName(ahead) if include_history else ahead


def look_back_cut(old: DataFrame, start: str = "start_d", days: int = 183) -> dt.date:
    """The latest start already loaded, minus a safety margin.

    One value reaches the driver; as a literal it prunes partitions of the new read.
    """
    return old.agg(F.date_sub(F.max(start), days)).first()[0]


def replace_tail(old: DataFrame, new: DataFrame, cut, ds: str = "ds") -> DataFrame:
    """Rows of ``old`` before ``cut``, rows of ``new`` from it on, in the old schema."""
    cut = F.lit(cut).cast("date")
    return old.filter(F.col(ds) < cut).unionByName(new.filter(F.col(ds) >= cut).select([F.col(f"`{c}`") for c in old.columns]))
