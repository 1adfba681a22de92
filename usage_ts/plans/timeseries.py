"""Registered queries: splits, lags, folds, differences, features of daily series."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from usage_ts.functions import calendar
from usage_ts.functions import columns as C
from usage_ts.operators import intervals, series
from usage_ts.plans.views import SERIES
from usage_ts.sources import testtables

LAGS = 7


def class_series(spark, sf):
    """One daily series per rate class: series_key, ds, y.

    Kept, as most queries read it several times; it has one row per class and day.
    """
    days = intervals.daily_consumption(testtables.billing_dedup(spark, sf), ["rate_class"])
    return days.select(
        F.col("rate_class").alias("series_key"), F.col("d").alias("ds"), C.plain(F.col("consumption")).alias("y")
    ).persist(StorageLevel.MEMORY_AND_DISK)


def event_series(spark, sf):
    """One short daily series per event type."""
    e = testtables.table(spark, sf, "events")
    return e.groupBy(F.col("event_type").alias("series_key"), F.col("ts").cast("date").alias("ds")).agg(
        C.plain(F.sum(F.col("value").cast("decimal(18,4)"))).alias("y")
    )


def holiday_calendar(df, ds="ds"):
    """First of January and July and Christmas Day of every year the series touch."""
    years = df.agg(F.min(ds).alias("a"), F.max(ds).alias("b")).select(
        F.explode(F.sequence(F.year("a"), F.year("b") + 1)).alias("yr")
    )
    fixed = {"new_year": (1, 1), "midsummer": (7, 1), "christmas": (12, 25)}
    return years.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(h).alias("holiday"), F.make_date("yr", F.lit(m), F.lit(d)).alias(ds))
                    for h, (m, d) in fixed.items()
                ]
            )
        ).alias("h")
    ).select("h.*")


HOLIDAY_COLUMNS = {"new_year": "is_new_year", "midsummer": "is_midsummer", "christmas": "is_christmas"}


def split_fixed(spark, sf):
    return series.split_fixed(class_series(spark, sf), 183)


def split_fraction(spark, sf):
    return series.split_fraction(class_series(spark, sf), 0.1)


def split_validation(spark, sf):
    train = series.split_fixed(class_series(spark, sf), 183).filter("role = 'train'").drop("role")
    return series.split_validation(train, 0.1, LAGS)


def lag_windows(spark, sf):
    w = series.lag_windows(class_series(spark, sf), LAGS)
    return w.select("series_key", "ds", "y", F.posexplode("window").alias("pos", "lag_y"))


def recent_window(spark, sf):
    w = series.recent_window(class_series(spark, sf), LAGS)
    return w.select("series_key", "ds", F.posexplode("window").alias("pos", "lag_y"))


def cv_folds(spark, sf):
    return series.cv_folds(class_series(spark, sf), 10, 5).drop("y")


def difference(spark, sf):
    d = series.difference(class_series(spark, sf), order=2, output="d2")
    d = series.difference(d, order=1, output="d1")
    return d.select("series_key", "ds", F.round("d1", 6).alias("d1"), F.round("d2", 6).alias("d2"))


def seasonal_difference(spark, sf):
    d = series.difference(class_series(spark, sf), lag=365, output="ds365")
    d = series.difference(d, value="ds365", lag=1, output="d1_ds365")
    return d.select("series_key", "ds", *[F.round(c, 6).alias(c) for c in ("ds365", "d1_ds365")])


def standard_scale(spark, sf):
    z = series.standard_scale(class_series(spark, sf), ["y"])
    return z.select("series_key", "ds", F.round("y_z", 6).alias("y_z"))


def holiday_features(spark, sf):
    s = class_series(spark, sf).drop("y")
    return series.holiday_flags(s, holiday_calendar(s), HOLIDAY_COLUMNS)


def fourier_trend_features(spark, sf):
    from pyspark.sql import Window

    of = Window.partitionBy("series_key")
    s = class_series(spark, sf).withColumns({"_a": F.min("ds").over(of), "_b": F.max("ds").over(of)})
    t = calendar.scaled_time(F.col("ds"), F.col("_a"), F.col("_b"))
    named = {"t": t}
    named |= {f"hinge_{i}": h for i, h in enumerate(calendar.hinges(t, 5, 0.8), 1)}
    for name, order in (("yearly", 2), ("weekly", 1)):
        period = calendar.SEASONS[name][0]
        for i, c in enumerate(calendar.fourier_pairs(F.col("ds"), period, order)):
            named[f"{name}_{'cos' if i % 2 else 'sin'}{i // 2 + 1}"] = c
    return s.select("series_key", "ds", *[(F.round(c, 6) + 0.0).alias(n) for n, c in named.items()])


def future_spine(spark, sf):
    s = class_series(spark, sf)
    ahead = series.future_spine(s, 60).withColumn("kind", F.lit("future"))
    both = series.future_spine(s, 60, include_history=True).withColumn("kind", F.lit("both"))
    return ahead.unionByName(both)


def _fold_sql():
    return f"""WITH {SERIES},
f AS (SELECT *, n // 11 AS b, unnest(range(6, 11)) AS fold FROM series)
SELECT series_key, ds, CAST(fold AS INTEGER) AS fold, CASE WHEN rn <= n - (11 - fold) * b THEN 'train' ELSE 'test' END AS role
FROM f WHERE rn <= n - (11 - fold) * b + b"""


def _fourier_sql():
    pi = "pi()"
    t = "(CAST(date_diff('day', a, ds) AS DOUBLE) / date_diff('day', a, b))"
    cols = [f"round({t}, 6) + 0.0 AS t"]
    cols += [f"round(greatest({t} - {0.8 * j / 5!r}, 0.0), 6) + 0.0 AS hinge_{j}" for j in range(1, 6)]
    for name, period, order in (("yearly", 365.25, 2), ("weekly", 7.0, 1)):
        for k in range(1, order + 1):
            for fn in ("sin", "cos"):
                cols.append(
                    f"round({fn}(date_diff('day', DATE '1970-01-01', ds) * (2.0 * {pi} * {k} / {period})), 6) + 0.0 AS {name}_{fn}{k}"
                )
    return f"""WITH {SERIES},
e AS (SELECT *, min(ds) OVER (PARTITION BY series_key) AS a, max(ds) OVER (PARTITION BY series_key) AS b FROM series)
SELECT series_key, ds, {', '.join(cols)} FROM e"""


QUERIES = {
    "split_fixed": split_fixed,
    "split_fraction": split_fraction,
    "split_validation": split_validation,
    "lag_windows": lag_windows,
    "recent_window": recent_window,
    "cv_folds": cv_folds,
    "difference": difference,
    "seasonal_difference": seasonal_difference,
    "standard_scale": standard_scale,
    "holiday_features": holiday_features,
    "fourier_trend_features": fourier_trend_features,
    "future_spine": future_spine,
}

W = "OVER (PARTITION BY series_key ORDER BY ds)"
ORACLES = {
    "split_fixed": f"""WITH {SERIES}
SELECT series_key, ds, y, CASE WHEN rn <= n - 183 THEN 'train' ELSE 'test' END AS role FROM series""",
    "split_fraction": f"""WITH {SERIES}
SELECT series_key, ds, y, CASE WHEN rn <= floor((1.0 - 0.1) * n) THEN 'train' ELSE 'test' END AS role FROM series""",
    "split_validation": f"""WITH {SERIES},
t AS (SELECT series_key, ds, y, rn, floor((1.0 - 0.1) * (n - 183)) AS cut FROM series WHERE rn <= n - 183)
SELECT series_key, ds, y, CASE WHEN rn <= cut THEN 'train' ELSE 'val' END AS role,
       rn <= cut AND rn > cut - {LAGS} AS is_context FROM t""",
    "lag_windows": f"""WITH {SERIES}
SELECT a.series_key, a.ds, a.y, CAST(b.rn - a.rn + {LAGS} AS INTEGER) AS pos, b.y AS lag_y
FROM series a JOIN series b ON a.series_key = b.series_key AND b.rn BETWEEN a.rn - {LAGS} AND a.rn - 1
WHERE a.rn > {LAGS}""",
    "recent_window": f"""WITH {SERIES}
SELECT series_key, max(ds) OVER (PARTITION BY series_key) AS ds, CAST(rn - (n - {LAGS}) - 1 AS INTEGER) AS pos, y AS lag_y
FROM series WHERE rn > n - {LAGS}""",
    "cv_folds": _fold_sql(),
    "difference": f"""WITH {SERIES},
a AS (SELECT series_key, ds, y - lag(y) {W} AS d1 FROM series)
SELECT series_key, ds, round(d1, 6) AS d1, round(d1 - lag(d1) {W}, 6) AS d2 FROM a""",
    "seasonal_difference": f"""WITH {SERIES},
a AS (SELECT series_key, ds, y - lag(y, 365) {W} AS s FROM series)
SELECT series_key, ds, round(s, 6) AS ds365, round(s - lag(s) {W}, 6) AS d1_ds365 FROM a""",
    "standard_scale": f"""WITH {SERIES}
SELECT series_key, ds, round((y - avg(y) OVER (PARTITION BY series_key)) / stddev_pop(y) OVER (PARTITION BY series_key), 6) AS y_z
FROM series""",
    "holiday_features": f"""WITH {SERIES},
f AS (SELECT series_key, ds, month(ds) * 100 + day(ds) AS md FROM series)
SELECT series_key, ds, CAST(md IN (101, 102) AS INTEGER) AS is_new_year, CAST(md IN (701, 702) AS INTEGER) AS is_midsummer,
       CAST(md IN (1225, 1226) AS INTEGER) AS is_christmas FROM f""",
    "fourier_trend_features": _fourier_sql(),
    "future_spine": f"""WITH {SERIES},
ahead AS (SELECT series_key, CAST(unnest(generate_series(CAST(max(ds) + 1 AS TIMESTAMP), CAST(max(ds) + 60 AS TIMESTAMP),
  INTERVAL 1 DAY)) AS DATE) AS ds FROM series GROUP BY series_key)
SELECT *, 'future' AS kind FROM ahead UNION ALL SELECT *, 'both' FROM ahead
UNION ALL SELECT series_key, ds, 'both' FROM series""",
}
