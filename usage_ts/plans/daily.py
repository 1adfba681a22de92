"""Registered queries: interval records to daily figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from usage_ts.functions import columns as C
from usage_ts.operators import intervals, revisions, series
from usage_ts.plans.views import DAYS, DEDUP
from usage_ts.sources import testtables

MISSING_RANGES = [("1997-03-01", "1997-09-30"), ("1999-03-25", "1999-05-31")]
START_TRIM, END_TRIM = 242, 50
LATE_LOAD = "2001-06-01"
LOOK_BACK = 183


def _plain(df):
    return df.withColumn("consumption", C.plain(F.col("consumption")))


def daily_consumption(spark, sf):
    return _plain(intervals.daily_consumption(testtables.billing_dedup(spark, sf)))


def daily_consumption_explode(spark, sf):
    return _plain(intervals.daily_consumption(testtables.billing_dedup(spark, sf), strategy="explode"))


def _in_small_units(spark, sf):
    """Quantities in a unit so small that some rates are beyond the fixed-point type."""
    b = testtables.billing_dedup(spark, sf)
    fine = F.col("consumption").cast("decimal(38,2)") * F.lit(10**12)
    return b.withColumns({"consumption": fine, "num_a": F.when(F.col("num_a") > 0.05, 1e13).otherwise(F.col("num_a"))})


def daily_rejects(spark, sf):
    """Daily consumption with the number of active records left out of it."""
    days = intervals.daily_consumption(_in_small_units(spark, sf), rejects=True)
    return days.withColumn("consumption", C.plain(F.col("consumption"), -6))


def reject_counts(spark, sf):
    return intervals.reject_counts(_in_small_units(spark, sf), ["num_a", "num_b"])


def daily_by_class(spark, sf):
    return _plain(intervals.daily_by_class(testtables.billing_dedup(spark, sf)))


def active_on_dates(spark, sf):
    b = testtables.billing_dedup(spark, sf)
    firsts = b.select(F.trunc("start_d", "month").alias("d")).distinct()
    rate = C.daily_rate(F.col("consumption"), F.col("start_d"), F.col("end_d"))
    return (
        intervals.active_on(b.withColumn("rate", rate), firsts)
        .groupBy("d", "rate_class")
        .agg(F.count(F.lit(1)).alias("n"), C.plain(F.sum("rate")).alias("consumption"))
    )


def daily_numeric_context(spark, sf):
    c = intervals.numeric_context(testtables.billing_dedup(spark, sf), ["num_a", "num_b"])
    return c.select("d", "n", *[F.round(x, 9).alias(x) for x in ("num_a_avg", "num_a_std", "num_b_avg", "num_b_std")])


def daily_context(spark, sf):
    """All non-categorical columns of the daily table by class, one pass over the records."""
    b = testtables.billing_dedup(spark, sf).withColumn("flag", C.flag_number(F.col("flag_raw")))
    c = intervals.daily_context(b, ["num_a", "num_b"], ["flag"], ["rate_class"])
    cols = ("num_a_avg", "num_a_std", "num_b_avg", "num_b_std", "flag")
    return _plain(c).filter("n > 0").select("rate_class", "d", "n", "consumption", *[F.round(x, 9).alias(x) for x in cols])


# The categories of the supplied tables.
WIDE = {"cat_a": ["F", "O"], "cat_b": ["1.URGENT", "2.HIGH", "3.MEDIUM", "4.NOT SPECIFIED", "5.LOW"]}


def _wide_days(spark, sf):
    b = testtables.billing_dedup(spark, sf).withColumn("flag", C.flag_number(F.col("flag_raw")))
    b = b.withColumn("cat_b", F.replace("cat_b", F.lit("-"), F.lit(".")))
    days = intervals.daily_wide(b, ["num_a", "num_b"], ["flag"], ["cat_a", "cat_b"], ["rate_class"])
    return intervals.closed_horizon(days, ["rate_class"])


def daily_wide(spark, sf):
    """The whole daily table by class, empty days with zeros: figures and a column per category value, dots included."""
    days = _wide_days(spark, sf).withColumn("n_values", F.size(F.map_keys("shares.cat_b")))
    wide = intervals.widened(days, WIDE)
    figures = ["num_a_avg", "num_a_std", "num_b_avg", "num_b_std", "flag", *[f"{f}_{v}" for f, vs in WIDE.items() for v in vs]]
    return wide.select(
        "rate_class", "d", "n", C.plain(F.col("consumption")).alias("consumption"), "n_values",
        *[F.round(F.col(f"`{c}`"), 9).alias(c) for c in figures],
    )


def value_dictionary(spark, sf):
    """Category values of the days up to 1995, then those that later days add behind them."""
    days = _wide_days(spark, sf)
    early = days.filter("d < '1996-01-01'")
    return intervals.value_dictionary(days, intervals.value_dictionary(early), version=2)


REVISED = ["rate_class", "start_d", "end_d", "consumption", "num_a", "num_b", "flag"]


def refresh_daily(spark, sf):
    """Daily figures of an older load, brought to the present one by its changes: records gone, new and revised, of any age."""
    new = testtables.billing_dedup(spark, sf).withColumn("flag", C.flag_number(F.col("flag_raw")))
    before = F.when(F.col("l_orderkey") % 10 == 0, 2 * F.col("consumption")).otherwise(F.col("consumption"))
    old = new.filter("l_linenumber <> 3").withColumn("consumption", before.cast("decimal(18,2)"))
    gone = new.filter("l_orderkey % 7 = 0").withColumn("end_d", F.date_add("end_d", 400))
    old = old.unionByName(gone)
    numeric, flags, by = ["num_a", "num_b"], ["flag"], ["rate_class"]
    state = intervals.daily_sums(old, numeric, flags, by)
    delta = intervals.daily_sums(revisions.changes(old, new, REVISED), numeric, flags, by, sign=F.col("sign"))
    sums = revisions.merged(state, revisions.touched(delta, [*by, "d"]), [*by, "d"])
    days = intervals.context_of(revisions.horizon(sums, by), numeric, flags, by)
    cols = ("num_a_avg", "num_a_std", "num_b_avg", "num_b_std", "flag")
    return _plain(days).filter("n > 0").select("rate_class", "d", "n", "consumption", *[F.round(x, 9).alias(x) for x in cols])


def daily_boolean_share(spark, sf):
    b = testtables.billing_dedup(spark, sf).withColumn("flag", C.flag_number(F.col("flag_raw")))
    return intervals.boolean_share(b, ["flag"]).select("d", "n", F.round("flag", 9).alias("flag"))


def daily_category_fraction(spark, sf):
    f = intervals.category_fractions(testtables.billing_dedup(spark, sf), ["rate_class", "cat_a", "cat_b"])
    return f.select("d", "feature", "value", "n", F.round("fraction", 9).alias("fraction"))


def daily_spine(spark, sf):
    """Per class: every day of the horizon, also days without a record."""
    days = intervals.daily_consumption(
        testtables.billing_dedup(spark, sf), ["rate_class", "cat_b"], spine=True
    )
    return _plain(intervals.closed_horizon(days, ["rate_class", "cat_b"]))


def gap_removal(spark, sf):
    days = intervals.daily_consumption(testtables.billing_dedup(spark, sf), ["rate_class"])
    return _plain(series.drop_ranges(days, MISSING_RANGES, "d"))


def trim_series(spark, sf):
    days = intervals.daily_consumption(testtables.billing_dedup(spark, sf), ["rate_class"])
    return _plain(series.trim(days, START_TRIM, END_TRIM, ["rate_class"], "d"))


def incremental_daily(spark, sf):
    """Old table up to the look-back cut, recomputed days after it, end-trimmed."""
    new = testtables.billing_dedup(spark, sf)
    loaded = F.col("start_d") < F.lit(LATE_LOAD).cast("date")
    old = new.filter(loaded)
    # Copies do not change the latest start, so the cut needs no deduplication.
    cut = series.look_back_cut(testtables.billing(spark, sf).filter(loaded), "start_d", LOOK_BACK)
    old_daily = intervals.daily_consumption(old, spine=True)
    new_daily = intervals.closed_horizon(intervals.daily_consumption(new, spine=True, first_day=cut))
    merged = series.replace_tail(old_daily, new_daily, cut, "d")
    return _plain(series.trim(merged, 0, END_TRIM, [], "d"))


CONSUMPTION_SQL = f"""WITH {DAYS}
SELECT d, count(*) AS n, CAST(sum(rate) AS DOUBLE) AS consumption FROM days GROUP BY d"""

SPINE_SQL = f"""WITH {DAYS},
daily AS (SELECT rate_class, cat_b, d, count(*) AS n, sum(rate) AS c FROM days GROUP BY ALL),
reach AS (SELECT rate_class, cat_b, min(start_d) AS a, max(end_d) - 1 AS z FROM dedup GROUP BY rate_class, cat_b),
spine AS (SELECT rate_class, cat_b, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(z AS TIMESTAMP),
            INTERVAL 1 DAY)) AS DATE) AS d FROM reach)
SELECT rate_class, cat_b, d, coalesce(n, 0) AS n, CAST(coalesce(c, 0) AS DOUBLE) AS consumption
FROM spine LEFT JOIN daily USING (rate_class, cat_b, d)"""

INCREMENTAL_SQL = f"""WITH {DAYS},
cut AS (SELECT max(start_d) - {LOOK_BACK} AS c FROM dedup WHERE start_d < DATE '{LATE_LOAD}'),
older AS (SELECT d, count(*) AS n, sum(rate) AS x FROM days, cut
          WHERE start_d < DATE '{LATE_LOAD}' AND d < c GROUP BY d),
newer AS (SELECT d, count(*) AS n, sum(rate) AS x FROM days, cut WHERE d >= c
          AND d < (SELECT max(end_d) FROM dedup) GROUP BY d),
u AS (SELECT * FROM older UNION ALL SELECT * FROM newer)
SELECT d, n, CAST(x AS DOUBLE) AS consumption
FROM (SELECT *, row_number() OVER (ORDER BY d DESC) AS r FROM u) WHERE r > {END_TRIM}"""

QUERIES = {
    "daily_consumption": daily_consumption,
    "daily_consumption_explode": daily_consumption_explode,
    "daily_by_class": daily_by_class,
    "daily_rejects": daily_rejects,
    "reject_counts": reject_counts,
    "active_on_dates": active_on_dates,
    "daily_numeric_context": daily_numeric_context,
    "daily_context": daily_context,
    "daily_wide": daily_wide,
    "value_dictionary": value_dictionary,
    "refresh_daily": refresh_daily,
    "daily_boolean_share": daily_boolean_share,
    "daily_category_fraction": daily_category_fraction,
    "daily_spine": daily_spine,
    "gap_removal": gap_removal,
    "trim_series": trim_series,
    "incremental_daily": incremental_daily,
}

CONTEXT_SQL = f"""WITH {DAYS}
SELECT rate_class, d, count(*) AS n, CAST(sum(rate) AS DOUBLE) AS consumption,
       round(CAST(sum(CAST(num_a AS DECIMAL(18,6))) AS DOUBLE) / count(*), 9) AS num_a_avg, round(stddev_samp(num_a), 9) AS num_a_std,
       round(CAST(sum(CAST(num_b AS DECIMAL(18,6))) AS DOUBLE) / count(*), 9) AS num_b_avg, round(stddev_samp(num_b), 9) AS num_b_std,
       round(avg(CASE WHEN flag_raw = 'X' THEN 1.0 ELSE 0.0 END), 9) AS flag FROM days GROUP BY rate_class, d"""

_SHARES = ", ".join(
    f"""coalesce(round(CAST(count(*) FILTER ({f} = '{v}') AS DOUBLE) / count(*), 9), 0) AS "{f}_{v}\""""
    for f, vs in WIDE.items()
    for v in vs
)
_DOTTED = DAYS.replace("o_orderpriority AS cat_b", "replace(o_orderpriority, '-', '.') AS cat_b")

WIDE_SQL = f"""WITH {_DOTTED},
daily AS (SELECT rate_class, d, count(*) AS n, CAST(sum(rate) AS DOUBLE) AS consumption, count(DISTINCT cat_b) AS n_values,
  round(CAST(sum(CAST(num_a AS DECIMAL(18,6))) AS DOUBLE) / count(*), 9) AS num_a_avg, round(stddev_samp(num_a), 9) AS num_a_std,
  round(CAST(sum(CAST(num_b AS DECIMAL(18,6))) AS DOUBLE) / count(*), 9) AS num_b_avg, round(stddev_samp(num_b), 9) AS num_b_std,
  round(avg(CASE WHEN flag_raw = 'X' THEN 1.0 ELSE 0.0 END), 9) AS flag, {_SHARES} FROM days GROUP BY rate_class, d),
reach AS (SELECT rate_class, min(start_d) AS a, max(end_d) - 1 AS z FROM dedup GROUP BY rate_class),
spine AS (SELECT rate_class, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(z AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d FROM reach)
SELECT rate_class, d, coalesce(n, 0) AS n, coalesce(consumption, 0) AS consumption, CAST(coalesce(n_values, 0) AS INTEGER) AS n_values,
  num_a_avg, num_a_std, num_b_avg, num_b_std, flag, {', '.join(f'coalesce("{f}_{v}", 0) AS "{f}_{v}"' for f, vs in WIDE.items() for v in vs)}
FROM spine LEFT JOIN daily USING (rate_class, d)"""

DICTIONARY_SQL = f"""WITH {_DOTTED},
reach AS (SELECT rate_class, max(end_d) AS z FROM dedup GROUP BY rate_class),
seen AS (SELECT feature, value, min(d) < DATE '1996-01-01' AS early FROM (
    SELECT 'cat_a' AS feature, cat_a AS value, d, rate_class FROM days UNION ALL SELECT 'cat_b', cat_b, d, rate_class FROM days)
  JOIN reach USING (rate_class) WHERE d < z GROUP BY ALL)
SELECT feature, value, CAST(row_number() OVER (PARTITION BY feature ORDER BY early DESC, value) - 1 AS INTEGER) AS position,
  CASE WHEN early THEN 1 ELSE 2 END AS version FROM seen"""

# A quantity of as many units as the interval has days is a rate of 1e12, the first that does not fit.
REJECTS_SQL = f"""WITH {DEDUP},
r AS (SELECT *, date_diff('day', start_d, end_d) + 1 AS len FROM dedup),
e AS (SELECT CAST(unnest(generate_series(CAST(start_d AS TIMESTAMP), CAST(end_d AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d,
        consumption >= len AS lost, CAST(consumption * 100 AS HUGEINT) * 10000000000000000 // len AS millionths FROM r)"""

ORACLES = {
    "daily_rejects": f"""{REJECTS_SQL}
SELECT d, count(*) AS n, round(CAST(coalesce(sum(millionths) FILTER (NOT lost), 0) AS DOUBLE) / 1e6, -6) AS consumption, count(*) FILTER (lost) AS n_rejected
FROM e GROUP BY d""",
    "reject_counts": f"""WITH {DEDUP}
SELECT count(*) AS n_rows, 0 AS no_interval, count(*) FILTER (consumption >= date_diff('day', start_d, end_d) + 1) AS consumption_rejected,
       count(*) FILTER (num_a > 0.05) AS num_a_rejected, 0 AS num_b_rejected FROM dedup""",
    "daily_wide": WIDE_SQL,
    "value_dictionary": DICTIONARY_SQL,
    "daily_context": CONTEXT_SQL,
    "refresh_daily": CONTEXT_SQL,
    "daily_consumption": CONSUMPTION_SQL,
    "daily_consumption_explode": CONSUMPTION_SQL,
    "daily_by_class": f"""WITH {DAYS}
SELECT coalesce(rate_class, 'ALL') AS rate_class, d, count(*) AS n, CAST(sum(rate) AS DOUBLE) AS consumption
FROM days GROUP BY GROUPING SETS ((rate_class, d), (d))""",
    "active_on_dates": f"""WITH {DEDUP},
firsts AS (SELECT DISTINCT CAST(date_trunc('month', start_d) AS DATE) AS d FROM dedup)
SELECT d, rate_class, count(*) AS n,
       CAST(sum(CAST(consumption / (date_diff('day', start_d, end_d) + 1) AS DECIMAL(18,6))) AS DOUBLE) AS consumption
FROM dedup JOIN firsts ON d BETWEEN start_d AND end_d GROUP BY d, rate_class""",
    "daily_numeric_context": f"""WITH {DAYS}
SELECT d, count(*) AS n, round(CAST(sum(CAST(num_a AS DECIMAL(18,6))) AS DOUBLE) / count(*), 9) AS num_a_avg, round(stddev_samp(num_a), 9) AS num_a_std,
       round(CAST(sum(CAST(num_b AS DECIMAL(18,6))) AS DOUBLE) / count(*), 9) AS num_b_avg, round(stddev_samp(num_b), 9) AS num_b_std FROM days GROUP BY d""",
    "daily_boolean_share": f"""WITH {DAYS}
SELECT d, count(*) AS n, round(avg(CASE WHEN flag_raw = 'X' THEN 1.0 ELSE 0.0 END), 9) AS flag
FROM days GROUP BY d""",
    "daily_category_fraction": f"""WITH {DAYS},
pairs AS (SELECT d, 'rate_class' AS feature, rate_class AS value FROM days
          UNION ALL SELECT d, 'cat_a', cat_a FROM days UNION ALL SELECT d, 'cat_b', cat_b FROM days)
SELECT d, feature, value, count(*) AS n,
       round(count(*) / sum(count(*)) OVER (PARTITION BY d, feature), 9) AS fraction
FROM pairs GROUP BY d, feature, value""",
    "daily_spine": SPINE_SQL,
    "gap_removal": f"""WITH {DAYS}
SELECT rate_class, d, count(*) AS n, CAST(sum(rate) AS DOUBLE) AS consumption FROM days
WHERE NOT (d BETWEEN DATE '1997-03-01' AND DATE '1997-09-30' OR d BETWEEN DATE '1999-03-25' AND DATE '1999-05-31')
GROUP BY rate_class, d""",
    "trim_series": f"""WITH {DAYS},
t AS (SELECT rate_class, d, count(*) AS n, CAST(sum(rate) AS DOUBLE) AS consumption,
        row_number() OVER (PARTITION BY rate_class ORDER BY d) AS a,
        row_number() OVER (PARTITION BY rate_class ORDER BY d DESC) AS z FROM days GROUP BY rate_class, d)
SELECT rate_class, d, n, consumption FROM t WHERE a > {START_TRIM} AND z > {END_TRIM}""",
    "incremental_daily": INCREMENTAL_SQL,
}
