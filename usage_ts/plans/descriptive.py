"""Registered queries: descriptive statistics of the client table and the daily table."""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import functions as F

from usage_ts.operators import statistics
from usage_ts.plans.ingest import profiles, profiles_cte

NUMERIC = ["num_a", "num_b", *[f"cons_{m}m_ago" for m in range(12)]]
CATEGORICAL = ["rate_class", "cat_a", "cat_b", "flag_raw"]
RECENT = "cons_0m_ago"
WIDTH, BANDWIDTH = 10.0, 15.0
SPAN = math.ceil(4.0 * BANDWIDTH / WIDTH)


def correlation_matrix(spark, sf):
    c = statistics.correlation_matrix(profiles(spark, sf), NUMERIC)
    return c.withColumn("corr", F.round("corr", 6))


def feature_stats(spark, sf):
    s = statistics.feature_stats(profiles(spark, sf), NUMERIC)
    return s.select("feature", "n", *[F.round(c, p).alias(c) for c, p in (("mean", 6), ("median", 9), ("std", 6))])


def category_counts(spark, sf):
    return statistics.category_counts(profiles(spark, sf), CATEGORICAL)


def box_stats(spark, sf):
    b = statistics.box_stats(profiles(spark, sf), CATEGORICAL, RECENT)
    return b.withColumns({c: F.round(c, 9) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")})


def distribution_histogram(spark, sf):
    return statistics.histogram(profiles(spark, sf), ["rate_class"], RECENT, 0.0, WIDTH)


def feature_histograms(spark, sf):
    table = profiles(spark, sf).persist(StorageLevel.MEMORY_AND_DISK)
    h = statistics.feature_histograms(table, NUMERIC, 20)
    return h.select("feature", "bin", F.round("lo", 6).alias("lo"), F.round("width", 9).alias("width"), "n")


def distribution_density(spark, sf):
    bins = statistics.histogram(profiles(spark, sf), ["rate_class"], RECENT, 0.0, WIDTH)
    d = statistics.density(bins, ["rate_class"], 0.0, WIDTH, BANDWIDTH)
    return d.withColumn("density", F.round("density", 9))


def _union(cols, kind):
    return " UNION ALL ".join(f"SELECT account, '{c}' AS feature, CAST({c} AS {kind}) AS value FROM profiles" for c in cols)


CORR_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 6) AS corr FROM profiles"
    for i, a in enumerate(NUMERIC)
    for b in NUMERIC[:i]
)
P = profiles_cte()

QUERIES = {
    "correlation_matrix": correlation_matrix,
    "feature_stats": feature_stats,
    "category_counts": category_counts,
    "box_stats": box_stats,
    "distribution_histogram": distribution_histogram,
    "feature_histograms": feature_histograms,
    "distribution_density": distribution_density,
}

ORACLES = {
    "correlation_matrix": f"WITH {P} {CORR_SQL}",
    "feature_stats": f"""WITH {P}, u AS ({_union(NUMERIC, 'DOUBLE')})
SELECT feature, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 9) AS median,
       round(stddev_samp(value), 6) AS std FROM u GROUP BY feature""",
    "category_counts": f"""WITH {P}, u AS ({_union(CATEGORICAL, 'VARCHAR')})
SELECT feature, value, count(*) AS n, row_number() OVER (PARTITION BY feature ORDER BY count(*) DESC, value) = 1 AS is_mode
FROM u GROUP BY feature, value""",
    "box_stats": f"""WITH {P}, u AS (SELECT u.feature, u.value AS category, p.{RECENT} AS x
  FROM ({_union(CATEGORICAL, 'VARCHAR')}) u JOIN profiles p USING (account)),
q AS (SELECT feature, category, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3
  FROM u GROUP BY feature, category),
f AS (SELECT *, x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM u JOIN q USING (feature, category))
SELECT feature, category, round(q1, 9) AS q1, round(median, 9) AS median, round(q3, 9) AS q3, count(*) AS n,
       round(min(CASE WHEN inside THEN x END), 9) AS whisker_low, round(max(CASE WHEN inside THEN x END), 9) AS whisker_high,
       count(*) FILTER (WHERE NOT inside) AS outliers
FROM f GROUP BY feature, category, q1, median, q3""",
    "distribution_histogram": f"""WITH {P}
SELECT rate_class, CAST(floor({RECENT} / {WIDTH}) AS BIGINT) AS bin, count(*) AS n FROM profiles GROUP BY 1, 2""",
    "feature_histograms": f"""WITH {P}, u AS ({_union(NUMERIC, 'DOUBLE')}),
e AS (SELECT feature, min(value) AS lo, (max(value) - min(value)) / 20 AS width FROM u GROUP BY feature),
b AS (SELECT feature, lo, width, CASE WHEN width > 0 THEN least(floor((value - lo) / width), 19) ELSE 0 END AS bin
      FROM u JOIN e USING (feature))
SELECT feature, CAST(bin AS BIGINT) AS bin, round(lo, 6) AS lo, round(width, 9) AS width, count(*) AS n
FROM b GROUP BY feature, bin, lo, width""",
    "distribution_density": f"""WITH {P},
h AS (SELECT rate_class, CAST(floor({RECENT} / {WIDTH}) AS BIGINT) AS bin, count(*) AS n FROM profiles GROUP BY 1, 2),
t AS (SELECT rate_class, sum(n) AS total, unnest(range(min(bin) - {SPAN}, max(bin) + {SPAN} + 1)) AS pos FROM h GROUP BY 1),
g AS (SELECT rate_class, n, bin, pos, total FROM h JOIN t USING (rate_class))
SELECT rate_class, CAST((pos + 0.5) * {WIDTH} AS DOUBLE) AS x,
       round(sum(n * exp(-0.5 * pow((pos - bin) * {WIDTH} / {BANDWIDTH}, 2))) / (any_value(total) * {BANDWIDTH} * sqrt(2 * pi())), 9) AS density
FROM g GROUP BY rate_class, pos""",
}
