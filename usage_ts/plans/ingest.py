"""Registered queries: extracts, cleaning, deduplication, client table."""

from __future__ import annotations

from pyspark.sql import functions as F

from usage_ts.functions import columns as C
from usage_ts.operators import cleaning, clients, dedup
from usage_ts.plans.views import BILLING, DEDUP
from usage_ts.sources import extracts, testtables

EVAL_DATE = "2000-09-17"
AS_OF = "2001-12-31"
ATTRIBUTES = ["rate_class", "num_a", "num_b", "flag_raw", "cat_a", "cat_b"]
TIE = testtables.LOAD_ORDER
IDS = ["account", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def two_extracts(spark, sf):
    """Billing as two text extracts with different columns, as drifting files have."""
    b = testtables.billing(spark, sf)
    in_first = F.col("rate_class").isin("W&S_MACHINERY", "W&S_BUILDING")
    text = b.select(
        *[F.col(c).cast("string").alias(c) for c in IDS],
        "rate_class",
        F.date_format("start_d", "M/d/yyyy").alias("start_d"),
        F.date_format("end_d", "M/d/yyyy").alias("end_d"),
        F.col("consumption").cast("string").alias("consumption"),
        F.col("num_a").cast("string").alias("num_a"),
        F.col("num_b").cast("string").alias("num_b"),
        "cat_b",
    )
    first = text.filter(in_first).drop("num_b").withColumn(extracts.SOURCE, F.lit("f1"))
    second = text.filter(~in_first).drop("num_a", "cat_b").withColumn(extracts.SOURCE, F.lit("f2"))
    return [first, second]


def ingest_union(spark, sf):
    keep = [extracts.SOURCE, *IDS, "rate_class", "start_d", "end_d", "consumption", "num_a", "num_b", "cat_b"]
    rows = extracts.union_extracts(
        two_extracts(spark, sf), keep, {"num_a": "0.0", "num_b": "0.0", "cat_b": C.UNKNOWN_CATEGORY}
    )
    return cleaning.clean_records(
        rows, dates=["start_d", "end_d"], numbers=["consumption", "num_a", "num_b"]
    ).withColumns({c: F.col(c).cast("bigint") for c in IDS})


INGEST_UNION_SQL = f"""WITH {BILLING}
SELECT CASE WHEN f1 THEN 'f1' ELSE 'f2' END AS source_file, account, l_orderkey,
       CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, rate_class, start_d, end_d,
       CAST(consumption AS DOUBLE) AS consumption,
       CASE WHEN f1 THEN num_a ELSE 0.0 END AS num_a, CASE WHEN f1 THEN 0.0 ELSE num_b END AS num_b,
       CASE WHEN f1 THEN cat_b ELSE 'Unknown' END AS cat_b
FROM (SELECT *, rate_class IN ('W&S_MACHINERY', 'W&S_BUILDING') AS f1 FROM billing)"""


def rate_class_filter(spark, sf):
    rows = extracts.union_extracts(
        two_extracts(spark, sf), [extracts.SOURCE, "rate_class", "account", "start_d", "end_d", "consumption"]
    )
    modes = [
        extracts.of_rate_class(rows, "building", compat=compat).withColumn("mode", F.lit(mode))
        for mode, compat in (("strict", False), ("compat", True))
    ]
    return (
        modes[0]
        .unionByName(modes[1])
        .groupBy("mode", extracts.SOURCE, "rate_class")
        .agg(
            F.count(F.lit(1)).alias("n"),
            C.plain(F.sum(F.col("consumption").cast("decimal(18,2)"))).alias("consumption"),
        )
    )


RATE_CLASS_SQL = f"""WITH {BILLING},
src AS (SELECT *, CASE WHEN rate_class IN ('W&S_MACHINERY', 'W&S_BUILDING') THEN 'f1' ELSE 'f2' END AS source_file
        FROM billing),
has AS (SELECT source_file, max(CASE WHEN rate_class = 'W&S_BUILDING' THEN 1 ELSE 0 END) AS h FROM src GROUP BY 1),
kept AS (
  SELECT 'strict' AS mode, source_file, rate_class, consumption FROM src WHERE rate_class = 'W&S_BUILDING'
  UNION ALL
  SELECT 'compat', src.source_file, rate_class, consumption FROM src JOIN has USING (source_file)
  WHERE h = 0 OR rate_class = 'W&S_BUILDING')
SELECT mode, source_file, rate_class, count(*) AS n, CAST(sum(consumption) AS DOUBLE) AS consumption
FROM kept GROUP BY ALL"""


def clean_features(spark, sf):
    raw = testtables.billing(spark, sf).select(
        *IDS,
        F.col("l_extendedprice"),
        F.when(F.col("l_linenumber") == 5, "bad").otherwise(F.date_format("start_d", "M/d/yyyy")).alias("start_d"),
        F.when(F.col("l_linenumber") == 3, "n/a").otherwise(F.col("consumption").cast("string")).alias("consumption"),
        F.when(F.col("l_linenumber") != 2, F.col("flag_raw")).alias("flag"),
        F.when(F.col("l_linenumber") != 4, F.col("cat_a")).alias("code"),
        F.when(F.col("l_linenumber") != 6, F.col("cat_b")).alias("cat_b"),
    )
    return cleaning.clean_records(
        raw, dates=["start_d"], numbers=["consumption"], flags=["flag"], codes=["code"], categories=["cat_b"]
    )


CLEAN_SQL = f"""WITH {BILLING}
SELECT account, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
       CASE WHEN l_linenumber = 5 THEN NULL ELSE start_d END AS start_d,
       CASE WHEN l_linenumber = 3 THEN 0.0 ELSE CAST(consumption AS DOUBLE) END AS consumption,
       CASE WHEN l_linenumber = 2 OR flag_raw <> 'X' THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS flag,
       CASE WHEN l_linenumber = 4 THEN 'nan_' ELSE cat_a || '_' END AS code,
       CASE WHEN l_linenumber = 6 THEN 'MISSING' ELSE cat_b END AS cat_b
FROM billing"""


def dedup_latest(spark, sf):
    return testtables.billing_dedup(spark, sf).withColumn("consumption", C.plain(F.col("consumption")))


DEDUP_SQL = f"""WITH {DEDUP} SELECT * EXCLUDE (rn) REPLACE (CAST(consumption AS DOUBLE) AS consumption) FROM dedup"""


def merge_retention(spark, sf):
    merged = extracts.union_extracts(two_extracts(spark, sf))
    dated = cleaning.clean_records(merged, dates=["start_d", "end_d"])
    order = [F.col(c).cast("bigint") for c in TIE[:4]]
    latest = dedup.keep_last(
        dated, ["account", "start_d", "end_d"], [*order, F.coalesce("num_a", "num_b"), F.col("consumption")]
    )
    kept = extracts.within_retention(latest, "end_d", AS_OF, 5)
    return kept.select(
        F.col("account").cast("bigint").alias("account"),
        "rate_class",
        "start_d",
        "end_d",
        F.col("consumption").cast("double").alias("consumption"),
        "cat_b",
        extracts.SOURCE,
    )


MERGE_SQL = f"""WITH {BILLING},
src AS (SELECT *, rate_class IN ('W&S_MACHINERY', 'W&S_BUILDING') AS f1 FROM billing),
ranked AS (SELECT *, row_number() OVER (PARTITION BY account, start_d, end_d
    ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC,
      CAST(CASE WHEN f1 THEN num_a ELSE num_b END AS VARCHAR) DESC, CAST(consumption AS VARCHAR) DESC) AS rn FROM src)
SELECT account, rate_class, start_d, end_d, CAST(consumption AS DOUBLE) AS consumption,
       CASE WHEN f1 THEN cat_b END AS cat_b, CASE WHEN f1 THEN 'f1' ELSE 'f2' END AS source_file
FROM ranked WHERE rn = 1 AND end_d >= DATE '2001-12-31' - INTERVAL 5 YEAR"""


def ingest_quality(spark, sf):
    return cleaning.quality_counters(testtables.billing(spark, sf), testtables.BILLING_KEY, TIE)


QUALITY_SQL = f"""WITH {DEDUP}
SELECT (SELECT count(*) FROM billing) AS rows_read, count(*) AS rows_kept, count(DISTINCT account) AS accounts,
       CAST(sum(consumption) AS DOUBLE) AS total_consumption,
       count(*) FILTER (WHERE end_d < start_d) AS broken_intervals,
       count(*) FILTER (WHERE end_d IS NULL OR start_d IS NULL) AS undated_intervals
FROM dedup"""


def latest_per_account(spark, sf):
    latest = dedup.latest_per_account(testtables.billing_dedup(spark, sf), tie_break=["start_d", *TIE])
    return latest.select("account", "start_d", "end_d", *ATTRIBUTES)


LATEST_SQL = f"""WITH {DEDUP}
SELECT account, start_d, end_d, rate_class, num_a, num_b, flag_raw, cat_a, cat_b
FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY end_d DESC, start_d DESC, l_orderkey DESC,
        l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS r FROM dedup) WHERE r = 1"""


def profiles(spark, sf, compat=False):
    """Client table used by the clustering and statistics queries too."""
    months = [f"cons_{m}m_ago" for m in range(clients.MONTHS)]
    table = clients.client_profiles(
        testtables.billing_dedup(spark, sf), EVAL_DATE, ATTRIBUTES, TIE, compat=compat
    )
    return table.select("account", *ATTRIBUTES, *[C.plain(F.col(m)).alias(m) for m in months])


def client_monthly(spark, sf):
    return profiles(spark, sf)


def client_monthly_compat(spark, sf):
    return profiles(spark, sf, compat=True)


def profiles_cte(compat: bool = False) -> str:
    months = []
    for m in range(clients.MONTHS):
        lo = f"CAST(DATE '{EVAL_DATE}' - INTERVAL {m + 1} MONTH AS DATE)"
        hi = f"CAST(DATE '{EVAL_DATE}' - INTERVAL {m} MONTH AS DATE)"
        touches = (
            f"(start_d BETWEEN {lo} AND {hi} OR end_d BETWEEN {lo} AND {hi})"
            if compat
            else f"(start_d <= {hi} AND end_d >= {lo})"
        )
        months.append(
            f"""CAST(coalesce(sum(CASE WHEN {touches} THEN CAST(consumption
      * date_diff('day', greatest(start_d, {lo}), least(end_d, {hi}))
      / nullif(date_diff('day', start_d, end_d), 0) AS DECIMAL(18,6)) END), 0) AS DOUBLE) AS cons_{m}m_ago"""
        )
    return f"""{DEDUP},
recent AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY end_d DESC, start_d DESC, l_orderkey DESC,
    l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS r
  FROM dedup WHERE end_d >= DATE '{EVAL_DATE}' - INTERVAL 12 MONTH),
monthly AS (SELECT account, {', '.join(months)} FROM recent GROUP BY account),
profiles AS (SELECT m.account, rate_class, num_a, num_b, flag_raw, cat_a, cat_b, m.* EXCLUDE (account)
  FROM recent JOIN monthly m USING (account) WHERE r = 1)"""


def ordinal_encode(spark, sf):
    codes = cleaning.ordinal_codes(testtables.billing_dedup(spark, sf), ["rate_class", "cat_a", "cat_b"])
    return codes


ORDINAL_SQL = f"""WITH {DEDUP},
vals AS (SELECT 'rate_class' AS feature, rate_class AS value FROM dedup UNION SELECT 'cat_a', cat_a FROM dedup
         UNION SELECT 'cat_b', cat_b FROM dedup)
SELECT feature, value, CAST(dense_rank() OVER (PARTITION BY feature ORDER BY value) - 1 AS BIGINT) AS code FROM vals"""

QUERIES = {
    "ingest_union": ingest_union,
    "rate_class_filter": rate_class_filter,
    "clean_features": clean_features,
    "dedup_latest": dedup_latest,
    "merge_retention": merge_retention,
    "ingest_quality": ingest_quality,
    "latest_per_account": latest_per_account,
    "client_monthly": client_monthly,
    "client_monthly_compat": client_monthly_compat,
    "ordinal_encode": ordinal_encode,
}

ORACLES = {
    "ingest_union": INGEST_UNION_SQL,
    "rate_class_filter": RATE_CLASS_SQL,
    "clean_features": CLEAN_SQL,
    "dedup_latest": DEDUP_SQL,
    "merge_retention": MERGE_SQL,
    "ingest_quality": QUALITY_SQL,
    "latest_per_account": LATEST_SQL,
    "client_monthly": f"WITH {profiles_cte()} SELECT * FROM profiles",
    "client_monthly_compat": f"WITH {profiles_cte(True)} SELECT * FROM profiles",
    "ordinal_encode": ORDINAL_SQL,
}
