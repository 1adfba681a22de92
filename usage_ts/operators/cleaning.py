"""Typed, null-free billing records and their quality counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usage_ts.functions import columns as C
from usage_ts.operators import joins


def clean_records(
    df: DataFrame,
    dates: Sequence[str] = (),
    numbers: Sequence[str] = (),
    flags: Sequence[str] = (),
    codes: Sequence[str] = (),
    categories: Sequence[str] = (),
) -> DataFrame:
    """Parse dates and numbers, recode flags, tag codes, fill absent categories.

    Column lists name the role of each column; others pass through unchanged.
    A projection only: no shuffle, no Python.
    """
    return df.withColumns(
        {c: C.lenient_date(F.col(c)) for c in dates}
        | {c: C.lenient_number(F.col(c)) for c in numbers}
        | {c: C.flag_number(F.col(c)) for c in flags}
        | {c: C.tagged_code(F.col(c)) for c in codes}
        | {c: C.filled_category(F.col(c)) for c in categories}
    )


def quality_counters(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    account: str = "account",
    start: str = "start_d",
    end: str = "end_d",
    value: str = "consumption",
) -> DataFrame:
    """Rows before and after deduplication, total, accounts, broken intervals.

    The key groups are pre-aggregated below the shuffle, so neither a key with
    many copies nor an account with many rows lands in one task whole.
    """
    survivors = df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_copies"),
        F.max_by(value, F.struct(*order)).alias("_value"),
    )
    per_account = survivors.groupBy(account).agg(
        F.sum("_copies").alias("_copies"),
        F.count(F.lit(1)).alias("_rows"),
        F.sum("_value").alias("_value"),
        F.count_if(F.col(end) < F.col(start)).alias("_broken"),
        F.count_if(F.col(start).isNull() | F.col(end).isNull()).alias("_undated"),
    )
    return per_account.agg(
        F.sum("_copies").alias("rows_read"),
        F.sum("_rows").alias("rows_kept"),
        F.count(account).alias("accounts"),
        C.plain(F.sum("_value")).alias("total_consumption"),
        F.sum("_broken").alias("broken_intervals"),
        F.sum("_undated").alias("undated_intervals"),
    )


def ordinal_codes(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, value, code), codes in sorted value order starting at 0.

    Ranking runs over the distinct values only, after they were pre-aggregated.
    """
    from pyspark.sql import Window

    values = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in features])
        ).alias("p")
    ).select("p.*").distinct()
    in_order = Window.partitionBy("feature").orderBy("value")
    return values.withColumn("code", (F.row_number().over(in_order) - 1).cast("bigint"))


def encode(df: DataFrame, codes: DataFrame, feature: str, output: str) -> DataFrame:
    """Attach the code of one feature; values unseen at fitting time get null."""
    mapping = codes.filter(F.col("feature") == feature).select(
        F.col("value").alias(feature), F.col("code").alias(output)
    )
    return joins.salted(df, mapping, [feature], "left")


def decode(df: DataFrame, codes: DataFrame, feature: str, code: str) -> DataFrame:
    """Inverse of :func:`encode`: replace a code by its value."""
    mapping = codes.filter(F.col("feature") == feature).select(
        F.col("code").alias(code), F.col("value").alias(feature)
    )
    return joins.salted(df, mapping, [code], "left").drop(code)


