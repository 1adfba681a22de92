"""One row per key, chosen by a stated total order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_last(df: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Keep the greatest row of each key by ``order``.

    ``row_number() = 1`` makes Spark put a group limit below the exchange, so a
    key with very many copies is cut to one row per task before it is shuffled.
    """
    ranked = Window.partitionBy(*key).orderBy(
        *[c.desc() if isinstance(c, Column) else F.col(c).desc() for c in order]
    )
    return df.withColumn("_rank", F.row_number().over(ranked)).filter("_rank = 1").drop("_rank")


def latest_per_account(
    df: DataFrame,
    account: str = "account",
    end: str = "end_d",
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """The record that ends last, one per account."""
    return keep_last(df, [account], [end, *tie_break])
