"""Daily sums kept up to date by what changed in the records, however old it is.

Counts and fixed-point sums of a day add up, so a record that is gone is taken back and a new one is added; a
changed record is both. Only days inside the intervals of such records are touched, and there is no margin to
guess. Means, deviations and shares are formed from the sums afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usage_ts.operators import intervals
from usage_ts.sources import store
from usage_ts.sources.lineage import shared_folder


def changes(old: DataFrame, new: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows that only one side has, or has more often: ``sign`` -1 for what is gone, 1 for what is new.

    Rows are compared in all ``columns``, nulls as equal; a row is returned as often as its numbers differ.
    """
    own = [F.col(f"`{c}`") for c in columns]
    signed = old.select(*own, F.lit(-1).alias("_n")).unionByName(new.select(*own, F.lit(1).alias("_n")))
    net = signed.groupBy(*own).agg(F.sum("_n").alias("_n")).filter("_n <> 0")
    times = F.explode(F.sequence(F.lit(1), F.abs("_n").cast("int")))
    return net.select(*own, F.signum("_n").cast("int").alias("sign"), times.alias("_time")).drop("_time")


def merged(sums: DataFrame, delta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sums with a delta added, in the types of ``sums``; keys of either side."""
    values = [c for c in sums.columns if c not in keys]
    both = sums.unionByName(delta.select(sums.columns))
    return both.groupBy(*keys).agg(*[F.sum(c).cast(sums.schema[c].dataType).alias(c) for c in values])


def touched(delta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The days of a delta on which anything changed."""
    values = [F.col(c) != 0 for c in delta.columns if c not in keys]
    return delta.filter(reduce(Column.__or__, values))


def revise_table(spark: SparkSession, path: str, delta: DataFrame, by: Sequence[str] = (), day: str = "d") -> None:
    """Add a delta to the sums below ``path`` (folders by month); months it does not touch are neither read nor written.

    The revised months are written beside the table first; what replaces the old ones is a copy, folder by folder.
    """
    keys = [*by, day]
    aside = shared_folder(spark, "delta")
    store.write_table(touched(delta, keys), aside)
    delta = store.read_table(spark, aside)
    # At most as many months as the calendar has.
    months = [r[0] for r in delta.select(F.date_format(day, "yyyy-MM")).distinct().collect()]
    if not months:
        return
    held = store.read_table(spark, path)
    month = F.date_format(day, "yyyy-MM").isin(months)
    old = held.filter(F.col("month").cast("string").isin(months)).drop("month").filter(month)
    fresh = shared_folder(spark, "months")
    store.write_table(merged(old, delta, keys), fresh)
    store.write_by_month(store.read_table(spark, fresh), path, day)


def horizon(sums: DataFrame, by: Sequence[str] = (), day: str = "d") -> DataFrame:
    """Sums of every day from the first to the last with a record of each group, empty ones as zeros."""
    group = Window.partitionBy(*by) if by else Window.partitionBy()
    busy = F.when(F.col("n") > 0, F.col(day))
    inside = sums.withColumns({"_a": F.min(busy).over(group), "_z": F.max(busy).over(group)})
    kept = inside.filter(F.col(day).between(F.col("_a"), F.col("_z"))).drop("_a", "_z")
    values = [c for c in sums.columns if c not in (*by, day)]
    return intervals.with_spine(kept, by, values, day).select(
        *by, day, *[F.col(c).cast(sums.schema[c].dataType).alias(c) for c in values]
    )
