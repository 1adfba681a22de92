"""One row per account: latest attributes and monthly quantities."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usage_ts.functions.columns import QUANTITY_TYPE, RATE_TYPE

MONTHS = 12


def month_window(eval_date, m: int) -> tuple[Column, Column]:
    """First and last day of the ``m``-th month back; both ends are shared with the neighbours."""
    e = F.lit(eval_date).cast("date")
    return F.add_months(e, -(m + 1)), F.add_months(e, -m)


def monthly_share(
    start: Column, end: Column, value: Column, lo: Column, hi: Column, compat: bool
) -> Column:
    """The part of an interval's quantity that falls into [lo, hi], else null.

    Day counts exclude the last day, so a zero-length interval contributes
    null. ``compat`` takes only intervals with an end inside the month, and so
    misses one that covers the month whole; the default takes every overlap.
    """
    if compat:
        touches = start.between(lo, hi) | end.between(lo, hi)
    else:
        touches = (start <= hi) & (end >= lo)
    days = F.datediff(F.least(end, hi), F.greatest(start, lo))
    part = F.try_divide(value.try_cast(QUANTITY_TYPE) * days, F.datediff(end, start))
    return F.when(touches, part.try_cast(RATE_TYPE))


def client_profiles(
    df: DataFrame,
    eval_date: str | dt.date,
    attributes: Sequence[str],
    tie_break: Sequence[str] = (),
    account: str = "account",
    start: str = "start_d",
    end: str = "end_d",
    value: str = "consumption",
    compat: bool = False,
    prefix: str = "cons_",
) -> DataFrame:
    """Attributes as of the evaluation date and the quantity of each of the last 12 months.

    One grouping by account does all of it: twelve conditional sums and the
    latest attributes. Records meet the month windows as literals, so nothing is
    joined, multiplied or pivoted, and an account with very many records is
    reduced in every task before the shuffle.
    """
    e = F.lit(eval_date).cast("date")
    recent = df.filter(F.col(end) >= F.add_months(e, -12))
    latest = F.struct(*[F.col(c) for c in (end, start, *tie_break)])
    months = [
        F.sum(monthly_share(F.col(start), F.col(end), F.col(value), *month_window(eval_date, m), compat))
        for m in range(MONTHS)
    ]
    grouped = recent.groupBy(account).agg(
        F.max_by(F.struct(*attributes), latest).alias("_latest"),
        *[F.coalesce(q, F.lit(0)).alias(f"{prefix}{m}m_ago") for m, q in enumerate(months)],
    )
    return grouped.select(
        account,
        *[F.col(f"_latest.{a}").alias(a) for a in attributes],
        *[f"{prefix}{m}m_ago" for m in range(MONTHS)],
    )
