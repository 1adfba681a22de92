"""Date features of the additive model: trend hinges and Fourier pairs (M5)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seasonal periods in days and the number of Fourier pairs of each.
SEASONS = {"yearly": (365.25, 10), "weekly": (7.0, 3)}


def scaled_time(ds: Column, first: Column, last: Column) -> Column:
    """Days since the first training day, 1.0 at the last one."""
    return F.try_divide(F.datediff(ds, first).cast("double"), F.datediff(last, first))


def hinges(t: Column, count: int, reach: float) -> list[Column]:
    """max(t - s, 0) for ``count`` changepoints evenly placed in (0, reach] of the training span."""
    return [F.greatest(t - F.lit(reach * j / count), F.lit(0.0)) for j in range(1, count + 1)]


def fourier_pairs(ds: Column, period: float, order: int) -> list[Column]:
    """sin and cos of 1..order cycles per period, phased from 1970-01-01."""
    day = F.unix_date(ds).cast("double")
    pairs = []
    for k in range(1, order + 1):
        angle = day * F.lit(2.0 * math.pi * k / period)
        pairs += [F.sin(angle), F.cos(angle)]
    return pairs
