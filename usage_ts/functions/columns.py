"""Scalar expressions used by the cleaning and interval operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The raw spellings of flags in billing extracts and what they mean.
FLAG_VALUES = {"X": 1.0, "On": 1.0, "Discon": 0.0, " ": 0.0}

# Date spellings, tried in this order.
DATE_FORMATS = ("M/d/yyyy", "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss")

# Fill-ins for absent data.
MISSING_CATEGORY = "MISSING"
UNKNOWN_CATEGORY = "Unknown"

# Fixed-point types: a quantity as read, and a rate per day.
QUANTITY_TYPE = "decimal(20,6)"
RATE_TYPE = "decimal(18,6)"


def lenient_number(c: Column) -> Column:
    """Text to double, anything unreadable to 0."""
    return F.coalesce(F.trim(c).try_cast("double"), F.lit(0.0))


def lenient_date(c: Column, formats: Iterable[str] = DATE_FORMATS) -> Column:
    """First format that fits, otherwise null."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)).cast("date") for f in formats])


def flag_number(c: Column) -> Column:
    """Flag spelling to 1/0; numbers pass through, null and blank become 0."""
    known = F.lit(None).cast("double")
    for raw, value in FLAG_VALUES.items():
        known = F.when(c == raw, F.lit(value)).otherwise(known)
    return F.coalesce(known, F.trim(c).try_cast("double"), F.lit(0.0))


def tagged_code(c: Column) -> Column:
    """Force a code to text by a trailing underscore; null becomes ``nan_``."""
    return F.concat(F.coalesce(c.cast("string"), F.lit("nan")), F.lit("_"))


def filled_category(c: Column) -> Column:
    """Null category to a literal one."""
    return F.coalesce(c, F.lit(MISSING_CATEGORY))


def daily_rate(quantity: Column, start: Column, end: Column) -> Column:
    """Quantity per day over an interval whose both ends count.

    Fixed-point, so that sums are exact whatever the order of addition. A quantity
    or rate beyond the type is null, and so is left out; it does not fail the job.
    """
    return F.try_divide(quantity.try_cast(QUANTITY_TYPE), F.datediff(end, start) + 1).try_cast(RATE_TYPE)




def plain(c: Column, places: int | None = None) -> Column:
    """Fixed-point to double for output, optionally rounded; removes negative zero."""
    d = c.cast("double")
    if places is not None:
        d = F.round(d, places)
    return d + F.lit(0.0)
