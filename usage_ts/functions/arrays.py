"""Array expressions: dot product and element-wise scale."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    """Sum of products of two equally long arrays."""
    return total(F.zip_with(a, b, lambda x, y: x * y))


def scaled(a: Column, mean: Column, scale: Column) -> Column:
    return F.transform(a, lambda x: (x - mean) / scale)

