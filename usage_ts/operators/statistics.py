"""The tables behind the descriptive charts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usage_ts.functions.columns import filled_category
from usage_ts.functions.quantiles import exact_quantiles

# Fixed value: whiskers reach 1.5 interquartile ranges beyond the quartiles.
WHISKER = 1.5


def stacked(df: DataFrame, features: Sequence[str], kind: str, keep: Sequence[str] = ()) -> DataFrame:
    """(``keep``, feature, value) for every listed column."""
    cells = [F.struct(F.lit(f).alias("feature"), F.col(f).cast(kind).alias("value")) for f in features]
    return df.select(*keep, F.inline(F.array(*cells)))


def correlation_matrix(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair below the diagonal, in one aggregation, long form."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[:i]]
    row = df.agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    cells = [
        F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"{i}").alias("corr"))
        for i, (a, b) in enumerate(pairs)
    ]
    return row.select(F.inline(F.array(*cells)))


def feature_stats(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Count, mean, median and sample deviation of each numeric feature."""
    long = stacked(df, features, "double")
    moments = long.groupBy("feature").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")
    )
    medians = exact_quantiles(long, ["feature"], "value", [0.5])
    return moments.join(medians.select("feature", F.col("quantile").alias("median")), "feature", "left")


def category_counts(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Count of every value of every categorical feature, the mode marked (smaller value on a tie)."""
    counts = stacked(df, features, "string").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    modes = counts.groupBy("feature").agg(
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("_mode")
    )
    return counts.join(modes, "feature").select(
        "feature", "value", "n", F.col("value").eqNullSafe(F.col("_mode")).alias("is_mode")
    )


def box_stats(df: DataFrame, features: Sequence[str], value: str) -> DataFrame:
    """Quartiles and whisker ends of ``value`` for every value of every categorical feature.

    A whisker ends at the last point within 1.5 interquartile ranges of its quartile.
    """
    long = stacked(df, features, "string", [value]).withColumnRenamed("value", "category")
    long = long.select(
        "feature", filled_category(F.col("category")).alias("category"), F.col(value).cast("double").alias("_x")
    )
    by = ["feature", "category"]
    q = exact_quantiles(long, by, "_x", [0.25, 0.5, 0.75])
    box = q.groupBy(*by).agg(
        *[F.max(F.when(F.col("p") == p, F.col("quantile"))).alias(n) for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    )
    fence = (F.col("q3") - F.col("q1")) * WHISKER
    inside = F.col("_x").between(F.col("q1") - fence, F.col("q3") + fence)
    return (
        long.join(box, by)
        .groupBy(*by, "q1", "median", "q3")
        .agg(
            F.count("_x").alias("n"),
            F.min(F.when(inside, F.col("_x"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("_x"))).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
        )
    )


def histogram(df: DataFrame, by: Sequence[str], value: str, lo: float, width: float) -> DataFrame:
    """Count of values per bin; bin i covers [lo + i * width, lo + (i + 1) * width)."""
    bin_no = F.floor((F.col(value) - F.lit(float(lo))) / F.lit(float(width))).alias("bin")
    return df.filter(F.col(value).isNotNull()).groupBy(*by, bin_no).agg(F.count(F.lit(1)).alias("n"))


def feature_histograms(df: DataFrame, features: Sequence[str], bins: int = 30) -> DataFrame:
    """A19 for many features: (feature, bin, lo, width, n), equal bins between the extremes of each.

    Two passes: the extremes come back as one row, then all features are counted
    together. The greatest value falls into the last bin; a constant feature has one bin.
    """
    ends = df.agg(
        *[F.min(f).cast("double").alias(f"lo_{f}") for f in features],
        *[F.max(f).cast("double").alias(f"hi_{f}") for f in features],
    ).first()
    cells = []
    for f in features:
        if ends[f"lo_{f}"] is None:
            continue
        lo, width = ends[f"lo_{f}"], (ends[f"hi_{f}"] - ends[f"lo_{f}"]) / bins
        place = F.least(F.floor((F.col(f) - lo) / width), F.lit(bins - 1)) if width > 0 else F.lit(0)
        cells.append(
            F.struct(
                F.lit(f).alias("feature"),
                F.when(F.col(f).isNotNull(), place.cast("bigint")).alias("bin"),
                F.lit(lo).alias("lo"),
                F.lit(width).alias("width"),
            )
        )
    if not cells:
        raise ValueError("no feature has a value")
    return (
        df.select(F.inline(F.array(*cells)))
        .filter(F.col("bin").isNotNull())
        .groupBy("feature", "bin", "lo", "width")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def density(
    bins: DataFrame, by: Sequence[str], lo: float, width: float, bandwidth: float, margin: float = 4.0
) -> DataFrame:
    """Gaussian density at the bin centres from a histogram.

    The grid reaches ``margin`` bandwidths beyond a group's first and last bin, and
    every bin counts at every place of it: work grows with the square of the number
    of bins, not with the values.
    """
    span = math.ceil(margin * bandwidth / width)
    places = F.sequence(F.min("bin") - span, F.max("bin") + span).alias("_grid")
    groups = bins.groupBy(*by).agg(places, F.sum("n").alias("_total"), F.collect_list(F.struct("bin", "n")).alias("_bins"))
    u = lambda at, b: (at - b["bin"]) * (width / bandwidth)
    at = groups.select(*by, F.explode("_grid").alias("at"), "_total", "_bins")
    kernel = F.aggregate("_bins", F.lit(0.0), lambda k, b: k + b["n"] * F.exp(u(F.col("at"), b) * u(F.col("at"), b) * -0.5))
    norm = bandwidth * math.sqrt(2 * math.pi)
    return at.select(
        *by,
        ((F.col("at") + 0.5) * width + lo).alias("x"),
        (kernel / (F.col("_total") * norm)).alias("density"),
    )
