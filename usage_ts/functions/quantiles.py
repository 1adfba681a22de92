"""Exact quantiles of groups too large for one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STRETCHES = 32


def exact_quantiles(
    df: DataFrame, by: Sequence[str], value: str, probabilities: Sequence[float], stretches: int = STRETCHES
) -> DataFrame:
    """(``by``, p, quantile) with linear interpolation between ranks, nulls left out.

    ``percentile`` gathers the distinct values of a group in one buffer. Here
    equal values are counted first; the counted values of a group are cut into
    stretches at approximate quantiles; a running count over the few stretches
    tells which of them hold the wanted ranks, and only those are ranked. The
    cuts decide the balance of the work, never the result.
    """
    by = list(by)
    counted = (
        df.filter(F.col(value).isNotNull())
        .select(*by, (F.col(value).cast("double") + F.lit(0.0)).alias("_v"))
        .groupBy(*by, "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    at = F.array(*[F.lit(i / stretches) for i in range(1, stretches)])
    cuts = counted.groupBy(*by).agg(F.percentile_approx("_v", at, F.lit(20 * stretches)).alias("_cuts"))
    placed = counted.join(cuts, by).withColumn("_part", F.expr("size(filter(_cuts, c -> c < _v))")).drop("_cuts")
    # One row per group: its stretches with the count before each, and the two ranks (from 0) around each quantile.
    sizes = placed.groupBy(*by, "_part").agg(F.sum("_n").alias("_in"))
    groups = sizes.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("_part", "_in"))).alias("_parts"), (F.sum("_in") - 1).alias("_last")
    )
    spans = """transform(_parts, (x, i) -> named_struct('part', x._part, 'n', x._in,
        'before', aggregate(slice(_parts, 1, i), 0L, (s, y) -> s + y._in)))"""
    wanted = f"array({', '.join(f'{float(p)!r}D' for p in probabilities)})"
    ends = f"""flatten(transform({wanted}, p -> transform(array(floor(p * _last), ceil(p * _last)),
        r -> named_struct('p', p, 'weight', p * _last - floor(p * _last), 'rank', r))))"""
    groups = groups.select(*by, F.expr(spans).alias("_spans"), F.expr(ends).alias("_ends"))
    near = (
        placed.join(groups, by)
        .withColumn("_span", F.expr("filter(_spans, s -> s.part = _part)[0]"))
        .withColumn(
            "_mine", F.expr("filter(_ends, e -> e.rank >= _span.before AND e.rank < _span.before + _span.n)")
        )
        .filter(F.size("_mine") > 0)
        .select(*by, "_part", "_v", "_n", "_mine", F.col("_span.before").alias("_before"))
    )
    inside = Window.partitionBy(*by, "_part").orderBy("_v")
    hits = near.withColumn("_hi", F.col("_before") + F.sum("_n").over(inside)).select(
        *by, "_v", F.inline(F.expr("filter(_mine, e -> e.rank >= _hi - _n AND e.rank < _hi)"))
    )
    lower, upper = F.min("_v"), F.max("_v")
    return hits.groupBy(*by, "p").agg((lower + (upper - lower) * F.max("weight")).alias("quantile"))
