"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usage_ts.llm.common import settle


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node that has an edge; root is the smallest node reachable.

    ``edges`` has two long columns ``u`` and ``v``; loops, repeated edges and nulls are ignored.
    Each round links every node's neighbours to the smallest of them (first the larger ones, then
    the smaller ones), so stars flatten in a number of rounds logarithmic in the longest path.
    A node's minimum is aggregated below the shuffle and written before it is joined, so the join
    of a hot node can be split or broadcast by its measured size. The driver sees only a checksum.
    """
    current = settle(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges",
    )
    before = _checksum(current)
    while before[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = settle(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "large-star")
        large = settle(
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(),
            "large",
        )
        low = settle(large.groupBy("u").agg(F.min("v").alias("m")), "small-star")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = settle(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "small")
        after = _checksum(current)
        if after == before:
            break
        before = after
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
