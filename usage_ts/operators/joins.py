"""Joins of many rows to few on keys of which one value may hold most rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usage_ts.sources.lineage import shared_folder

#: Bytes of a small side that is broadcast as it is, where the session sets no limit.
BROADCAST = 10 << 20
#: Parts a hot key is dealt to when the small side is too large to broadcast.
SALTS = 64


def _same(own: Column, other: Column, null_safe: bool) -> Column:
    return own.eqNullSafe(other) if null_safe else own == other


def within_broadcast(df: DataFrame) -> bool:
    """Whether the rows of ``df``, counted, fit the session's limit for broadcasts at the width of their types."""
    limit = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", None)
    bytes_of = BROADCAST if limit is None else int(limit) if str(limit).lstrip("-").isdigit() else _bytes(str(limit))
    width = sum(64 if f.dataType.typeName() in ("string", "binary", "array", "map", "struct") else 16 for f in df.schema)
    return bytes_of > 0 and df.count() * max(width, 1) <= bytes_of


def _bytes(text: str) -> int:
    number, unit = text.rstrip("bB"), 1
    for k, letter in enumerate("kmgt", start=1):
        if number.lower().endswith(letter):
            number, unit = number[:-1], 1 << (10 * k)
    return int(number) * unit


def salted(
    df: DataFrame, few: DataFrame, keys: Sequence[str], how: str = "inner", null_safe: bool = False, salts: int = SALTS
) -> DataFrame:
    """``df`` joined to ``few`` on ``keys``: columns of ``df``, then the other columns of ``few``.

    ``few`` is written first, so that its size is known and it is computed once. Within the session's limit for
    broadcasts it is broadcast as it is. Beyond, it goes to every salt and a row takes the salt of its hash, so a shuffle deals a hot key to
    ``salts`` tasks; the copies are merged, never broadcast, as the planner's estimate does not count them.
    With ``null_safe`` a null key equals a null key. Equal rows share a salt.
    """
    rest = [c for c in few.columns if c not in keys]
    row = [F.col(f"`{c}`") for c in df.columns]
    path = shared_folder(df.sparkSession, "few")
    few.write.parquet(path)
    few = df.sparkSession.read.schema(few.schema).parquet(path)
    if within_broadcast(few):
        named = few.select(*[F.col(f"`{k}`").alias(f"_key{i}") for i, k in enumerate(keys)], *[F.col(f"`{c}`") for c in rest])
        on = reduce(Column.__and__, [_same(F.col(f"`{k}`"), F.col(f"_key{i}"), null_safe) for i, k in enumerate(keys)])
        return df.join(F.broadcast(named), on, how).select(*row, *[F.col(f"`{c}`") for c in rest])
    spread = df.withColumn("_salt", F.pmod(F.xxhash64(*row), F.lit(salts)).cast("int"))
    copies = few.select(
        *[F.col(f"`{k}`").alias(f"_key{i}") for i, k in enumerate(keys)],
        *[F.col(f"`{c}`") for c in rest],
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_part"),
    ).hint("merge")
    same = [_same(F.col(f"`{k}`"), F.col(f"_key{i}"), null_safe) for i, k in enumerate(keys)]
    on = reduce(Column.__and__, same, F.col("_salt") == F.col("_part"))
    return spread.join(copies, on, how).select(*row, *[F.col(f"`{c}`") for c in rest])
