"""Near copies by 64-bit similarity fingerprints and covering locality-sensitive hashing.

Every bit position gets a non-zero vector of r + 1 bits. The mask of a non-zero vector v holds the
positions whose vector has an odd product with v. For any r positions some v has even products with
all of them, so two fingerprints that differ in at most r positions are equal under that mask: every
linked pair meets in at least one of the 2^(r+1) - 1 tables, without a chance of a miss.

Defined cases: null and empty texts have fingerprint zero; repeated rows keep one row each; a null
``doc_id`` takes part in linking but never names a component, unless all members have none (null).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from usage_ts.llm.common import columns, settle
from usage_ts.llm.components import components

SEED = 42
BITS = 64
#: A bucket of at most so many different fingerprints is compared in place; larger ones are masked further.
DIRECT = 256


def fingerprint(text: str | None, shingle: int = 3) -> int:
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-shingle]]).tolist()
    pieces = map(joined.__getitem__, map(slice, starts, (ends[shingle - 1 :] - 1).tolist()))
    hashes = np.fromiter(map(xxh64_intdigest, pieces, repeat(SEED)), np.uint64, len(starts))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and signed 64-bit ``fp`` of every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [_signed(fingerprint(t)) for (t,) in columns(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def masks(positions: list[int], radius: int) -> list[int]:
    """Covering masks over the given bit positions, as signed longs."""
    vectors = (1 << (radius + 1)) - 1
    of = {p: 1 + i % vectors for i, p in enumerate(positions)}
    found = [sum(1 << p for p in positions if (of[p] & v).bit_count() & 1) for v in range(1, vectors + 1)]
    return list(dict.fromkeys(_signed(m) for m in found))


def _deeper(mask: int, radius: int) -> list[int]:
    free = [p for p in range(BITS) if not mask >> p & 1]
    return [_signed((m | mask) & (1 << BITS) - 1) for m in masks(free, radius)]


def _forest(radius: int):
    """Edges that connect what lies within the radius in one bucket; fewer than its members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            us, vs = [], []
            for (group,) in columns(b, "group"):
                if len(group) == 2:
                    x, y = group
                    if ((x ^ y) & (1 << BITS) - 1).bit_count() <= radius:
                        us.append(x), vs.append(y)
                    continue
                a = np.sort(np.array(group, np.int64))
                near = np.bitwise_count((a[:, None] ^ a[None, :]).view(np.uint64)) <= radius
                low, old = np.arange(len(a)), None
                while old is None or (low != old).any():
                    old, low = low, np.where(near, low[None, :], len(a)).min(axis=1)
                    low = low[low]
                linked = low != np.arange(len(a))
                us.extend(a[linked].tolist()), vs.extend(a[low[linked]].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return run


def edges(fps: DataFrame, radius: int = 3) -> DataFrame:
    """Edges over different fingerprints (``fp``) with the components of all pairs within the radius.

    Tables are counted with partial aggregation first. Buckets of two up to ``DIRECT`` fingerprints
    are compared in one task; members of larger ones are masked again over the bits still free, where
    the same covering argument holds. After three levels at most seven bits are free, so a bucket
    cannot exceed 128 fingerprints: no group is unbounded and none is skipped.
    """
    spark = fps.sparkSession
    tops = masks(list(range(BITS)), radius)
    members = fps.select("fp", F.explode(F.array(*map(F.lit, tops))).alias("mask"))
    level, out = tops, None
    while True:
        last = max(BITS - (m & (1 << BITS) - 1).bit_count() for m in level) <= DIRECT.bit_length() - 1
        members = members.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        full = settle(members.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
        shared = members.join(full, ["mask", "key"])
        close = (shared if last else shared.where(F.col("n") <= DIRECT)).groupBy("mask", "key")
        found = close.agg(F.collect_list("fp").alias("group")).select("group").mapInArrow(_forest(radius), "u long, v long")
        out = found if out is None else out.unionByName(found)
        if last or full.where(F.col("n") > DIRECT).isEmpty():
            return out
        below = [(m, d) for m in level for d in _deeper(m, radius)]
        # A fixed number of masks, whatever the data.
        step = F.broadcast(spark.createDataFrame(below, "mask long, below long"))
        members = shared.where(F.col("n") > DIRECT).join(step, "mask").select("fp", F.col("below").alias("mask"))
        members = settle(members, "members")
        level = [d for _, d in below]


def near_duplicates(docs: DataFrame, radius: int = 3) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``."""
    nodes = settle(fingerprints(docs), "fingerprints")
    per_fp = settle(nodes.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = settle(components(edges(per_fp.select("fp"), radius)), "roots")
    named = per_fp.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = settle(named, "members")
    lowest = settle(named.groupBy("root").agg(F.min("first").alias("component_id")), "lowest")
    label = settle(named.join(lowest, "root").select("fp", "component_id"), "labels")
    return nodes.join(label, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
