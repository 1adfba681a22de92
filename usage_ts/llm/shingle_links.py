"""Links between texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Equal sets are one node. Nodes that share one of ``BANDS`` keys of ``ROWS`` minima each form rough groups:
a pair at exactly 0.8 shares none with a chance of (1 - 0.8^5)^52, about 1e-9, a closer pair with less.
Only links that the exact similarity of the whole sets confirms come out. The sets of a rough group meet
once: in one block, or in several blocks that all hold the group's first set. What is then not connected
to the group's largest part is compared with every block again, so every pair of a rough group is either
compared or connected already.

Defined cases: a text of one to four words is one shingle; null and empty texts have the empty set.
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
from usage_ts.llm.simhash import _signed, fingerprint
from usage_ts.llm.simhash import edges as fingerprint_edges

SHINGLE, SEED = 5, 42
#: Similarity of a link as a fraction.
SIMILAR = (4, 5)
BANDS, ROWS = 52, 5
#: Shingles that one block of a rough group holds on average.
BLOCK = 1_000_000
#: Texts a worker turns into sets at a time.
STEP = 500
_RNG = np.random.default_rng(SEED)
_FLIPS = _RNG.integers(0, 1 << 32, BANDS * ROWS, np.uint32)[:, None]
_FACTORS = _RNG.integers(0, 1 << 32, BANDS * ROWS, np.uint32)[:, None] | np.uint32(1)
_JOIN = _RNG.integers(0, 1 << 64, (BANDS, ROWS), np.uint64) | np.uint64(1)
_BAND = _RNG.integers(0, 1 << 64, BANDS, np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Different hashes of all groups of five words, sorted."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-SHINGLE]]).tolist()
    pieces = map(joined.__getitem__, map(slice, starts, (ends[SHINGLE - 1 :] - 1).tolist()))
    return np.unique(np.fromiter(map(xxh64_intdigest, pieces, repeat(SEED)), np.uint64, len(starts)))


def band_keys(own: np.ndarray) -> np.ndarray:
    """A key for each band; each minimum is over another order of the hashes. None for the empty set."""
    if not len(own):
        return np.zeros(0, np.int64)
    short, low = own.astype(np.uint32), np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(short), 256):
        part = short[None, at : at + 256] ^ _FLIPS
        part *= _FACTORS
        np.minimum(low, part.min(axis=1), out=low)
    return ((low.reshape(BANDS, ROWS) * _JOIN).sum(axis=1, dtype=np.uint64) + _BAND).view(np.int64)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from (b.slice(at, STEP) for at in range(0, b.num_rows, STEP))


def _node(own: np.ndarray) -> int:
    return _signed(xxh64_intdigest(own.astype("<u8").tobytes(), SEED))


def marks(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``hash`` of the text, ``fp`` (as op1), ``node`` of the set, its ``size`` and band ``keys`` of every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _steps(batches):
            sets = [shingles(t) for (t,) in columns(b, "text")]
            keys = [band_keys(own) for own in sets]
            cols = [pa.array(x, pa.int64()) for x in ([_signed(fingerprint(t)) for (t,) in columns(b, "text")], map(_node, sets), map(len, sets))]
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("hash"), *cols], ["doc_id", "hash", "fp", "node", "size", "keys"])

    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("hash"), F.col("text").cast("string"))
    return texts.mapInArrow(run, "doc_id long, hash long, fp long, node long, size long, keys array<long>")


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _steps(batches):
        sets = [shingles(t) for (t,) in columns(b, "text")]
        cols = [pa.array([_node(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["node", "body"])


def links(sets: list[np.ndarray], part: list[int], asks: list[bool]) -> list[tuple[int, int]]:
    """Positions of similar sets in different parts, one link per merge; a pair counts if one of the two asks.

    A set is compared only with sets that are not connected to it yet.
    """
    values, codes = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
    sizes = np.array([len(s) for s in sets], np.int64)
    ends = np.cumsum(sizes)
    coded = [codes[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
    part, asks = np.array(part), np.array(asks)
    seen, out = np.zeros(len(values), bool), []
    over, under = SIMILAR
    rank = np.arange(len(sets))
    for i in np.flatnonzero(asks).tolist():
        # Of two sets that both ask, the first one compares.
        rest = np.flatnonzero((part != part[i]) & (~asks | (rank > i)) & (sizes > 0))
        rest = rest[(under * np.minimum(sizes[rest], sizes[i]) >= over * np.maximum(sizes[rest], sizes[i]))]
        if not len(rest):
            continue
        seen[coded[i]] = True
        shared = np.add.reduceat(seen[np.concatenate([coded[j] for j in rest])].astype(np.int64), np.cumsum(sizes[rest]) - sizes[rest])
        seen[coded[i]] = False
        for j in rest[under * shared >= over * (sizes[rest] + sizes[i] - shared)].tolist():
            if part[j] != part[i]:
                part[part == part[j]] = part[i]
                out.append((i, j))
    return out


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Confirmed links; rows come sorted by ``root`` and ``block``."""

    def solve(rows: list[tuple]) -> list[tuple[int, int]]:
        sets = [np.frombuffer(r[5], np.uint64) for r in rows]
        return [(rows[i][2], rows[j][2]) for i, j in links(sets, [r[3] for r in rows], [r[4] for r in rows])]

    def batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], ["u", "v"])

    rows: list[tuple] = []
    for b in batches:
        found = []
        for r in columns(b, "root", "block", "node", "part", "asks", "body"):
            if rows and rows[0][:2] != r[:2]:
                found += solve(rows)
                rows = []
            rows.append(r)
        yield batch(found)
    yield batch(solve(rows))


def _blocks_meet(members: DataFrame) -> DataFrame:
    met = members.select("root", "block", "node", "part", "asks", "body").repartition("root", "block")
    return settle(met.sortWithinPartitions("root", "block").mapInArrow(_confirm, "u long, v long"), "links")


def similar(marked: DataFrame, docs: DataFrame) -> DataFrame:
    """Edges ``u``, ``v`` that connect all similar nodes of ``docs``; ``marked`` are their :func:`marks`."""
    sets = settle(marked.where("size > 0").select("node", "size", "keys").dropDuplicates(["node"]), "sets")
    keys = sets.select("node", F.explode("keys").alias("key"))
    full = settle(keys.groupBy("key").agg(F.min("node").alias("v"), F.count("*").alias("n")).where("n > 1").drop("n"), "shared")
    rough = components(keys.join(full, "key").select(F.col("node").alias("u"), "v"))
    rough = settle(rough.join(sets.select("node", "size"), "node"), "rough")
    bodies = docs.select(F.col("text").cast("string")).mapInArrow(_bodies, "node long, body binary")
    # Only what a rough group needs; equal sets are reduced to one below the shuffle.
    bodies = bodies.join(rough.select("node"), "node", "left_semi").groupBy("node").agg(F.first("body").alias("body"))
    count = F.ceil(F.sum("size") / BLOCK).cast("int").alias("blocks")
    groups = settle(rough.groupBy("root").agg(count), "groups")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")
    members = rough.select("root", "node").join(groups, "root").select("*", block).join(bodies, "node")
    members = settle(members, "members")
    first = members.where("node = root").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("to"))
    first = first.where("to <> block").withColumn("block", F.col("to")).drop("to")
    out = _blocks_meet(members.unionByName(first).select("*", F.col("node").alias("part"), F.lit(True).alias("asks")))
    wide = members.where("blocks > 1")
    if wide.isEmpty():
        return out
    known = components(out).select("node", F.col("root").alias("part"))
    wide = settle(wide.join(settle(known, "known"), "node", "left").withColumn("part", F.coalesce("part", "node")), "wide")
    sizes = wide.groupBy("root", "part").agg(F.count("*").alias("n"))
    main = settle(sizes.groupBy("root").agg(F.max_by("part", F.struct("n", "part")).alias("main")), "main")
    apart = wide.join(main, "root").where("part <> main").drop("main")
    apart = apart.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("to"))
    apart = settle(apart.where("to <> block").withColumn("block", F.col("to")).drop("to"), "apart")
    again = wide.withColumn("asks", F.lit(False)).unionByName(apart.withColumn("asks", F.lit(True)))
    return out.unionByName(_blocks_meet(again))


def near_copies(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``hash`` of the text, ``node``, ``fp`` and ``root`` of every row: equal roots are near copies.

    Linked are sets of similarity 0.8 or more and, as in op1, fingerprints of at most three differing bits.
    """
    marked = settle(marks(docs), "marks")
    both = settle(marked.select("fp", "node").distinct(), "both")
    per_fp = settle(both.groupBy("fp").agg(F.min("node").alias("first")), "per_fp")
    same = both.join(per_fp, "fp").select(F.col("node").alias("u"), F.col("first").alias("v")).where("u <> v")
    close = fingerprint_edges(per_fp.select("fp")).select(F.col("u").alias("fp"), F.col("v").alias("other"))
    close = close.join(per_fp, "fp").select(F.col("first").alias("u"), F.col("other").alias("fp"))
    close = close.join(per_fp, "fp").select("u", F.col("first").alias("v"))
    roots = settle(components(same.unionByName(close).unionByName(similar(marked, docs))), "roots")
    return marked.select("doc_id", "hash", "node", "fp").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
