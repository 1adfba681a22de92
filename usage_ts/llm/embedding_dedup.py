"""Near copies among vectors of one label by an epsilon grid order join.

Equal vectors are one class with a weight. Classes are turned to the leading principal directions of all
vectors, cut into grid cells as wide as the largest distance of a linked pair, and sorted by label and cell
(a turn never lengthens a distance). The sorted sequence is joined interval by interval: first the
stretches that partitions hold, then the blocks within two stretches, then the vectors of two blocks.
At each step two intervals whose boxes are farther apart than that distance are skipped.

Defined cases: a vector that is null, empty, zero, or holds null or non-finite components, and one without
label, links with nothing; vectors of different length do not link; rows that repeat a ``vec_id`` with the
same vector count once as a partner; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usage_ts.llm.common import columns, settle
from usage_ts.llm.components import components

LEAD, BLOCK = 4, 512
_BOX = [f"{side}{k}" for side in ("lo", "hi") for k in range(LEAD)]


def _scaled(vectors: list[list[float]]) -> np.ndarray:
    """Vectors times powers of two that bring the largest component near one: exact, and squares stay finite."""
    x = np.array(vectors, float)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(vectors: list[list[float]]) -> np.ndarray:
    x = _scaled(vectors)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of products of unit vectors, as (dim, place, value); one set per task and dimension."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        by_dim: dict[int, list] = {}
        for (v,) in columns(b, "vector"):
            by_dim.setdefault(len(v), []).append(v)
        for d, vs in by_dim.items():
            u = _unit(vs)
            sums[d] = sums.get(d, 0) + u.T @ u
    for d, m in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([d] * d * d, pa.int32()), pa.array(range(d * d), pa.int32()), pa.array(m.ravel())], ["dim", "place", "value"])


def _bases(classes: DataFrame) -> dict[int, np.ndarray]:
    """Leading directions by dimension; the driver gets a number of values set by the dimension alone."""
    sums = classes.select("vector").mapInArrow(_moments, "dim int, place int, value double")
    got = sums.groupBy("dim", "place").agg(F.sum("value").alias("value")).toPandas()
    bases = {}
    for d, own in got.groupby("dim"):
        m = own.sort_values("place")["value"].to_numpy().reshape(d, d)
        lead = np.linalg.eigh(m)[1][:, ::-1][:, :LEAD]
        bases[int(d)] = np.pad(lead, ((0, 0), (0, LEAD - lead.shape[1])))
    return bases


def _ordered(classes: DataFrame, bases: dict[int, np.ndarray], width: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [(_unit([v]) @ bases[len(v)])[0] for (v,) in columns(b, "vector")]
            at = np.array(at).reshape(-1, LEAD)
            cells = np.floor(at / width).astype(np.int64)
            extra = [pa.array(list(at), pa.list_(pa.float64()))] + [pa.array(c) for c in cells.T]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], [*b.schema.names, "at", *(f"c{k}" for k in range(LEAD))])

    kinds = "node long, weight long, label long, vector array<double>, at array<double>, " + ", ".join(f"c{k} long" for k in range(LEAD))
    placed = classes.select("node", "weight", "label", "vector").mapInArrow(run, kinds)
    order = ["label", F.size("vector").alias("dim"), *(f"c{k}" for k in range(LEAD)), "node"]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive vectors of one label and dimension, with the box of their places."""
    part, number, held = TaskContext.get().partitionId(), 0, []

    def block(rows: list[tuple]) -> pa.RecordBatch:
        at = np.array([r[4] for r in rows])
        vectors = _scaled([r[3] for r in rows])
        values = [part, number, rows[0][2], len(rows[0][3]), *at.min(axis=0), *at.max(axis=0)]
        packed = [np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), vectors]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32()] + [pa.float64()] * (2 * LEAD)
        cols = [pa.array([v], k) for v, k in zip(values, kinds, strict=True)] + [pa.array([p.tobytes()], pa.binary()) for p in packed]
        return pa.RecordBatch.from_arrays(cols, ["part", "block", "label", "dim", *_BOX, "nodes", "weights", "vectors"])

    for b in batches:
        for row in columns(b, "node", "weight", "label", "vector", "at"):
            if held and (len(held) == BLOCK or row[2] != held[0][2] or len(row[3]) != len(held[0][3])):
                yield block(held)
                held, number = [], number + 1
            held.append(row)
    if held:
        yield block(held)


def _near(width: float) -> Column:
    """Whether two boxes, of aliases a and b, may hold a pair within the width."""
    gaps = [F.greatest(F.lit(0.0), F.col(f"a.lo{k}") - F.col(f"b.hi{k}"), F.col(f"b.lo{k}") - F.col(f"a.hi{k}")) for k in range(LEAD)]
    return sum((g * g for g in gaps), F.lit(0.0)) <= width * width


def _links(threshold: float):
    """Links of each node (``v`` null) and edges that connect what two blocks link (``links`` 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            names = ("same", "dim", "a_nodes", "a_weights", "a_vectors", "b_nodes", "b_weights", "b_vectors")
            for same, dim, an, aw, av, bn, bw, bv in columns(batch, *names):
                ids_a, ids_b = np.frombuffer(an, np.int64), np.frombuffer(bn, np.int64)
                x, y = np.frombuffer(av).reshape(-1, dim), np.frombuffer(bv).reshape(-1, dim)
                norms = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :]
                near = x @ y.T / norms >= threshold
                if same:
                    np.fill_diagonal(near, False)
                if not near.any():
                    continue
                for ids, counts in ((ids_a, near @ np.frombuffer(bw, np.int64)), (ids_b, np.frombuffer(aw, np.int64) @ near)):
                    hit = np.flatnonzero(counts)
                    out[0] += ids[hit].tolist()
                    out[1] += [None] * len(hit)
                    out[2] += counts[hit].tolist()
                    if same:
                        break
                n = len(ids_a) + len(ids_b)
                la, lb, before = np.arange(len(ids_a)), np.arange(len(ids_a), n), -1
                if same:
                    lb = la.copy()
                while before != (before := int(la.sum() + lb.sum())):
                    la = np.minimum(la, np.where(near, lb[None, :], n).min(axis=1))
                    lb = np.minimum(lb, np.where(near, la[:, None], n).min(axis=0))
                    if same:
                        la = lb = np.minimum(la, lb)
                ids = np.concatenate([ids_a, ids_b])
                for own, low in ((ids_a, la),) if same else ((ids_a, la), (ids_b, lb)):
                    hit = np.flatnonzero(own != ids[low])
                    out[0] += own[hit].tolist()
                    out[1] += ids[low[hit]].tolist()
                    out[2] += [0] * len(hit)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["u", "v", "links"])

    return run


def near_duplicates(embeddings: DataFrame, threshold: float = 0.98) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``."""
    # Unit vectors with this cosine are so far apart; a little more covers rounding.
    width = math.sqrt(2 - 2 * threshold) + 1e-9
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = finite & F.exists(v, lambda x: x != 0) & F.col("label").isNotNull()
    rows = embeddings.select(
        F.col("vec_id").cast("long"), F.col("label").cast("long"), F.when(usable, v).alias("vector")
    )
    classes = rows.where("vector IS NOT NULL AND vec_id IS NOT NULL").distinct().groupBy("label", "vector")
    classes = settle(classes.agg(F.min("vec_id").alias("node"), F.count("*").alias("weight")), "classes")
    kinds = "part int, block int, label long, dim int, " + ", ".join(f"{c} double" for c in _BOX) + ", nodes binary, weights binary, vectors binary"
    blocks = settle(_ordered(classes, _bases(classes), width).mapInArrow(_blocks, kinds), "blocks")
    boxes = blocks.select("part", "block", "label", "dim", *_BOX)
    side = lambda c: F.min(c) if c.startswith("lo") else F.max(c)
    parts = settle(boxes.groupBy("part", "label", "dim").agg(*(side(c).alias(c) for c in _BOX)), "stretches")
    same = lambda *cs: [F.col(f"a.{c}") == F.col(f"b.{c}") for c in cs]
    on = lambda *conds: reduce(Column.__and__, conds)
    pairs = parts.alias("a").join(parts.alias("b"), on(*same("label", "dim"), F.col("a.part") <= F.col("b.part"), _near(width)))
    pairs = settle(pairs.select(F.col("a.label").alias("label"), F.col("a.dim").alias("dim"), F.col("a.part").alias("pa"), F.col("b.part").alias("pb")), "pairs")
    one = pairs.join(boxes.withColumnRenamed("part", "pa"), ["pa", "label", "dim"]).alias("a")
    later = (F.col("a.pa") < F.col("a.pb")) | (F.col("a.block") <= F.col("b.block"))
    near = one.join(boxes.alias("b"), on(F.col("a.pb") == F.col("b.part"), *same("label", "dim"), later, _near(width)))
    near = settle(near.select("a.pa", F.col("a.block").alias("ba"), "a.pb", F.col("b.block").alias("bb")), "near")
    load = lambda p, b, x: blocks.select(
        F.col("part").alias(p), F.col("block").alias(b), F.col("dim").alias(f"{x}_dim"), *(F.col(c).alias(f"{x}_{c}") for c in ("nodes", "weights", "vectors"))
    )
    loaded = near.join(load("pa", "ba", "a"), ["pa", "ba"]).join(load("pb", "bb", "b"), ["pb", "bb"])
    loaded = loaded.withColumn("same", F.expr("pa = pb AND ba = bb")).withColumnRenamed("a_dim", "dim")
    loaded = loaded.select("same", "dim", "a_nodes", "a_weights", "a_vectors", "b_nodes", "b_weights", "b_vectors")
    found = settle(loaded.mapInArrow(_links(threshold), "u long, v long, links long"), "links")
    counts = found.where("v IS NULL").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    roots = settle(components(found.where("v IS NOT NULL").select("u", "v")), "roots")
    known = classes.join(counts, "node", "left").join(roots, "node", "left").select(
        "label", "vector", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("root", "node").alias("root")
    )
    known = settle(known, "known")
    component = F.coalesce("root", "vec_id")
    return rows.join(known, ["label", "vector"], "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")
    )
