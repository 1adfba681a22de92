"""Removal of long passages that an earlier document has, by seed and extend.

Every window of ``span`` words holds one or more seeds: the smallest hash among its word groups of
length ``seed`` (winnowing), which depends on the window's words alone. Documents are joined on the
seeds that two or more of them have. Around such a seed a document sends the fingerprints of all windows
that chose it, which extend the seed both ways; equal fingerprints at an equal seed in neighbouring
places are a maximal repeat, and leave as one stretch of words.

Defined cases: null and empty texts have no words; a null ``doc_id`` is not smaller or larger than any
other, so such rows stay whole and remove nothing; repeated rows (equal id) do not remove each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from usage_ts.llm.common import columns, settle, words_of

SPAN, SEED = 50, 8
#: Rows of one seed that one task compares; a seed with more is salted by document and compared again.
TOGETHER = 1000
#: Odd multiplier of the polynomial over word hashes (fixed value, golden ratio in 64 bits), and its inverse.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, np.uint64)
    factors[:1] = 1
    return np.multiply.accumulate(factors)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit fingerprint of every ``width`` consecutive word hashes."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * _powers(_BASE, n), out=sums[1:])
    return _mix((sums[width:] - sums[:-width]) * _powers(_INVERSE, n - width + 1))


def chosen(hashes: np.ndarray, span: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint of each window of ``span`` words, and the seed it chooses (smallest, of equal ones any)."""
    groups = windows(hashes, seed)
    width = span - seed + 1
    if len(groups) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    # Sliding minimum: prefix and suffix minima of blocks of one width.
    pad = -len(groups) % width
    blocks = np.concatenate([groups, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(groups) - width + 1
    return windows(hashes, span), np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def _hashes(text: str | None) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def _batch(names: list[str], kinds: list[pa.DataType], cols: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def _seeds(span: int, seed: int):
    """``(seed, doc_id, body)``: the different seeds of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seeds, docs, bodies = [np.zeros(0, np.int64)], [], []
            for doc, body, text in columns(b, "doc_id", "body", "text"):
                own = np.unique(chosen(_hashes(text), span, seed)[1]).view(np.int64)
                seeds.append(own)
                docs += [doc] * len(own)
                bodies += [body] * len(own)
            yield _batch(["seed", "doc_id", "body"], [pa.int64()] * 3, [np.concatenate(seeds), docs, bodies])

    return run


def _extensions(span: int, seed: int):
    """A row for each run of windows that chose the same shared seed, with their fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "body", "seed", "salts", "first", "prints"]
        kinds = [pa.int64()] * 5 + [pa.binary()]
        for b in batches:
            rows: list[tuple] = []
            for doc, body, text, shared in columns(b, "doc_id", "body", "text", "shared"):
                prints, picks = chosen(_hashes(text), span, seed)
                if not len(picks):
                    continue
                salts = {s["seed"]: s["salts"] for s in shared}
                picks = picks.view(np.int64)
                at = np.flatnonzero(np.diff(picks)) + 1
                for lo, hi in zip([0, *at.tolist()], [*at.tolist(), len(picks)], strict=True):
                    if (s := int(picks[lo])) in salts:
                        rows.append((doc, body, s, salts[s], lo, prints[lo:hi].tobytes()))
                if len(rows) >= 20_000:
                    yield _batch(names, kinds, list(zip(*rows, strict=True)))
                    rows = []
            yield _batch(names, kinds, list(zip(*rows, strict=True)) if rows else [()] * 6)

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of seed and salt: windows that a smaller document of the same group has.

    Yields stretches (``kind`` 0: starts ``first`` to ``last``) and, of salted seeds, the windows kept here
    (``kind`` 1), which are compared again over all salts.
    """
    names = ["kind", "doc_id", "body", "first", "last", "print"]
    kinds = [pa.int8()] + [pa.int64()] * 5

    def solve(t: pa.Table) -> pa.RecordBatch:
        sizes = np.fromiter((len(p) // 8 for p in t.column("prints").to_pylist()), np.int64, t.num_rows)
        prints = np.frombuffer(b"".join(t.column("prints").to_pylist()), np.int64)
        take = lambda name: np.repeat(t.column(name).to_numpy(), sizes)
        begin = np.cumsum(sizes) - sizes
        docs, bodies, salts = take("doc_id"), take("body"), take("salts")
        start = take("first") + np.arange(len(prints)) - np.repeat(begin, sizes)
        order = np.lexsort((docs, prints))
        fresh = np.ones(len(prints), bool)
        fresh[1:] = prints[order][1:] != prints[order][:-1]
        lowest = docs[order][np.flatnonzero(fresh)][np.cumsum(fresh) - 1] if len(prints) else docs
        gone = np.zeros(len(prints), bool)
        gone[order] = docs[order] > lowest
        # Stretches of consecutive starts within one row.
        at = np.flatnonzero(gone)
        row = np.repeat(np.arange(len(sizes)), sizes)[at]
        cut = np.ones(len(at), bool)
        cut[1:] = (np.diff(at) != 1) | (np.diff(row) != 0)
        heads = np.flatnonzero(cut)
        tails = np.append(heads[1:], len(at)) - 1 if len(at) else heads
        again = np.flatnonzero(~gone & (salts > 1))
        first = np.concatenate([start[at[heads]], start[again]])
        return _batch(
            names,
            kinds,
            [
                np.concatenate([np.zeros(len(heads), np.int8), np.ones(len(again), np.int8)]),
                np.concatenate([docs[at[heads]], docs[again]]),
                np.concatenate([bodies[at[heads]], bodies[again]]),
                first,
                np.concatenate([start[at[tails]], start[again]]),
                np.concatenate([np.zeros(len(heads), np.int64), prints[again]]),
            ],
        )

    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        if sum(x.num_rows for x in held) < 10_000:
            continue
        t = pa.Table.from_batches(held)
        seeds, salt = t.column("seed").to_numpy(), t.column("salt").to_numpy()
        ends = np.flatnonzero((seeds != seeds[-1]) | (salt != salt[-1]))
        if len(ends):
            cut = int(ends[-1]) + 1
            yield solve(t.slice(0, cut))
            held = t.slice(cut).combine_chunks().to_batches()
    if held:
        yield solve(pa.Table.from_batches(held))


def _body(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("body"), F.col("text").cast("string")
    )


def repeats(docs: DataFrame, span: int = SPAN, seed: int = SEED) -> DataFrame:
    """``doc_id, body, stretches``: for each document with something to remove the stretches of window
    starts (``first``, ``last``); a window covers ``span`` words. ``body`` is the hash of the text, which
    keeps rows apart that have an id in common but not the text.
    """
    texts = _body(docs).where("doc_id IS NOT NULL AND text IS NOT NULL")
    seeds = settle(texts.mapInArrow(_seeds(span, seed), "seed long, doc_id long, body long"), "seeds")
    # A seed is shared if two ids have it; its rows tell into how many salts it is dealt.
    shared = seeds.groupBy("seed").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n"))
    shared = settle(shared.where("lo < hi").select("seed", F.ceil(F.col("n") / TOGETHER).cast("long").alias("salts")), "shared")
    # At most one entry for each seed of one text.
    per_doc = seeds.join(shared, "seed").groupBy("doc_id", "body").agg(F.collect_set(F.struct("seed", "salts")).alias("shared"))
    found = texts.join(settle(per_doc, "per-document"), ["doc_id", "body"]).mapInArrow(
        _extensions(span, seed), "doc_id long, body long, seed long, salts long, first long, prints binary"
    )
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")))
    dealt = salted.repartition(F.col("seed"), F.col("salt")).sortWithinPartitions("seed", "salt")
    compared = settle(
        dealt.mapInArrow(_compare, "kind byte, doc_id long, body long, first long, last long, print long"), "compared"
    )
    again = compared.where("kind = 1").select("doc_id", "body", "first", "print")
    lowest = settle(again.groupBy("print").agg(F.min("doc_id").alias("lowest")), "lowest")
    late = again.join(lowest, "print").where("doc_id > lowest").select("doc_id", "body", "first", F.col("first").alias("last"))
    stretches = compared.where("kind = 0").select("doc_id", "body", "first", "last").unionByName(late)
    return settle(
        stretches.groupBy("doc_id", "body").agg(F.collect_set(F.struct("first", "last")).alias("stretches")), "stretches"
    )


def gone_words(n: int, stretches: list | None, span: int) -> np.ndarray:
    """True for each of n words that a removed window covers."""
    marks = np.zeros(n + 1, np.int64)
    for s in stretches or ():
        marks[s["first"]] += 1
        marks[s["last"] + span] -= 1
    return np.cumsum(marks[:-1]) > 0


def with_stretches(docs: DataFrame, span: int = SPAN, seed: int = SEED) -> DataFrame:
    """``docs`` with ``body`` and ``stretches`` (null: nothing to remove), repeated rows included."""
    found = repeats(docs, span, seed).select(
        F.col("doc_id").alias("stretch_doc"), F.col("body").alias("stretch_body"), "stretches"
    )
    keyed = docs.withColumn("stretch_key", F.xxhash64(F.col("text").cast("string")))
    on = (F.col("doc_id") == F.col("stretch_doc")) & (F.col("stretch_key") == F.col("stretch_body"))
    return keyed.join(found, on, "left").drop("stretch_key", "stretch_doc", "stretch_body")


def remaining(docs: DataFrame, span: int = SPAN, seed: int = SEED) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed``, the ``kept`` words joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text, stretches in columns(b, "doc_id", "text", "stretches"):
                words = words_of(text)
                n = len(words)
                if stretches:
                    gone = gone_words(n, stretches, span)
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                rows.append((doc, n, n - len(words), b" ".join(words)))
            names = ["doc_id", "n_words", "n_removed", "kept"]
            yield _batch(names, [pa.int64()] * 3 + [pa.string()], list(zip(*rows, strict=True)) if rows else [()] * 4)

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return with_stretches(own, span, seed).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def cut_texts(docs: DataFrame, span: int = SPAN, seed: int = SEED) -> DataFrame:
    """``docs`` with the repeated passages cut out of ``text``; other texts stay as they are, to the byte.

    What is left keeps its own white space; a cut leaves one space between two kept parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, stretches in columns(b, "text", "stretches"):
                if text and stretches:
                    raw = np.frombuffer(text.encode(), np.uint8)
                    inside = ~np.isin(raw, np.frombuffer(b" \t\n\v\f\r", np.uint8))
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside, [0]]).astype(np.int8)))
                    gone = gone_words(len(edge) // 2, stretches, span)
                    turns = np.flatnonzero(np.diff(np.concatenate([[1], gone, [1]]).astype(np.int8)))
                    parts = [raw[edge[2 * a] : edge[2 * z - 1]].tobytes() for a, z in turns.reshape(-1, 2).tolist()]
                    text = b" ".join(parts).decode()
                out.append(text)
            at = b.schema.get_field_index("text")
            b = b.set_column(at, pa.field("text", pa.string()), pa.array(out, pa.string()))
            yield pa.RecordBatch.from_arrays([c for c, f in zip(b.columns, b.schema, strict=True) if f.name != "stretches"], schema=pa.schema([f for f in b.schema if f.name != "stretches"]))

    return with_stretches(docs, span, seed).mapInArrow(run, docs.schema)
