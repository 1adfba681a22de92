"""Language of whole texts by bit-sliced Bloom filters over letter groups.

One table holds a language mask in each slot. A group of letters is added by setting its language's bit
in every slot its hashes name; the AND of those slots gives all languages that have the group, with one
look-up for all languages. Per language the hits are counted over the whole text, corrected by the rate
of false hits that its share of set bits implies, and the largest corrected share decides.

Defined cases: null texts and texts without a letter are ``und`` with score 0; a text of which no
language has any group gets the language most documents have and score 0; equal scores go to the
language of more documents, then by name. Rows without id or language are predicted, not learned
from. If nothing can be learned, every row is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from usage_ts.llm.common import columns, held_out

GROUP = 4
#: Documents of each language to learn from: the first by a hash of the id.
SAMPLE = 1000
#: Of a language's groups the most frequent are kept until they make this share of what its documents hold; those of
#: one document alone are left out if there are so many documents.
COVERED, ENOUGH = 0.995, 20
#: A language whose groups recur less than this needs a smaller share of known groups to be accepted.
RECURRING = 0.8
#: Code points of texts that are scored together.
TOGETHER = 1 << 20
SPACE = 32


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _groups(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every letter group, whether it has a letter, and where each text begins."""
    joined = [t.lower() + " " * GROUP for t in texts]
    begin = np.cumsum([GROUP, *map(len, joined[:-1])]) - GROUP
    points = np.frombuffer((" " * (GROUP - 1) + "".join(joined)).encode("utf-32-le"), "<u4")
    letter = _letters()[points]
    points = np.where(letter, points, SPACE).astype(np.uint64)
    n = len(points) - GROUP + 1
    h, any_letter = np.zeros(n, np.uint64), np.zeros(n, bool)
    for i in range(GROUP):
        h = (h * np.uint64(0x100000001B3)) ^ points[i : i + n]
        any_letter |= letter[i : i + n]
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29)), any_letter, begin


class Filters:
    """Language masks in ``2^bits`` slots; ``names`` in order of preference when scores are equal."""

    def __init__(self, names: list[str], groups: dict[str, np.ndarray], recurring: dict[str, float] | None = None) -> None:
        self.names = names
        #: Per language, the share of a learned document's groups that others would have put into its filter.
        self.recurring = recurring or dict.fromkeys(names, 1.0)
        most = max((len(g) for g in groups.values()), default=1)
        self.slots = 1 << max(10, int(16 * most - 1).bit_length())
        self.planes = [names[i : i + 64] for i in range(0, len(names), 64)]
        self.tables, self.false_hits = [], []
        for plane in self.planes:
            kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if len(plane) <= np.dtype(k).itemsize * 8)
            table = np.zeros(self.slots, kind)
            for bit, name in enumerate(plane):
                for at in self._places(groups[name].view(np.uint64)):
                    table[at] |= kind(1 << bit)
            self.tables.append(table)
            self.false_hits += [float(((table >> kind(b)) & kind(1)).mean() ** 2) for b in range(len(plane))]

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = np.uint64(self.slots - 1)
        return (h & low).astype(np.int64), ((h >> np.uint64(32)) & low).astype(np.int64)

    def shares(self, texts: list[str]) -> np.ndarray:
        """Corrected share of groups that each language has: a row per text, a column per name."""
        h, valid, begin = _groups(texts)
        a, b = self._places(h)
        total = np.maximum(np.add.reduceat(valid.astype(np.int64), begin), 1)
        out = []
        for plane, table in zip(self.planes, self.tables, strict=True):
            mask = np.where(valid, table[a] & table[b], 0).astype(table.dtype)
            out += [np.add.reduceat((mask >> table.dtype.type(k)) & table.dtype.type(1), begin, dtype=np.int64) for k in range(len(plane))]
        hits = np.stack(out, axis=1) / total[:, None]
        false = np.array(self.false_hits)
        return np.clip((hits - false) / (1 - false), 0, 1)


def learn(docs: DataFrame) -> Filters:
    """Filters from documents that are not held out. What the driver gets is bounded by the letter groups of
    ``SAMPLE`` documents a language.
    """
    usable = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = usable.select("doc_id", "lang").withColumn("at", F.row_number().over(order)).where(F.col("at") <= SAMPLE)
    picked = usable.select("doc_id", "lang", "text").join(F.broadcast(ids.select("doc_id", "lang").distinct()), ["doc_id", "lang"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in columns(batch, "lang", "text"):
                h, valid, _ = _groups([text])
                own = np.unique(h[valid]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own)], ["lang", "grp"])

    counts = picked.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(run, "lang string, grp long")
    counts = counts.groupBy("lang", "grp").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("lang")
    best = whole.orderBy(F.desc("n"), "grp").rowsBetween(Window.unboundedPreceding, -1)
    learned = picked.groupBy(F.col("lang").cast("string").alias("lang")).agg((F.count("*") < ENOUGH).alias("few"))
    counts = counts.join(F.broadcast(learned), "lang")
    # What a document shares with the filter of the others: a group counts if it would be kept without this document.
    known = F.sum(F.when(F.expr("n > 2 OR (few AND n > 1)"), F.col("n")))
    shares = counts.groupBy("lang").agg((known / F.sum("n")).alias("share")).collect()
    recurring = {r["lang"]: r["share"] or 0.0 for r in shares}
    counts = counts.where("n > 1 OR few")
    sums = counts.withColumns({"before": F.coalesce(F.sum("n").over(best), F.lit(0)), "all": F.sum("n").over(whole)})
    found = sums.where(F.col("before") < COVERED * F.col("all")).select("lang", "grp").toPandas()
    sizes = {r["lang"]: r["n"] for r in usable.groupBy(F.col("lang").cast("string")).agg(F.count("*").alias("n")).collect()}
    names = sorted(sizes, key=lambda x: (-sizes[x], x))
    groups = {x: found.loc[found["lang"] == x, "grp"].to_numpy(np.int64) for x in names}
    return Filters(names, groups, {x: recurring.get(x, 0.0) for x in names})


def _predict(filters: Filters, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text, in groups of bounded size."""
    names, scores = ["und"] * len(texts), [0.0] * len(texts)
    at, held = [], 0

    def flush() -> None:
        if at and filters.names:
            shares = filters.shares([texts[i] for i in at])
            for i, k, s in zip(at, shares.argmax(axis=1).tolist(), shares.max(axis=1).tolist(), strict=True):
                names[i], scores[i] = filters.names[k], s
        at.clear()

    for i, t in enumerate(texts):
        if t and any(map(str.isalpha, t)):
            at.append(i)
            held += len(t)
            if held >= TOGETHER:
                flush()
                held = 0
    flush()
    return names, scores


def identify(docs: DataFrame, filters: Filters | None = None) -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score``."""
    filters = filters or learn(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = _predict(filters, b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    own = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return own.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, filters: Filters, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a language whose share is the threshold or more; all columns, no shuffle.

    The threshold is lower for a language whose learned documents have few groups in common.
    """
    need = {n: threshold * min(1.0, r / RECURRING) for n, r in filters.recurring.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = _predict(filters, b.column(b.schema.get_field_index("text")).to_pylist())
            yield b.filter(pa.array([n != "und" and s >= need[n] for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
