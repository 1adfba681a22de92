"""Quality score of whole texts by an additive model with pairwise interactions.

Each measure of a text is cut into bins. Boosting goes round the measures: a shallow tree over one
measure's bins is fitted to what the model still gets wrong and a small part of it is added to that
measure's table. Then the pairs of measures whose cells explain most of the rest get tables of their own.
A score is the logistic of the sum of one table entry per measure and per pair.

Defined cases: null and empty texts have zero measures and a score like any other; rows of ``labels``
without quality are ignored, repeated ones count once; documents without label or id are scored, not
learned from. Without labels of both kinds the score is the share of label 1 (1 if there are none).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usage_ts.llm.common import columns, held_out
from usage_ts.llm.substring_dedup import windows

#: Labelled documents to learn from (the first by a hash of the id).
SAMPLE = 20_000
BINS, COARSE, ROUNDS, RATE, PAIRS, PAIR_ROUNDS = 64, 8, 60, 0.2, 6, 20
SYMBOLS = "#*$%&|<>"
MEASURES = (
    "log_words word_length longest_word symbols bars exclamations upper digits not_ascii punctuation "
    "log_lines line_words repeated_lines unended_lines distinct_words most_common repeated_windows "
    "symbol_words space letters"
).split()


def measures(text: str | None) -> list[float]:
    """The measures of one whole text, in the order of ``MEASURES``."""
    text = text or ""
    words = text.encode().split()
    n, chars = len(words), max(len(text), 1)
    if not n:
        return [0.0] * len(MEASURES)
    lengths = np.fromiter(map(len, words), np.int64, n)
    prints = np.fromiter(map(hash, words), np.int64, n)
    _, counts = np.unique(prints, return_counts=True)
    groups = windows(prints.view(np.uint64), 5)
    again = 1 - len(np.unique(groups)) / len(groups) if len(groups) else 0.0
    lines = [x for x in text.split("\n") if x.strip()]
    raw = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    of = lambda signs: float(sum(raw[ord(c)] for c in signs))
    upper, lower, digits = float(raw[65:91].sum()), float(raw[97:123].sum()), float(raw[48:58].sum())
    symbols = of(SYMBOLS)
    return [
        math.log(n), float(lengths.mean()), math.log(int(lengths.max())), symbols / n, of("|") / n, of("!") / n,
        upper / (upper + lower + 1), digits / chars, float(raw[128:].sum()) / chars, of(".,;:?") / n,
        math.log(max(len(lines), 1)), n / max(len(lines), 1), 1 - len(set(lines)) / max(len(lines), 1),
        sum(x.rstrip()[-1] not in ".?!:;\"'" for x in lines) / max(len(lines), 1),
        len(counts) / n, float(counts.max()) / n, again, min(symbols / n, 1.0) * n / chars,
        of(" \t\n") / chars, (upper + lower) / chars,
    ]


def _tree(gradient: np.ndarray, weight: np.ndarray, depth: int) -> np.ndarray:
    """Newton steps per bin of a tree of the given depth over ordered bins."""
    out = np.zeros(len(gradient))
    parts = [(0, len(gradient))]
    g, w = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(weight)])
    gain = lambda a, b: (g[b] - g[a]) ** 2 / (w[b] - w[a] + 1.0)
    for _ in range(depth):
        cut = []
        for a, b in parts:
            at = np.arange(a + 1, b)
            best = gain(a, at) + gain(at, b) if b - a > 1 else np.zeros(0)
            if len(best) and best.max() > gain(a, b) + 1e-9:
                k = int(at[best.argmax()])
                cut += [(a, k), (k, b)]
            else:
                cut.append((a, b))
        parts = cut
    for a, b in parts:
        out[a:b] = (g[b] - g[a]) / (w[b] - w[a] + 1.0)
    return out


class Additive:
    """Tables per measure and per pair; ``score(x)`` is a sum of table entries."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.cuts, self.coarse, self.tables, self.pairs = [], [], [], []
        rate = float(y.mean()) if len(y) else 1.0
        self.fixed = None if 0 < rate < 1 else rate
        if self.fixed is not None:
            return
        self.base = math.log(rate / (1 - rate))
        quantiles = lambda v, k: np.unique(np.quantile(v, np.linspace(0, 1, k + 1)[1:-1]))
        self.cuts = [quantiles(v, BINS) for v in x.T]
        self.coarse = [quantiles(v, COARSE) for v in x.T]
        fine, rough = self._bins(x, self.cuts), self._bins(x, self.coarse)
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        margin = np.full(len(y), self.base)
        slope = lambda: (y - (p := 1 / (1 + np.exp(-margin))), p * (1 - p))
        for _ in range(ROUNDS):
            for table, bins in zip(self.tables, fine, strict=True):
                g, w = slope()
                step = RATE * _tree(np.bincount(bins, g, len(table)), np.bincount(bins, w, len(table)), 2)
                table += step
                margin += step[bins]
        g, w = slope()
        gains = []
        for a, b in combinations(range(len(fine)), 2):
            cell = rough[a] * COARSE + rough[b]
            gains.append(((np.bincount(cell, g) ** 2 / (np.bincount(cell, w) + 5.0)).sum(), a, b))
        self.pairs = [(a, b, np.zeros(COARSE * COARSE)) for _, a, b in sorted(gains, reverse=True)[:PAIRS]]
        for _ in range(PAIR_ROUNDS):
            for a, b, table in self.pairs:
                g, w = slope()
                cell = rough[a] * COARSE + rough[b]
                step = RATE * np.bincount(cell, g, len(table)) / (np.bincount(cell, w, len(table)) + 5.0)
                table += step
                margin += step[cell]

    @staticmethod
    def _bins(x: np.ndarray, cuts: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(c, v, side="right") for c, v in zip(cuts, x.T, strict=True)]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.fixed is not None:
            return np.full(len(x), self.fixed)
        margin = np.full(len(x), self.base)
        for table, bins in zip(self.tables, self._bins(x, self.cuts), strict=True):
            margin += table[bins]
        rough = self._bins(x, self.coarse)
        for a, b, table in self.pairs:
            margin += table[rough[a] * COARSE + rough[b]]
        return 1 / (1 + np.exp(-margin))


def _matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([measures(t) for t in texts], float).reshape(-1, len(MEASURES))


def learn(docs: DataFrame, labels: DataFrame) -> Additive:
    """The model from at most ``SAMPLE`` labelled documents that are not held out."""
    usable = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    picked = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = _matrix(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(list(rows), pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    # The sample's size is a parameter, so its ids may be broadcast and its measures gathered.
    own = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(picked), "doc_id")
    own = own.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"), "text")
    seen = own.mapInArrow(run, "doc_id long, quality int, x array<double>").toPandas()
    seen = seen.drop_duplicates("doc_id").sort_values("doc_id")
    x = np.stack(seen["x"]) if len(seen) else np.zeros((0, len(MEASURES)))
    return Additive(x, seen["quality"].to_numpy(float))


def score(docs: DataFrame, model: Additive, threshold: float = 0.3) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(_matrix(b.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    own = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return own.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: Additive, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose text scores the threshold or more; all columns, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            yield b.filter(pa.array(model.score(_matrix(texts)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
