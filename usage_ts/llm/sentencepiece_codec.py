"""SentencePiece encoding and decoding by suffix-array matching.

The new chunks of a batch (runs of white space with what follows; no piece reaches across their bounds)
are laid out as one text. Its suffixes are sorted by their first bytes, every piece of the vocabulary is
looked up by binary search, and the ranges found are edges from a position over a number of characters.
Edges are laid in order of position, one row for each; then each chunk is relaxed: of all neighbouring
symbols whose join is an edge, the best-scored and leftmost pair is joined, until none is left. Characters
without a piece become their bytes.

Defined cases: null and empty texts have no ids and decode to an empty text; U+2581 and the space are one
sign, as in the vocabulary, so a literal U+2581 comes back as a space; repeated rows and null ids keep one
row each.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usage_ts.llm.common import columns

#: Chunks whose ids a worker keeps; bytes of new chunks matched together; characters from which a heap is used.
KEPT, TOGETHER, LONG = 400_000, 1 << 20, 256
KEY = 16


class Codec:
    def __init__(self, path: str) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        normal = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.byte_ids = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(size) if sp.is_byte(i)}
        texts = {i: sp.id_to_piece(i).replace("▁", " ") for i in normal}
        self.surface = [b""] * size
        for i, t in texts.items():
            self.surface[i] = t.encode()
        for b, i in self.byte_ids.items():
            self.surface[i] = bytes([b])
        self.ids = np.array(normal, np.int64)
        self.raw = [self.surface[i] for i in normal]
        self.chars = np.array([len(texts[i]) for i in normal], np.int64)
        self.most = int(self.chars.max())
        self.score = np.full(size + 1, -np.inf)
        self.score[normal] = [sp.get_score(i) for i in normal]
        whole = any(" " in t.lstrip(" ") for t in texts.values())
        lines = "" if any("\n" in t for t in texts.values()) else "\n"
        self.chunk = regex.compile(r"(?s).+" if whole else rf"\n| +[^ \n]*|[^ \n]+" if lines else r" +[^ ]*|[^ ]+")
        pad = lambda p, fill: p[:KEY].ljust(KEY, fill)
        self.low = np.array([pad(p, b"\0") for p in self.raw], f"S{KEY}")
        self.high = np.array([pad(p, b"\xff") for p in self.raw], f"S{KEY}")
        self.over = np.flatnonzero(np.array([len(p) > KEY for p in self.raw]))
        self.kept: dict[str, bytes] = {}

    def edges(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Starts of characters, and a row for each with the piece over each number of characters (-1: none)."""
        raw = np.frombuffer(text + b"\xff" * KEY, np.uint8)
        own = raw[: len(text)]
        starts = np.flatnonzero(((own & 0xC0) != 0x80) & (own != 0xFF))
        keys = []
        for half in (0, 8):
            k = np.zeros(len(starts), np.uint64)
            for j in range(8):
                k = (k << np.uint64(8)) | raw[starts + half + j]
            keys.append(k)
        order = np.lexsort((keys[1], keys[0]))
        suffixes = np.stack([keys[0][order], keys[1][order]], axis=1).astype(">u8").view(f"S{KEY}").ravel()
        left = np.searchsorted(suffixes, self.low, "left")
        right = np.searchsorted(suffixes, self.high, "right")
        table = np.full((len(starts), self.most + 1), -1, np.int32)
        sizes = np.maximum(right - left, 0)
        sizes[self.over] = 0
        piece = np.repeat(np.arange(len(sizes)), sizes)
        at = order[np.arange(len(piece)) - np.repeat(np.cumsum(sizes) - sizes - left, sizes)]
        table[at, self.chars[piece]] = self.ids[piece]
        for p in self.over.tolist():
            for k in order[left[p] : right[p]].tolist():
                if text.startswith(self.raw[p], int(starts[k])):
                    table[k, self.chars[p]] = self.ids[p]
        return starts, table

    def _heap(self, row: int, n: int, table: np.ndarray) -> list[int]:
        """Lengths of the symbols of one long chunk."""
        size, left = [1] * n, list(range(-1, n - 1))
        queue: list[tuple[float, int, int, int]] = []

        def offer(a: int) -> None:
            b = a + size[a]
            if 0 <= a and b < n and (both := size[a] + size[b]) <= self.most and (p := table[row + a, both]) >= 0:
                heapq.heappush(queue, (-self.score[p], a, size[a], size[b]))

        for a in range(n - 1):
            offer(a)
        while queue:
            _, a, la, lb = heapq.heappop(queue)
            b = a + la
            if size[a] != la or b >= n or size[b] != lb:
                continue
            size[a], size[b] = la + lb, 0
            if a + size[a] < n:
                left[a + size[a]] = a
            offer(a)
            if left[a] >= 0:
                offer(left[a])
        return size

    def match(self, chunks: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each chunk."""
        text = b"\xff".join(c.encode() for c in chunks)
        starts, table = self.edges(text)
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        first = np.cumsum(lengths) - lengths
        size = np.ones(len(starts), np.int64)
        for k in np.flatnonzero(lengths > LONG).tolist():
            size[first[k] : first[k] + lengths[k]] = self._heap(int(first[k]), int(lengths[k]), table)
        chunk = np.repeat(np.arange(len(chunks)), lengths)
        symbols = np.flatnonzero((lengths <= LONG)[chunk])
        while len(symbols):
            same = chunk[symbols[:-1]] == chunk[symbols[1:]]
            both = size[symbols[:-1]] + size[symbols[1:]]
            joined = np.where(same & (both <= self.most), table[symbols[:-1], np.minimum(both, self.most)], -1)
            score = np.append(self.score[joined], -np.inf)
            heads = np.flatnonzero(np.append(True, ~same))
            best = np.maximum.reduceat(score, heads)
            counts = np.diff(np.append(heads, len(symbols)))
            hit = np.flatnonzero((score == np.repeat(best, counts)) & (score > -np.inf))
            if not len(hit):
                break
            hit = hit[np.append(True, np.diff(chunk[symbols[hit]]) != 0)]
            size[symbols[hit]] += size[symbols[hit + 1]]
            size[symbols[hit + 1]] = 0
            stay = np.repeat(best > -np.inf, counts)
            stay[hit + 1] = False
            symbols = symbols[stay]
        at = np.flatnonzero(size)
        ids = table[at, size[at]]
        bare = np.flatnonzero(ids < 0)
        owner = chunk[at]
        if len(bare):
            # Characters without a piece: one id for each of their bytes.
            ends = np.append(starts[1:], len(text))
            spelled = {k: [self.byte_ids[b] for b in text[starts[at[k]] : ends[at[k]]] if b != 0xFF] for k in bare.tolist()}
            repeat = np.ones(len(ids), np.int64)
            repeat[bare] = [len(spelled[k]) for k in bare.tolist()]
            ids, owner = np.repeat(ids, repeat), np.repeat(owner, repeat)
            ids[ids < 0] = [i for k in bare.tolist() for i in spelled[k]]
        raw = ids.astype("<u4").tobytes()
        ends = 4 * np.cumsum(np.bincount(owner, minlength=len(chunks)))
        return [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; new chunks are matched in batches of bounded size."""
        out = []
        if len(self.kept) > KEPT:
            self.kept.clear()
        kept = self.kept
        split = [self.chunk.findall(" " + t.replace("▁", " ")) if t else [] for t in texts]
        fresh = list({c for cs in split for c in cs}.difference(kept))
        part, held = [], 0
        for c in fresh:
            part.append(c)
            held += len(c)
            if held >= TOGETHER:
                kept.update(zip(part, self.match(part), strict=True))
                part, held = [], 0
        if part:
            kept.update(zip(part, self.match(part), strict=True))
        out = [b"".join(map(kept.__getitem__, cs)) for cs in split]
        return out

    def decode(self, ids: bytes) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD."""
        raw = b"".join(map(self.surface.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.decode(errors="replace").removeprefix(" ")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """One row per document: ``doc_id, ids`` (little-endian unsigned 32-bit), ``n_ids, decoded``; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)

        def solve(rows: list[tuple]) -> pa.RecordBatch:
            ids = c.encode([t for _, t in rows])
            cols = [pa.array([d for d, _ in rows], pa.int64()), pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(map(c.decode, ids), pa.string())]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "ids", "n_ids", "decoded"])

        for b in batches:
            held, size = [], 0
            for row in columns(b, "doc_id", "text"):
                held.append(row)
                size += len(row[1] or "")
                if size >= 4 * TOGETHER:
                    yield solve(held)
                    held, size = [], 0
            yield solve(held)

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return own.mapInArrow(run, "doc_id long, ids binary, n_ids long, decoded string")
