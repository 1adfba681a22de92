"""Packing of token sequences by multiway differencing.

Tokens of a document beyond whole windows form one item per document. Items are packed in blocks of
bounded size: each item starts as a partial partition (its size in one window, zero in the others);
the two partial partitions with the largest imbalance are merged, the fullest window of one with the
emptiest of the other, until one partition is left. Its windows are nearly equal. Items of less than 1/64
of the capacity wait and are poured into the emptiest windows, the longest first, so the partial partitions
are few however short the texts. If the fullest window exceeds the capacity, the block is divided into one
window more.

A block lies within one partition of the input, so nothing is shuffled and memory does not depend on
the input. Defined cases: a null or empty text is its end token alone; repeated rows are packed each;
an empty table has no pieces.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usage_ts.llm.common import columns
from usage_ts.llm.tokens import word_tokens

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Tokens of a block, in windows; the end of a partition makes a smaller block.
BLOCK_WINDOWS = 256
#: An item of less than this part of the capacity is small.
SMALL = 64


def differencing(sizes: list[int], windows: int) -> tuple[np.ndarray, np.ndarray]:
    """Window of each item, and the windows' sums, by largest-differencing into ``windows`` parts."""
    sums: list[np.ndarray | None] = []
    merges: list[tuple[int, int, np.ndarray]] = []
    heap, order = [], count()
    for i, size in enumerate(sizes):
        part = np.zeros(windows, np.int64)
        part[0] = size
        sums.append(part)
        heap.append((-size, next(order), i))
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        part = sums[a] + sums[b][::-1]
        turn = np.argsort(-part, kind="stable")
        part = part[turn]
        sums[a] = sums[b] = None
        merges.append((a, b, turn.astype(np.int32)))
        sums.append(part)
        heapq.heappush(heap, (int(part[-1] - part[0]), next(order), len(sums) - 1))
    placed: dict[int, np.ndarray] = {len(sums) - 1: np.arange(windows)}
    result = np.zeros(len(sizes), np.int64)
    for node, (a, b, turn) in zip(range(len(sums) - 1, len(sizes) - 1, -1), reversed(merges), strict=True):
        own = np.empty(windows, np.int64)
        own[turn] = placed.pop(node)
        placed[a], placed[b] = own, own[::-1]
    for i in range(len(sizes)):
        result[i] = placed[i][0]
    return result, sums[-1]


def windows_for(sizes: list[int], capacity: int) -> np.ndarray:
    """Window of each item; no window exceeds the capacity, which no single item may exceed."""
    windows = -(-sum(sizes) // capacity)
    small = {k for k, size in enumerate(sizes) if SMALL * size < capacity}
    large = [k for k in range(len(sizes)) if k not in small]
    at = np.zeros(len(sizes), np.int64)
    while True:
        sums = np.zeros(windows, np.int64)
        if large:
            at[large], sums = differencing([sizes[k] for k in large], windows)
        if sums.max() <= capacity:
            room = [(int(s), w) for w, s in enumerate(sums)]
            heapq.heapify(room)
            for k in sorted(small, key=lambda k: (-sizes[k], k)):
                held, w = room[0]
                if held + sizes[k] > capacity:
                    break
                at[k] = w
                heapq.heapreplace(room, (held + sizes[k], w))
            else:
                return at
        windows += 1


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids`` (little-endian unsigned 32-bit), ``doc_tokens,
    sequence_id, offset``. Pieces of a sequence follow each other from offset 0 without gaps.

    A document longer than the capacity fills whole sequences of its own first; its rest is an item.
    ``sequence_id`` holds the partition in its upper bits, so a task that runs again gives the same ids.
    """
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(tokenizer_path)
        sequence = count(TaskContext.get().partitionId() << 33)
        items: list[tuple[int | None, int, bytes, int]] = []
        pending = 0

        def table(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            names = "doc_id start length ids doc_tokens sequence_id offset".split()
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        def flush() -> Iterator[pa.RecordBatch]:
            at = windows_for([len(i[2]) // 4 for i in items], capacity)
            rows, last, offset = [], -1, 0
            for k in np.argsort(at, kind="stable").tolist():
                doc, start, ids, total = items[k]
                if at[k] != last:
                    last, offset, number = at[k], 0, next(sequence)
                rows.append((doc, start, len(ids) // 4, ids, total, number, offset))
                offset += len(ids) // 4
            items.clear()
            yield table(rows)

        for b in batches:
            full: list[tuple] = []
            held = 0
            for doc, text in columns(b, "doc_id", "text"):
                ids = tokens.ids(text) + end
                total = len(ids) // 4
                whole = total - total % capacity
                for start in range(0, whole, capacity):
                    full.append((doc, start, capacity, ids[4 * start : 4 * (start + capacity)], total, next(sequence), 0))
                    held += capacity
                if whole < total:
                    items.append((doc, whole, ids[4 * whole :], total))
                    pending += total - whole
                if pending >= BLOCK_WINDOWS * capacity:
                    yield from flush()
                    pending = 0
                if held >= BLOCK_WINDOWS * capacity:
                    yield table(full)
                    full, held = [], 0
            yield table(full)
        if items:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
