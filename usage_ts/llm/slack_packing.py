"""Packing of token sequences by minimum slack.

One sequence at a time: the longest item at hand opens it, and a subset-sum table over the lengths at hand, a bit
per reachable sum, tells the fullest sequence they allow; it is taken as often as the lengths last, then the next
one is sought. Only lengths and their counts take part, so equal items cost one step. Lengths enter the table from
the longest on, and no more enter once a sum lacks at most 1/``SPARED`` of the capacity: short items, which fit
anywhere, are spared for sequences that need them. (Of 3,998 items that fill 1,782 sequences of 1,024 tokens or
more, this makes 1,783; a search to the last token makes 1,800, one without the longest item 1,825.)

Work is done in blocks within a partition of the input, and nothing is shuffled. A block gives up sequences until
half of it is left, so its short items meet the next block's long ones; only the end of a partition empties it.
Memory is bounded by the block, and a task that runs again gives the same rows.

Defined cases: a null or empty text is its end token alone; repeated rows are packed each; a null id stays
null; an empty table has no pieces; columns other than the id and the text are left behind.
"""

from __future__ import annotations

import operator
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usage_ts.llm.byte_tokens import byte_tokens
from usage_ts.llm.common import columns

SCHEMA = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"
#: A block's sequences' worth of tokens, and its items; beyond either it gives up sequences.
BLOCK_SEQUENCES, BLOCK_ITEMS = 4096, 100_000
SPARED = 128


def fullest(lengths: list[int], counts: dict[int, int], capacity: int, enough: int | None = None) -> list[int]:
    """Lengths of the fullest sequence that the counts allow, from as many of the falling ``lengths`` as it takes
    to reach ``enough`` (the capacity unless given)."""
    enough = capacity if enough is None else max(enough, 0)
    sums, within, taken = 1, (1 << capacity + 1) - 1, []
    for length in lengths[bisect_left(lengths, -capacity, key=operator.neg) :]:
        if sums >> enough:
            break
        for _ in range(min(counts[length], capacity // length)):
            new = (sums | sums << length) & within
            if new == sums:
                break
            taken.append((length, sums))
            sums = new
    total, chosen = sums.bit_length() - 1, []
    for length, before in reversed(taken):
        if not before >> total & 1:
            chosen.append(length)
            total -= length
    return chosen


class Block:
    """Items at hand by length, given back as sequences."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.items: dict[int, list] = defaultdict(list)
        self.tokens = self.size = 0

    def add(self, length: int, item: tuple) -> None:
        self.items[length].append(item)
        self.tokens += length
        self.size += 1

    def full(self) -> bool:
        return self.tokens >= BLOCK_SEQUENCES * self.capacity or self.size >= BLOCK_ITEMS

    def sequences(self, tokens: int = 0, size: int = 0) -> Iterator[list[tuple]]:
        """Sequences until no more than ``tokens`` and ``size`` items are left."""
        lengths = sorted((length for length, held in self.items.items() if held), reverse=True)
        counts = {length: len(self.items[length]) for length in lengths}
        while lengths and (self.tokens > tokens or self.size > size):
            top = lengths[0]
            counts[top] -= 1
            chosen = [top, *fullest(lengths, counts, self.capacity - top, self.capacity - top - self.capacity // SPARED)]
            counts[top] += 1
            uses = {length: chosen.count(length) for length in chosen}
            for _ in range(min(counts[length] // n for length, n in uses.items())):
                self.tokens -= sum(chosen)
                self.size -= len(chosen)
                yield [self.items[length].pop() for length in chosen]
            counts |= {length: len(self.items[length]) for length in uses}
            if not all(map(counts.__getitem__, uses)):
                lengths = [length for length in lengths if counts[length]]


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids`` (little-endian unsigned 32-bit), ``sequence_id,
    offset``. Pieces of a sequence follow each other from offset 0 without gaps.

    Only a document longer than the capacity is cut; its first piece is what whole pieces leave over.
    ``sequence_id`` holds the partition in its upper bits.
    """
    end = end_id.to_bytes(4, "little")
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())

    def table(rows: list[tuple]) -> pa.RecordBatch:
        cols = zip(*rows, strict=True) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, block = byte_tokens(tokenizer_path), Block(capacity)
        number = count(TaskContext.get().partitionId() << 33)

        def give(tokens: int = 0, size: int = 0) -> Iterator[pa.RecordBatch]:
            rows = []
            for sequence in block.sequences(tokens, size):
                at, offset = next(number), 0
                for doc, start, ids in sequence:
                    rows.append((doc, 0, start, len(ids) // 4, ids, at, offset))
                    offset += len(ids) // 4
            yield table(rows)

        for b in batches:
            whole: list[tuple] = []
            for doc, text in columns(b, "doc_id", "text"):
                ids = tokens.ids(text) + end
                first = len(ids) // 4 % capacity
                if first:
                    block.add(first, (doc, 0, ids[: 4 * first]))
                for piece, start in enumerate(range(first, len(ids) // 4, capacity), start=int(first > 0)):
                    whole.append((doc, piece, start, capacity, ids[4 * start : 4 * (start + capacity)], next(number), 0))
                    if len(whole) >= BLOCK_SEQUENCES:
                        yield table(whole)
                        whole = []
                if block.full():
                    yield from give(BLOCK_SEQUENCES * capacity // 2, BLOCK_ITEMS // 2)
            yield table(whole)
        yield from give()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
