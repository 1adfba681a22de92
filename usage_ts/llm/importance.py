"""Documents drawn towards a target distribution: weights from hashed word pairs, Gumbel noise, highest scores.

A feature's bucket is the crc32 of its bytes. A crc is linear: it is a constant of the length, combined by
exclusive or with what each byte contributes by its distance from the end. A table holds these contributions
for the last ``NEAR`` places, so the crcs of all words and word pairs of many texts are two look-ups a byte
and one ``bitwise_xor.reduceat`` over the spans. Longer spans are cut into blocks of ``NEAR`` bytes from their
end, and blocks are folded in pairs, each fold with a table that moves a block past the ones behind it.

The texts are read twice, once for the counts of buckets and once for the weights; a task sends at most one
count per bucket. Ranks come from a sort by ranges, and no task sees more than its range.

Defined cases: a null or empty text has no features, weight 0 and is not drawn; a null id is hashed as an
empty one and loses ties; repeated rows are scored each, and among equal ones the place in the table decides;
an empty target or corpus counts nothing; columns other than the id and the text are left behind.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usage_ts.llm.common import settle

BUCKETS = 10_000
NEAR = 64
#: Bytes of text worked on together.
TOGETHER = 1 << 20
_SPACE = 32


def _lowered() -> np.ndarray:
    """Each byte lower-cased if A-Z, and a space unless it is a digit, a letter or beyond ASCII."""
    keep = np.arange(256, dtype=np.uint8)
    keep[ord("A") : ord("Z") + 1] += 32
    ascii_word = ((keep >= ord("0")) & (keep <= ord("9"))) | ((keep >= ord("a")) & (keep <= ord("z")))
    return np.where(ascii_word | (keep >= 128), keep, np.uint8(_SPACE))


def _past_zero(state: np.ndarray, step: np.ndarray) -> np.ndarray:
    """States after one more zero byte."""
    return step[state & 0xFF] ^ (state >> np.uint32(8))


class Crc:
    """crc32 of many spans of a byte array at once."""

    def __init__(self) -> None:
        step = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            step = np.where(step & 1, (step >> np.uint32(1)) ^ np.uint32(0xEDB88320), step >> np.uint32(1))
        rows = [step]
        for _ in range(NEAR - 1):
            rows.append(_past_zero(rows[-1], step))
        #: [distance from the end, byte] -> contribution.
        self.table = np.stack(rows)
        self.flat = self.table.ravel()
        move = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
        for _ in range(NEAR):
            move = _past_zero(move, step)
        #: Tables that move a state past NEAR, 2 NEAR, 4 NEAR ... zero bytes, one row per byte of the state.
        self.moves = [move]
        #: Constants of the lengths: what zero bytes alone give.
        self.zeros = np.array([zlib.crc32(bytes(n)) for n in range(NEAR + 1)], np.uint32)

    def moved(self, state: np.ndarray, level: int) -> np.ndarray:
        while len(self.moves) <= level:
            self.moves.append(self.moved(self.moves[-1], len(self.moves) - 1))
        m = self.moves[level]
        return m[0][state & 0xFF] ^ m[1][state >> 8 & 0xFF] ^ m[2][state >> 16 & 0xFF] ^ m[3][state >> 24]

    def long(self, data: np.ndarray, first: np.ndarray, past: np.ndarray) -> np.ndarray:
        """crc32 of spans of any length, block by block."""
        size = past - first
        blocks = -(-size // NEAR)
        span = np.repeat(np.arange(len(size)), blocks)
        #: Block 0 is the last one of its span.
        at = np.arange(len(span)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        end = past[span] - at * NEAR
        begin = np.maximum(end - NEAR, first[span])
        own = end - begin
        starts = np.cumsum(own) - own
        back = np.repeat(starts + own, own) - 1 - np.arange(int(own.sum()))
        byte = data[np.repeat(end, own) - 1 - back]
        part = np.bitwise_xor.reduceat(self.table[back, byte], starts)
        level = 0
        while len(part) > len(size):
            part = np.where(at & 1, self.moved(part, level), part)
            at = at >> 1
            heads = np.flatnonzero((np.diff(span, prepend=-1) != 0) | (np.diff(at, prepend=-1) != 0))
            part, span, at = np.bitwise_xor.reduceat(part, heads), span[heads], at[heads]
            level += 1
        return part ^ np.array([zlib.crc32(bytes(int(n))) for n in size], np.uint32)


@lru_cache(maxsize=1)
def _crc() -> Crc:
    return Crc()


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """crc32 of every word and of every word pair, the text each is from, and the number of words of each text."""
    crc, low = _crc(), _lowered()
    data = low[np.frombuffer(b"\0".join([*texts, b""]), np.uint8)]
    word = data != _SPACE
    first = np.flatnonzero(word[1:] & ~word[:-1]) + 1
    if len(word) and word[0]:
        first = np.concatenate([[0], first])
    size = np.flatnonzero(word[:-1] & ~word[1:]) + 1 - first
    bounds = np.cumsum([len(t) + 1 for t in texts])
    text = np.searchsorted(bounds, first, "right")
    words = np.bincount(text, minlength=len(texts))
    if not len(first):
        return np.empty(0, np.uint32), np.empty(0, np.int64), words
    # Words follow each other with one space behind each, so words and pairs are spans of one array.
    word[1:] |= word[:-1].copy()
    line = data[word]
    start = np.cumsum(size + 1) - (size + 1)
    past = start + size
    place = np.arange(len(line), dtype=np.int32)
    pair_past = np.concatenate([past[1:], past[-1:]])

    def crcs(end: np.ndarray, spaces: bool) -> np.ndarray:
        back = np.repeat(end.astype(np.int32), size + 1) - 1 - place
        near = (np.clip(back, 0, NEAR - 1) << 8) | line
        part = crc.flat[near]
        if not spaces:
            part[past] = 0  # the space behind the word
        return np.bitwise_xor.reduceat(part, start)

    tail = crcs(past, spaces=False)
    head = crcs(pair_past, spaces=True)
    pair = np.flatnonzero(text[1:] == text[:-1])
    one_size, two_size = size, pair_past[pair] - start[pair]
    one = tail ^ crc.zeros[np.minimum(one_size, NEAR)]
    two = head[pair] ^ tail[pair + 1] ^ crc.zeros[np.minimum(two_size, NEAR)]
    for found, sizes, begin, end in ((one, one_size, start, past), (two, two_size, start[pair], pair_past[pair])):
        far = np.flatnonzero(sizes > NEAR)
        if len(far):
            found[far] = crc.long(line, begin[far], end[far])
    return np.concatenate([one, two]), np.concatenate([text, text[pair]]), words


def _slices(texts: list[bytes | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of bounded size with the place of the first; a longer text is a run of its own."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t or b"") > TOGETHER:
            yield begin, [x or b"" for x in texts[begin:i]]
            begin, held = i, 0
        held += len(t or b"") + 1
    if begin < len(texts):
        yield begin, [x or b"" for x in texts[begin:]]


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n``: features of all texts in each bucket that has any; counted within tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for b in batches:
            for _, texts in _slices(b.column("text").to_pylist()):
                n += np.bincount(features(texts)[0] % buckets, minlength=buckets)
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(n[seen])], ["bucket", "n"])

    own = docs.select(F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, "bucket int, n long")
    return own.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Thousandfold logarithm of how much likelier each bucket is in the target, rounded down. The driver gets one
    row per bucket and side."""
    sides = [bucket_counts(df, buckets).withColumn("side", F.lit(k)) for k, df in enumerate((docs, target))]
    n = np.zeros((2, buckets))
    for r in sides[0].unionByName(sides[1]).collect():
        n[r["side"], r["bucket"]] = r["n"]
    source, wanted = n
    return np.floor(1000 * np.log((wanted + 1) * (source.sum() + buckets) / ((source + 1) * (wanted.sum() + buckets)))).astype(np.int64)


def weighted(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight, row``: the mean gain of each document's features, rounded down.

    ``row`` is unique: the partition in its upper bits, then the place within it.
    """
    names = ["doc_id", "n_words", "n_features", "weight", "row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            for begin, texts in _slices(b.column("text").to_pylist()):
                crcs, text, words = features(texts)
                n = np.bincount(text, minlength=len(texts))
                total = np.zeros(len(texts), np.int64)
                np.add.at(total, text, gain[crcs % len(gain)])
                ids = b.column("doc_id").slice(begin, len(texts))
                cols = [words, n, total // np.maximum(n, 1), np.arange(row, row + len(texts))]
                row += len(texts)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in cols)], names)

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    return own.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise from the id, thousandfold and rounded down."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(df: DataFrame, order: list[Column], output: str = "rank") -> DataFrame:
    """``df`` with the place of each row in a total order, from 1 on.

    Rows are dealt by ranges and numbered within them; the driver gets one count per range.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            here = pa.array(np.arange(at, at + len(b)), pa.int64())
            at += len(b)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * len(b), pa.int32()), here], [*b.schema.names, "_part", "_at"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = settle(ranges.mapInArrow(number, f"{kinds}, _part int, _at long"), "ranges")
    sizes = {r["_part"]: r["count"] for r in dealt.groupBy("_part").count().collect()}
    parts = sorted(sizes)
    before = np.cumsum([0, *map(sizes.__getitem__, parts)]).tolist()
    offsets = df.sparkSession.createDataFrame(list(zip(parts, before)), "_part int, _before long")
    # One row per range.
    return dealt.join(F.broadcast(offsets), "_part").withColumn(output, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def resample(
    docs: DataFrame,
    target: DataFrame,
    share: int = 25,
    least_words: int = 20,
    seed: int = 7,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Every document: ``doc_id, n_features, weight, score, rank``. Of those with ``least_words`` words or more,
    ``share`` in a hundred are drawn; the others have no rank. Ties go to the smaller id."""
    scored = weighted(docs, gains(docs, target, buckets)).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = settle(scored, "scored")
    able = F.col("n_words") >= least_words
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    drawn = scored.where(able).count() * share // 100
    placed = ranked(scored.where(able), order)
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    cols = ["doc_id", "n_features", "weight", "score"]
    rest = scored.where(~able).select(*cols, F.lit(None).cast("long").alias("rank"))
    return placed.select(*cols, rank.alias("rank")).unionByName(rest)
