"""Documents rewritten for filling in the middle, cut at line ends.

The last places of a text's lines form a set held as chunks of 65,536 places: a chunk is an array of places,
a bitmap or a list of runs, whichever takes least room, and a running count tells how many places lie before
each chunk. The k-th line end is found by a search over those counts and a select within one chunk, so both
cuts of a text cost two searches, however many lines it has.

Defined cases: a null text is empty; an empty text, and one that holds a mark, stays as it is (``plain``, no
cut places); a null id is hashed as an empty one; repeated rows are rewritten alike, each; an empty table
gives no rows; columns other than the id and the text are left behind. A text is processed whole.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usage_ts.llm.common import columns

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Places of a chunk, and the bytes of a chunk as a bitmap.
CHUNK, BITMAP = 1 << 16, 1 << 13


class Places:
    """Chunk as a sorted array: best for few places."""

    def __init__(self, hits: np.ndarray) -> None:
        self.places = np.flatnonzero(hits).astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.places[k])


class Bits:
    """Chunk as a bitmap with a running count per 64-bit word."""

    def __init__(self, hits: np.ndarray) -> None:
        packed = np.zeros(BITMAP, np.uint8)
        packed[: -(-len(hits) // 8)] = np.packbits(hits, bitorder="little")
        self.words = packed.view("<u8")
        self.upto = np.bitwise_count(self.words).cumsum(dtype=np.int64)

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.upto, k, "right"))
        word = int(self.words[at])
        for _ in range(k - (int(self.upto[at - 1]) if at else 0)):
            word &= word - 1
        return 64 * at + (word & -word).bit_length() - 1


class Runs:
    """Chunk as stretches of successive places: best for blocks of empty lines."""

    def __init__(self, hits: np.ndarray) -> None:
        edges = np.flatnonzero(np.diff(hits, prepend=False, append=False))
        self.first, past = edges[::2], edges[1::2]
        self.before = np.cumsum(past - self.first) - (past - self.first)

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.first[at]) + k - int(self.before[at])


def chunk(hits: np.ndarray) -> Places | Bits | Runs:
    """The smallest form: two bytes a place, a bitmap, or four bytes a run."""
    places = int(np.count_nonzero(hits))
    runs = int(np.count_nonzero(hits[1:] & ~hits[:-1])) + int(hits[0])
    kind = min((2 * places, 0, Places), (BITMAP, 1, Bits), (4 * runs, 2, Runs))[2]
    return kind(hits)


class LineEnds:
    """The places of the last code points of a text's lines; ``len`` is the number of lines."""

    def __init__(self, text: str) -> None:
        self.chunks: list[Places | Bits | Runs] = []
        self.starts: list[int] = []
        self.before: list[int] = []
        self.total = 0
        for start in range(0, len(text), CHUNK):
            part = text[start : start + CHUNK]
            codes = np.frombuffer(part.encode(), np.uint8) if part.isascii() else np.frombuffer(part.encode("utf-32-le"), "<u4")
            hits = codes == ord("\n")
            if start + CHUNK >= len(text):
                hits[-1] = True  # what follows the last line break is a line too
            if hits.any():
                self.chunks.append(chunk(hits))
                self.starts.append(start)
                self.before.append(self.total)
                self.total += int(np.count_nonzero(hits))

    def __len__(self) -> int:
        return self.total

    def select(self, k: int) -> int:
        """The k-th smallest place, from 0 on."""
        at = bisect_right(self.before, k) - 1
        return self.starts[at] + self.chunks[at].select(k - self.before[at])

    def after(self, lines: int) -> int:
        """The offset at which the first ``lines`` lines end."""
        return self.select(lines - 1) + 1 if lines else 0


def rewrite(doc_id: int | None, text: str, seed: int, rate: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """Lines, form, length of prefix and of middle, and the new text of one document."""
    ends = LineEnds(text)
    n = len(ends)
    key = f"{seed}:{'' if doc_id is None else doc_id}"
    one, two, three, four = np.frombuffer(hashlib.sha256(key.encode()).digest()[:16], ">u4").tolist()
    if not text or three % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = (ends.after(k) for k in sorted((one % (n + 1), two % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if four % 100 < spm:
        return n, "spm", a, b - a, "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", a, b - a, "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """One row per document: ``doc_id, n`` (lines), ``form, prefix_chars, middle_chars, output``.

    ``rate`` of 100 texts are rewritten, ``spm`` of 100 of these with the suffix first. The choice depends on
    the seed and the id alone; nothing is shuffled.
    """
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *rewrite(i, t or "", seed, rate, spm)) for i, t in columns(b, "doc_id", "text")]
            cols = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that :func:`fill_in_middle` rewrote. No mark begins with another's end, and none is in the
    text, so the first match of each is the one put there."""

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(len(first) + 1))
        one = F.substring_index(body, second, 1)
        rest = F.substr(body, F.length(one) + F.lit(len(second) + 1))
        two = F.substring_index(rest, MIDDLE, 1)
        return one, two, F.substr(rest, F.length(two) + F.lit(len(MIDDLE) + 1))

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    late_suffix, late_prefix, late_middle = parts(SUFFIX, PREFIX)
    return (
        F.when(form == "psm", F.concat(prefix, middle, suffix))
        .when(form == "spm", F.concat(late_prefix, late_middle, late_suffix))
        .otherwise(output)
    )
