"""Small helpers shared by the text operators."""

from __future__ import annotations

import binascii
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usage_ts.sources.lineage import shared_folder


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the folder all executors share and read it back.

    Cuts the lineage, survives lost executors, and gives the planner true sizes.
    """
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; none for null."""
    return text.encode().split() if text else []


def columns(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """Rows of an Arrow batch as tuples of the named columns."""
    return zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True where crc32 of the id as text is a multiple of ``folds``; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def crc_of(key: object) -> int:
    return binascii.crc32(str(key).encode())
