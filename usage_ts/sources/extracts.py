"""Delimited billing extracts whose headers drift from file to file."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usage_ts.operators import joins

SOURCE = "source_file"

# How the extracts are written.
CSV_OPTIONS = {"encoding": "ISO-8859-1", "escape": '"', "header": "true"}
BYTE_ORDER_MARKS = ("﻿", "ï»¿")
CLASS_PREFIX = "W&S_"


def clean_name(name: str) -> str:
    """Header cell without blanks, quotes and byte-order mark."""
    for mark in BYTE_ORDER_MARKS:
        name = name.removeprefix(mark)
    return name.replace(" ", "").replace('"', "")


def list_extracts(spark: SparkSession, directory: str) -> list[str]:
    """Paths of the CSV files of a directory that hold anything, in name order (Q7).

    Only file names reach the driver; the content column is pruned.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.csv")
        .load(directory)
        .filter("length > 0")
        .select("path")
    )
    return sorted(row.path for row in files.collect())


def header_census(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """One row per layout, (line, files, paths): the first line as bytes, and who begins with it.

    One job whatever the number of files. It goes once over the plain lines, without parsing them and without
    Python; each task keeps one line per file, so what is shuffled has a row per file and split. A file without
    a line that is not blank is in no layout.
    """
    lines = spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("place"),
        "value",
    )
    first = lines.filter(F.trim("value") != "").groupBy("path").agg(F.min_by("value", F.struct("at", "place")).alias("line"))
    return first.groupBy(F.col("line").cast("binary").alias("line")).agg(
        F.count(F.lit(1)).alias("files"), F.array_sort(F.collect_list("path")).alias("paths")
    )


def layouts_of(spark: SparkSession, paths: Sequence[str]) -> list[tuple[list[str], list[str]]]:
    """(header, paths) of each layout, in the order of its first path.

    Files are grouped by their first line in one job; the header of a group is read once, as the reader sees it.
    """
    if not paths:
        return []
    found: dict[tuple[str, ...], list[str]] = defaultdict(list)
    for group in header_census(spark, paths).collect():
        header = spark.read.options(**CSV_OPTIONS).csv(group.paths[0]).columns
        found[tuple(header)].extend(group.paths)
    return sorted(((list(h), sorted(p)) for h, p in found.items()), key=lambda layout: layout[1][0])


def _scan(spark: SparkSession, header: Sequence[str], paths: Sequence[str], multiline: bool, broken: str | None = None) -> DataFrame:
    """All-text scan of files of one layout; ``broken`` names a column for lines that do not have its number of cells."""
    fields = [T.StructField(name, T.StringType()) for name in (*header, *([broken] if broken else []))]
    reader = spark.read.schema(T.StructType(fields)).options(**CSV_OPTIONS).option("multiLine", multiline)
    if broken:
        # Cells are counted only where the reader takes all of them.
        reader = reader.option("columnNameOfCorruptRecord", broken).option("columnPruning", False)
    return reader.csv(list(paths))


def read_extracts(spark: SparkSession, paths: Sequence[str], multiline: bool = False) -> list[DataFrame]:
    """One all-text DataFrame per distinct header, with the file name as lineage.

    Files that share a header are scanned together, so the number of jobs and scans follows the number of
    layouts, not of files. With ``multiline`` a quoted cell may hold line breaks; such a file is read by one task.
    """
    return [
        _scan(spark, header, members, multiline).select(
            *[F.col(f"`{name}`").alias(clean_name(name)) for name in header],
            F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias(SOURCE),
        )
        for header, members in layouts_of(spark, paths)
    ]


def line_counts(spark: SparkSession, paths: Sequence[str], multiline: bool = False) -> DataFrame:
    """(source file, lines, broken): records of each file, and those with more or fewer cells than its header.

    Broken records are still read, cut or filled with nulls. Blank lines are no records; a file with a header
    alone has no row.
    """
    schema = f"{SOURCE} string, lines bigint, broken bigint"
    counts = [spark.createDataFrame([], schema)]
    for header, members in layouts_of(spark, paths):
        rows = _scan(spark, header, members, multiline, "_broken").select(
            F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias(SOURCE),
            F.col(f"`{header[0]}`").alias("_first"),  # the reader refuses to give broken lines alone
            "_broken",
        )
        lines = F.count("_first") + F.count_if(F.col("_first").isNull())
        counts.append(rows.groupBy(SOURCE).agg(lines.alias("lines"), F.count("_broken").alias("broken")))
    return reduce(DataFrame.unionByName, counts)


def align_columns(df: DataFrame, defaults: Mapping[str, object], keep: Sequence[str]) -> DataFrame:
    """Add absent columns with their default, then project to ``keep``."""
    absent = {c: F.lit(v) for c, v in defaults.items() if c not in df.columns}
    return (df.withColumns(absent) if absent else df).select(*keep)


def union_extracts(
    frames: Sequence[DataFrame],
    keep: Sequence[str] | None = None,
    defaults: Mapping[str, object] | None = None,
) -> DataFrame:
    """U1 with a declared projection, or U2 (every column kept) when ``keep`` is None."""
    if keep is None:
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return reduce(
        DataFrame.unionByName, [align_columns(f, defaults or {}, keep) for f in frames]
    )


def of_rate_class(
    df: DataFrame,
    rate_class: str = "all",
    column: str = "rate_class",
    source: str = SOURCE,
    compat: bool = False,
) -> DataFrame:
    """Rows of one class; ``all`` means no filter.

    With ``compat`` a source that has no row of the class contributes all its
    rows. That needs one flag per source, pre-aggregated and joined back; rows
    are salted, as one file may hold most of them.
    """
    if rate_class.lower() == "all":
        return df
    wanted = F.col(column) == CLASS_PREFIX + rate_class.upper()
    if not compat:
        return df.filter(wanted)
    has_class = df.groupBy(source).agg(
        F.max(F.coalesce(wanted, F.lit(False))).alias("_has_class")
    )
    return (
        joins.salted(df, has_class, [source])
        .filter(wanted | ~F.col("_has_class"))
        .drop("_has_class")
    )


def within_retention(df: DataFrame, end: str, as_of, years: int = 5) -> DataFrame:
    """Records that end no earlier than ``years`` before ``as_of``."""
    as_of = F.lit(as_of).cast("date")
    return df.filter(F.col(end) >= F.add_months(as_of, -12 * years))
