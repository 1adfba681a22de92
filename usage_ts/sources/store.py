"""Tables on disk: materialise-or-compute, sinks, saved models."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.ml.util import MLReadable, MLWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """S3: a prepared table."""
    return spark.read.parquet(path)


def read_csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S3: a prepared table in CSV with a stated schema."""
    return spark.read.schema(schema).csv(path, header=True, dateFormat="yyyy-MM-dd")


def read_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read the table at ``path``; if there is none, build, write and read it."""
    try:
        return read_table(spark, path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    write_table(build(), path)
    return read_table(spark, path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Parquet, one folder per partition value.

    Rows of a partition value are brought together first, so that a write does
    not leave one file per task in every folder; adaptive execution splits a
    value that is too large for one task.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S5-S8 as CSV with a header, for tools that read text."""
    df.write.mode(mode).csv(path, header=True, dateFormat="yyyy-MM-dd")


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per row."""
    df.write.mode(mode).json(path)


def append_run(df: DataFrame, path: str, run_id: str) -> None:
    """Metrics, fold and trial tables of many runs side by side.

    Writing a run again replaces it and leaves the others alone.
    """
    (
        df.withColumn("run_id", F.lit(run_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id")
        .parquet(path)
    )


def write_by_month(df: DataFrame, path: str, day: str = "d") -> None:
    """W14 on disk: overwrite only the months present in ``df``.

    ``df`` must hold its months whole.
    """
    (
        df.withColumn("month", F.date_format(day, "yyyy-MM"))
        .hint("rebalance", "month")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("month")
        .parquet(path)
    )


def save_models(models: DataFrame, path: str) -> None:
    """The model table of a grouped fit; coefficients, parameters and seed values."""
    models.write.mode("overwrite").parquet(path)


def load_models(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_ml_model(model: MLWritable, path: str) -> None:
    """S10 for a distributed model."""
    model.write().overwrite().save(path)


def load_ml_model(kind: type[MLReadable], path: str):
    return kind.load(path)
