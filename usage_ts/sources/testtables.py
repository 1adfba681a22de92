"""Billing-shaped views over the supplied star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usage_ts.operators.dedup import keep_last

BILLING_KEY = ["account", "start_d", "end_d"]
LOAD_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def billing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per billed interval: account, class, start, end, quantity, attributes."""
    return _billed(spark, sf_dir, table(spark, sf_dir, "lineitem").withColumn("_start", _day()))


def _day() -> Column:
    return F.col("l_shipdate").cast("date")


def _billed(spark: SparkSession, sf_dir: str, lines: DataFrame, by_account: bool = False) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    start = F.col("_start")
    ordered = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    if by_account:
        ordered = ordered.repartition("o_custkey")
    return (
        ordered.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_custkey").alias("account"),
            F.concat(F.lit("W&S_"), F.upper("c_mktsegment")).alias("rate_class"),
            start.alias("start_d"),
            F.date_add(start, 20 + 3 * F.col("l_linenumber")).alias("end_d"),
            F.col("l_quantity").cast("decimal(18,2)").alias("consumption"),
            F.abs("l_discount").alias("num_a"),
            F.abs("l_tax").alias("num_b"),
            F.when(F.col("l_returnflag") == "R", "X").otherwise(" ").alias("flag_raw"),
            F.col("l_linestatus").alias("cat_a"),
            F.col("o_orderpriority").alias("cat_b"),
            *LOAD_ORDER,
        )
    )


def billing_dedup(spark: SparkSession, sf_dir: str, by_account: bool = False) -> DataFrame:
    """:func:`billing` with the last loaded row of each (account, start, end).

    The copies of a line go first, among the rows of its order, which the join brings together anyway: all have
    the same accounts, start and end. Order and line then tell which row is last, so the second shuffle need not
    carry the rest of the load order for that. ``by_account`` deals the rows by account before the customers come,
    for a job that groups by account next: however that join is planned, there is no later shuffle of the rows.
    Start and end are made of what copies are told by, so a filter on them goes below all of this, to the scan.
    """
    lines = table(spark, sf_dir, "lineitem").filter("l_orderkey IS NOT NULL").repartition("l_orderkey")
    lines = keep_last(lines.withColumn("_start", _day()), [*LOAD_ORDER[:2], "_start"], LOAD_ORDER[2:])
    return keep_last(_billed(spark, sf_dir, lines, by_account), BILLING_KEY, LOAD_ORDER[:2])
