"""Nested frames over the flat test tables: orders with lines, customers with orders with lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _with_lines(held: DataFrame, lines: DataFrame) -> DataFrame:
    lines = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct(*LINE))).alias("lines"))
    return held.join(lines, "o_orderkey", "left")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders + lines: array of structs; null where an order has none.

    Lines are grouped first and joined afterwards, so both sides meet on the order key
    with one shuffle each.
    """
    return _with_lines(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"))


def first_orders(spark: SparkSession, sf_dir: str, status: str, n: int) -> DataFrame:
    """The ``n`` orders of a status with the least keys, as ``orders`` has them.

    All lines are read, but only those of the orders found are shuffled.
    """
    held = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == status).orderBy("o_orderkey").limit(n)
    lines = table(spark, sf_dir, "lineitem")
    return _with_lines(held, lines.join(F.broadcast(held.select(F.col("o_orderkey").alias("l_orderkey"))), "l_orderkey", "left_semi"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer + orders: array of structs with lines."""
    inner = ("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "lines")
    held = orders(spark, sf_dir).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(F.struct(*inner))).alias("orders"))
    return table(spark, sf_dir, "customer").join(held, "c_custkey", "left")
