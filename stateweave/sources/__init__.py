"""Tables and feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order: price, balance, day, month, priority, segment, status, and ``y`` (finished or not)."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        "o_orderkey",
        F.col("o_totalprice").alias("price"),
        F.col("c_acctbal").alias("balance"),
        F.dayofmonth("o_orderdate").cast("double").alias("day"),
        F.month("o_orderdate").cast("double").alias("month"),
        F.col("o_orderpriority").alias("priority"),
        F.col("c_mktsegment").alias("segment"),
        F.col("o_orderstatus").alias("status"),
        (F.col("o_orderstatus") == "F").cast("int").alias("y"),
    )
