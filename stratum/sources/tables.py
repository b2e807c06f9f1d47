"""Logs derived from plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def event_log(spark: SparkSession, folder: str) -> DataFrame:
    """events as a tablet log: twenty events a block, four tablets, one row for each user, errors as tombstones."""
    e = table(spark, folder, "events")
    return e.select(
        F.lit(1).alias("collection"),
        (F.col("user_id") % 4).alias("identifier"),
        F.floor(F.col("event_id") / 20).cast("long").alias("height"),
        F.col("user_id").alias("pk"),
        F.when(F.col("event_type") == "error", None).otherwise(F.col("value")).alias("value"),
        F.col("event_id").alias("seq"),
    )


def singlet_log(spark: SparkSession, folder: str) -> DataFrame:
    """events as a singlet log: one singlet for each user."""
    return event_log(spark, folder).select("collection", F.col("pk").alias("identifier"), "height", "value", "seq")


def order_indexes(spark: SparkSession, folder: str) -> DataFrame:
    """orders as the snapshots of one tablet for each customer."""
    o = table(spark, folder, "orders")
    return o.select(F.lit(2).alias("collection"), F.col("o_custkey").alias("identifier"), F.col("o_orderkey").alias("at_height"))


def event_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """events as a chain of blocks, each the child of the one before."""
    e = table(spark, folder, "events")
    return e.select(F.col("event_id").alias("id"), F.col("event_id").alias("num"), (F.col("event_id") - 1).alias("parent_id"))
