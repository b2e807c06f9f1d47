"""Bulk reprocessing in shards: split by entity, written with a manifest, injected in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import BlockRef, Checkpoint, ContiguityError, shard_checkpoint_key
from ..sources.logstore import LogStore
from .stats import shard_of


def write_shards(rows: DataFrame, path: str, shards: int, start: int, stop: int) -> None:
    """One folder for each shard with its rows in [start, stop], and the manifests of the segment.

    The block manifest has a row for every shard and block, with the number of
    that shard's rows in it, none included; the segment's own, which is written
    last, also when the input ends exactly at stop, names its bounds.
    """
    part = rows.where(F.col("height").between(start, stop)).withColumn("shard", shard_of(shards))
    name = segment(start, stop)
    part.repartition(shards, "shard").sortWithinPartitions("height", "seq").write.mode("overwrite").option("compression", "zstd").partitionBy("shard").parquet(f"{path}/rows/{name}")
    block_manifest(part, shards).write.mode("overwrite").parquet(f"{path}/blocks/{name}")
    spark = rows.sparkSession
    spark.createDataFrame([(start, stop, shards)], "first long, last long, shards int").coalesce(1).write.mode("overwrite").json(f"{path}/manifest/{name}")


def segment(first: int, last: int) -> str:
    """The name of a segment's folder."""
    return f"{first:010d}-{last:010d}"


def block_manifest(rows: DataFrame, shards: int) -> DataFrame:
    """(shard, height, rows) for every shard and every height that any shard has; rows have a `shard`."""
    counts = rows.groupBy("shard", "height").agg(F.count(F.lit(1)).alias("rows"))
    every = rows.select("height").distinct().withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    return every.join(counts, ["shard", "height"], "left").fillna(0, ["rows"]).select("shard", "height", "rows")


def segments(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(first, last) of the segments that have a manifest, in order."""
    rows = spark.read.schema("first long, last long, shards int").json(f"{path}/manifest/*")
    return sorted((r["first"], r["last"]) for r in rows.select("first", "last").collect())


def read_shard(spark: SparkSession, path: str, shard: int, start_after: int, first: int, last: int) -> DataFrame:
    """A segment's rows of one shard above what is done already."""
    rows = spark.read.parquet(f"{path}/rows/{segment(first, last)}")
    return rows.where((F.col("shard") == shard) & (F.col("height") > start_after)).drop("shard")


def inject_shard(store: LogStore, path: str, shard: int, log: str, block_id: str = "") -> Checkpoint:
    """Writes one shard's segments in order; a hole raises, what is done is skipped, the checkpoint follows each segment."""
    key = shard_checkpoint_key(shard)
    done = store.checkpoint(key)
    fresh = done == Checkpoint()
    for first, last in segments(store.spark, path):
        if not fresh and last <= done.height:
            continue
        if not fresh and first > done.height + 1:
            raise ContiguityError(f"shard {shard}: {first} does not follow {done.height}")
        rows = read_shard(store.spark, path, shard, -1 if fresh else done.height, first, last)
        store.append(f"{log}/shard={shard}", rows, first)
        done, fresh = Checkpoint(last, BlockRef(last, block_id)), False
        store.commit(done, key)
    return done
