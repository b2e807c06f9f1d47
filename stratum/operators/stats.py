"""Counters over writes and shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import ContiguityError
from .reads import ENTITY


def mutation_counts(writes: DataFrame) -> DataFrame:
    """Raw mutations of each entity: deletions and rewrites of one key count too."""
    return writes.groupBy(*ENTITY).agg(F.count(F.lit(1)).alias("mutations"))


def write_stats(writes: DataFrame, size: Column) -> DataFrame:
    """Rows and bytes of each entity."""
    return writes.groupBy(*ENTITY).agg(F.count(F.lit(1)).alias("rows"), F.sum(size).alias("bytes"))


def totals(writes: DataFrame, size: Column) -> DataFrame:
    """One row over all writes: rows, entities, bytes."""
    return writes.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(*ENTITY).alias("entities"), F.sum(size).alias("bytes"))


def top_entities(stats: DataFrame, n: int = 5) -> DataFrame:
    """The entities with the most bytes; ties by entity."""
    return stats.orderBy(F.desc("bytes"), *ENTITY).limit(n)


def shard_of(shards: int) -> Column:
    """All versions of an entity are in one shard."""
    return F.pmod(F.xxhash64(*ENTITY), F.lit(shards)).cast("int")


def shard_stats(writes: DataFrame, shard: Column) -> DataFrame:
    """Rows, blocks and last height of each shard."""
    return writes.groupBy(shard.alias("shard")).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("height").alias("blocks"), F.max("height").alias("last_height")
    )


def shard_progress(checkpoints: DataFrame, shards: int) -> DataFrame:
    """(shard, height, status) for every shard: `missing` without a checkpoint, `faulty` away from the reference, else `done`.

    The reference is the checkpoint of the first shard that has one.
    """
    every = checkpoints.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    first = checkpoints.groupBy().agg(F.min_by("height", "shard").alias("reference"))
    rows = every.join(checkpoints, "shard", "left").crossJoin(F.broadcast(first))  # one row
    status = F.when(F.col("height").isNull(), "missing").when(F.col("height") != F.col("reference"), "faulty").otherwise("done")
    return rows.select("shard", "height", status.alias("status"))


def verify_all_shards(checkpoints: DataFrame, shards: int) -> None:
    """Raises unless every shard is at the reference."""
    bad = [(r["shard"], r["status"]) for r in shard_progress(checkpoints, shards).where("status <> 'done'").limit(20).collect()]
    if bad:
        raise ContiguityError(f"shards not written: {bad}")
