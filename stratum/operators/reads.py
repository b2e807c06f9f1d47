"""Point-in-time reads over an append-only log.

A log has the columns collection, identifier, height, seq and value, tablets
also pk.  Of rows with the same key and height the greatest seq holds.  A null
or empty value is a tombstone: it takes part in finding the newest version and
is dropped only then.  Speculative rows come with `ord` (their request) and `pos`
(their place in it): they override stored rows in that order whatever their
height.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from ..functions.keys import is_deletion

ENTITY = ("collection", "identifier")


def dead(rows: DataFrame) -> Column:
    """Whether a row is a tombstone: its value is null, or empty where values are bytes or text."""
    value = F.col("value")
    return is_deletion(value) if isinstance(rows.schema["value"].dataType, BinaryType | StringType) else value.isNull()


def live(rows: DataFrame) -> DataFrame:
    """Without tombstones; only for rows that are the newest of their keys."""
    return rows.where(~dead(rows))


def by_key(rows: DataFrame) -> DataFrame:
    """Rows in the order in which reads return them: by entity, then by primary key."""
    return rows.orderBy(*ENTITY, *(["pk"] if "pk" in rows.columns else []))


def latest(rows: DataFrame, keys: tuple[str, ...], *order: Column) -> DataFrame:
    """The first row of each key under the order; Spark limits groups before the shuffle too."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def upsert(rows: DataFrame, pk: bool = True) -> DataFrame:
    """One row for each stored key: of rows written again at one height, the last."""
    keys = (*ENTITY, "height", "pk") if pk else (*ENTITY, "height")
    return latest(rows, keys, F.desc("seq"))


def _merge(base: DataFrame, speculative: DataFrame | None, keys: tuple[str, ...]) -> DataFrame:
    if speculative is None:
        return latest(base, keys, F.desc("height"), F.desc("seq"))
    columns = base.columns
    both = base.withColumns({"_src": F.lit(0), "_ord": F.col("height"), "_pos": F.col("seq")}).unionByName(
        speculative.select(*[c for c in columns if c in speculative.columns], *[F.lit(None).cast(base.schema[c].dataType).alias(c) for c in columns if c not in speculative.columns],
                           F.lit(1).alias("_src"), F.col("ord").cast("long").alias("_ord"), F.col("pos").cast("long").alias("_pos"))
    )
    return latest(both, keys, F.desc("_src"), F.desc("_ord"), F.desc("_pos")).select(*columns)


def state_at(log: DataFrame, height: int, speculative: DataFrame | None = None) -> DataFrame:
    """Live rows of all tablets as of a height (inclusive), each with the height of its own last change."""
    return live(_merge(log.where(F.col("height") <= height), speculative, (*ENTITY, "pk")))


def row_at(log: DataFrame, height: int, pk, speculative: DataFrame | None = None) -> DataFrame:
    """The rows with one primary key; the key is part of the partition, so the predicate goes to the scan."""
    spec = None if speculative is None else speculative.where(F.col("pk") == pk)
    return state_at(log.where(F.col("pk") == pk), height, spec)


def singlet_at(log: DataFrame, height: int, speculative: DataFrame | None = None) -> DataFrame:
    """The value of every singlet as of a height; none for the absent and the deleted."""
    return live(_merge(log.where(F.col("height") <= height), speculative, ENTITY))


def history(log: DataFrame, speculative: DataFrame | None = None) -> DataFrame:
    """All entries of every singlet with their place `at`: speculative ones first, as given, then the stored from the newest; tombstones included."""
    stored = upsert(log, pk=False).withColumns({"_src": F.lit(1), "_ord": -F.col("height"), "_pos": F.lit(0).cast("long")})
    rows = stored
    if speculative is not None:
        spec = speculative.withColumns({"_src": F.lit(0), "_ord": F.col("ord").cast("long"), "_pos": F.col("pos").cast("long")})
        rows = stored.unionByName(spec.select(*stored.columns))
    w = Window.partitionBy(*ENTITY).orderBy("_src", "_ord", "_pos")
    return rows.withColumn("at", F.row_number().over(w).cast("long")).withColumn("is_deletion", dead(rows)).drop("_src", "_ord", "_pos")


def seen(log: DataFrame) -> DataFrame:
    """Every entity that has ever had a row, tombstones included."""
    return log.select(*ENTITY).distinct()


def has_seen(log: DataFrame, collection: int, identifier) -> bool:
    """Whether one entity has ever had a row; stops at the first."""
    return not log.where((F.col("collection") == collection) & (F.col("identifier") == identifier)).limit(1).isEmpty()


def as_of(probes: DataFrame, log: DataFrame, keys: tuple[str, ...], probe_height: str = "probe_height", probe_id: str = "probe_id") -> DataFrame:
    """For each probe, the newest row of its key at or below its height, if that isn't a tombstone.

    Versions and probes of a key are merged in one ordered pass (a running last
    value), so a key with many versions and many probes makes no pairs.
    """
    versions = log.select(*keys, F.col("height").alias("_h"), F.lit(0).alias("_kind"), F.col("seq").alias("_s"), F.struct("height", "seq", "value", dead(log).alias("dead")).alias("_v"), F.lit(None).cast(probes.schema[probe_id].dataType).alias(probe_id))
    asks = probes.select(*keys, F.col(probe_height).alias("_h"), F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("_s"), F.lit(None).cast(versions.schema["_v"].dataType).alias("_v"), probe_id)
    w = Window.partitionBy(*keys).orderBy("_h", "_kind", "_s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        versions.unionByName(asks)
        .withColumn("_last", F.last("_v", ignorenulls=True).over(w))
        .where("_kind = 1 and not _last.dead")
        .select(probe_id, *keys, F.col("_h").alias(probe_height), F.col("_last.height").alias("height"), F.col("_last.value").alias("value"))
    )
