"""Jobs over stored snapshots: building those that are due, pruning, rebuilding."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.indexstore import KEY, IndexStore
from .indexing import prune, reindex, should_index, snapshot, squelched
from .reads import ENTITY, dead


def counters(log: DataFrame, newest: DataFrame | None, height: int) -> DataFrame:
    """Raw mutations of each entity above its newest snapshot up to a height, beside that: (entity, mutations, at_height, row_count)."""
    rows = log.where(F.col("height") <= height)
    if newest is None:
        none = F.lit(None).cast("long")
        return rows.groupBy(*ENTITY).agg(F.count(F.lit(1)).alias("mutations")).withColumns({"at_height": none, "row_count": none})
    above = rows.join(newest.select(*ENTITY, "at_height", "row_count"), list(ENTITY), "left").where("at_height is null or height > at_height")
    return above.groupBy(*ENTITY).agg(F.count(F.lit(1)).alias("mutations"), F.max("at_height").alias("at_height"), F.max("row_count").alias("row_count"))


def due(log: DataFrame, newest: DataFrame | None, height: int) -> DataFrame:
    """The entities that the policy wants a snapshot of."""
    return counters(log, newest, height).where(should_index(F.col("mutations"), F.col("row_count")))


def index_tables(indexes: IndexStore, log: DataFrame, height: int, ignore: tuple[int, int] = (0, 0)) -> DataFrame:
    """Writes a snapshot at `height` of every entity that is due; returns what was written: (entity, at_height, squelched, row_count, bytes, gone).

    Each is its entity's newest snapshot below (outside of the ignored range)
    and the mutations since; without one, all mutations.  The log is read once
    to find what is due and once for rows and counts together: what is kept in
    between is one row for each key.
    """
    wanted = due(log, indexes.newest(), height).select(*ENTITY).persist()
    mine = log.where(F.col("height") <= height).join(wanted, list(ENTITY), "left_semi")
    base = indexes.at(max(0, height - 1), ignore)
    if base is not None:
        base = base.join(wanted, list(ENTITY), "left_semi")
        mine = mine.join(base.select(*ENTITY, "at_height"), list(ENTITY), "left").where("at_height is null or height > at_height").drop("at_height")
    rows = mine.select(*ENTITY, "pk", "height", F.coalesce(F.col("seq").cast("long"), F.lit(-(1 << 63))).alias("seq"), (~dead(mine)).alias("live"), F.lit(1).cast("long").alias("n"))
    if base is not None:
        old = indexes.rows(base).select(*ENTITY, "pk", "height", F.lit(-1).cast("long").alias("seq"), F.lit(True).alias("live"), F.lit(0).cast("long").alias("n"))
        rows = rows.unionByName(old)
    # one shuffle by key, then hash aggregates over it: of each height the last row, of these the last and their number
    each = rows.repartition(*ENTITY, "pk").groupBy(*ENTITY, "pk", "height").agg(F.max_by("live", "seq").alias("live"), F.max("n").alias("n"))
    last = each.groupBy(*ENTITY, "pk").agg(F.max_by("live", "height").alias("live"), F.max("height").alias("height"), F.sum("n").alias("n")).persist()
    at = F.lit(height).cast("long").alias("at_height")
    meta = last.groupBy(*ENTITY).agg(F.sum("n").alias("squelched")).where("squelched > 0").select(*ENTITY, at, "squelched")
    try:
        return indexes.write(last.where("live").select(*ENTITY, "pk", at, "height"), meta)
    finally:
        last.unpersist()
        wanted.unpersist()


@dataclass(frozen=True)
class Counts:
    """Tablets that a job looked at, all snapshots that were listed, and those it deleted or wrote."""

    tablets: int
    indexes: int
    changed: int


def _counts(rows: DataFrame | None) -> tuple[int, int]:
    if rows is None:
        return 0, 0
    got = rows.agg(F.count_distinct(*ENTITY).alias("t"), F.count(F.lit(1)).alias("n")).first()
    return got["t"], got["n"]


def prune_tablet_indexes(indexes: IndexStore, frequency: int, height: int = 0, lower: Column | None = None, dry_run: bool = False) -> Counts:
    """Deletes every frequency-th snapshot as `prune` chooses them; a dry run counts them only.

    Tablets are those with more than frequency + 2 snapshots in the range.
    """
    if frequency <= 1:
        raise ValueError("a frequency above 1 is needed")
    meta = indexes.meta(height, lower)
    if meta is None:
        return Counts(0, 0, 0)
    gone = prune(meta, frequency).select(*KEY)
    many = meta.groupBy(*ENTITY).count().where(F.col("count") > frequency + 2).count()
    changed = gone.count()
    if changed and not dry_run:
        indexes.delete(gone)
    return Counts(many, _counts(meta)[1], changed)


def reindex_tablets(indexes: IndexStore, log: DataFrame, height: int = 0, lower: Column | None = None, dry_run: bool = False) -> Counts:
    """Rebuilds every stored snapshot from the log, all in one pass; a dry run counts them only."""
    meta = indexes.meta(height, lower)
    tablets, n = _counts(meta)
    if n and not dry_run:
        indexes.write(reindex(log, meta), squelched(log, meta))
    return Counts(tablets, n, 0 if dry_run else n)


def reindex_tablet(indexes: IndexStore, log: DataFrame, collection: int, identifier, height: int = 0, write: bool = False) -> tuple[DataFrame | None, bool]:
    """(rows of one tablet's newest snapshot up to a height, 0 for any, rebuilt from the log; whether they were written); None without one."""
    mine = (F.col("collection") == collection) & (F.col("identifier") == identifier)
    meta = indexes.meta(height)
    row = None if meta is None else meta.where(mine).orderBy(F.desc("at_height")).first()
    if row is None:
        return None, False
    one = meta.where(mine & (F.col("at_height") == row["at_height"]))
    own = log.where(mine)
    rows = snapshot(own, row["at_height"])
    if write:
        before = meta.where(mine & (F.col("at_height") <= row["at_height"]))
        counts = squelched(own, before).join(one.select(*KEY), list(KEY), "left_semi")
        indexes.write(rows, counts)
    return rows, write
