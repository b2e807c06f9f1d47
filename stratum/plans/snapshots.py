"""Snapshot substitution: a read at a height from the newest snapshot below and the changes since."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.indexing import check_rows, hydrate, index_at
from ..operators.reads import ENTITY, _merge, live


def choose(heights: list[int], height: int) -> int | None:
    """The newest snapshot at or below a height."""
    return max((h for h in heights if h <= height), default=None)


def state_from_snapshot(log: DataFrame, index_rows: DataFrame, at_height: int, height: int, speculative: DataFrame | None = None) -> DataFrame:
    """state_at(log, height) from a snapshot at at_height; the log is read for its keys and above it only."""
    base = hydrate(index_rows.select(*ENTITY, "pk", "height"), log.where(F.col("height") <= at_height)).select(*log.columns)
    delta = log.where((F.col("height") > at_height) & (F.col("height") <= height))
    return live(_merge(base.unionByName(delta), speculative, (*ENTITY, "pk")))


def state_with_indexes(log: DataFrame, meta: DataFrame, index_rows: DataFrame, height: int, speculative: DataFrame | None = None, check: bool = False) -> DataFrame:
    """state_at(log, height) with the newest snapshot of each entity below it, where there is one.

    meta: (entity, at_height); index_rows: rows of those snapshots.  Below its
    snapshot an entity's log is read for the snapshot's keys alone.  check: an
    entity of whose snapshot nothing is stored raises.
    """
    newest = index_at(meta, height)
    rows = index_rows.join(newest, [*ENTITY, "at_height"], "left_semi").select(*ENTITY, "pk", "height")
    stored = log.where(F.col("height") <= height)
    if check:
        check_rows(rows, stored)
    since = stored.join(newest, list(ENTITY), "left").where("at_height is null or height > at_height").drop("at_height")
    base = hydrate(rows, stored).select(*log.columns)
    return live(_merge(base.unionByName(since.select(*log.columns)), speculative, (*ENTITY, "pk")))


def row_with_indexes(log: DataFrame, meta: DataFrame, index_rows: DataFrame, height: int, pk, speculative: DataFrame | None = None, check: bool = False) -> DataFrame:
    """row_at(log, height, pk) the same way: only the one key is looked up."""
    spec = None if speculative is None else speculative.where(F.col("pk") == pk)
    return state_with_indexes(log.where(F.col("pk") == pk), meta, index_rows.where(F.col("pk") == pk), height, spec, check)
