"""Snapshots of live keys: building, policy, pruning, rebuilding, listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import NotFound
from .reads import ENTITY, dead, latest, live, upsert

#: Mutations since the last snapshot from which one is due, and the sizes at which that changes (fixed values).
INDEX_AFTER = 25_000
LARGE_INDEX = 50_000
HUGE_HALF = 100_000
#: Heights of an entity that are ordered in one group before groups are (fixed value).
RANGE = 8_192
#: Snapshots of an entity whose heights come to a change as one array (fixed value).
CHUNK = 64


def snapshot(log: DataFrame, at_height: int) -> DataFrame:
    """Live keys as of a height with the height of their last change: (collection, identifier, pk, at_height, height)."""
    rows = latest(log.where(F.col("height") <= at_height), (*ENTITY, "pk"), F.desc("height"), F.desc("seq"))
    rows = live(rows)
    return rows.select(*ENTITY, "pk", F.lit(at_height).cast("long").alias("at_height"), "height")


def snapshot_stats(log: DataFrame, at_height: int, since: int | None = None) -> DataFrame:
    """For each entity the live rows at a height and the stored mutations after `since`."""
    scanned = upsert(log.where((F.col("height") <= at_height) & (F.col("height") > (since if since is not None else -1)))).groupBy(*ENTITY).agg(
        F.count(F.lit(1)).alias("squelched")
    )
    live = snapshot(log, at_height).groupBy(*ENTITY).agg(F.count(F.lit(1)).alias("live_rows"))
    return scanned.join(live, list(ENTITY), "full").select(
        *ENTITY, F.coalesce("live_rows", F.lit(0)).alias("live_rows"), F.coalesce("squelched", F.lit(0)).alias("squelched")
    )


def advance(previous: DataFrame, log: DataFrame, since: int, at_height: int) -> DataFrame:
    """The snapshot at a height from an earlier one and the mutations in between; nothing older is read."""
    base = previous.select(*ENTITY, "pk", "height", F.lit(-1).cast("long").alias("seq"), F.lit(True).alias("live"))
    delta = log.where((F.col("height") > since) & (F.col("height") <= at_height)).select(
        *ENTITY, "pk", "height", "seq", (~dead(log)).alias("live")
    )
    rows = latest(base.unionByName(delta), (*ENTITY, "pk"), F.desc("height"), F.desc("seq")).where("live")
    return rows.select(*ENTITY, "pk", F.lit(at_height).cast("long").alias("at_height"), "height")


def should_index(mutations: Column, index_rows: Column) -> Column:
    """Whether a snapshot is due; index_rows is null without an earlier one."""
    half = F.floor(index_rows / 2)
    return (
        F.when(mutations < INDEX_AFTER, False)
        .when(index_rows.isNull() | (index_rows <= LARGE_INDEX), True)
        .when(half > HUGE_HALF, mutations >= HUGE_HALF)
        .otherwise(mutations > half)
    )


def prune(indexes: DataFrame, frequency: int, keys: tuple[str, ...] = ENTITY, at: str = "at_height") -> DataFrame:
    """The snapshots that go: every frequency-th from the newest, but for the newest and the oldest, of entities with more than frequency + 2."""
    if frequency <= 1:
        raise ValueError("a frequency above 1 is needed")
    w = Window.partitionBy(*keys)
    ranked = indexes.withColumn("_pos", F.row_number().over(w.orderBy(F.desc(at)))).withColumn("_n", F.count(F.lit(1)).over(w))
    return ranked.where((F.col("_n") > frequency + 2) & (F.col("_pos") > 1) & (F.col("_pos") < F.col("_n")) & ((F.col("_pos") - 1) % frequency == 0)).drop("_pos", "_n")


def index_at(indexes: DataFrame, height: int, ignore: tuple[int, int] = (0, 0)) -> DataFrame:
    """The newest snapshot of each entity at or below a height, outside of the ignored range (start, stop]."""
    rows = indexes.where(F.col("at_height") <= height)
    start, stop = ignore
    if start and stop and start < stop:
        rows = rows.where(~((F.col("at_height") > start) & (F.col("at_height") <= stop)))
    return rows.groupBy(*ENTITY).agg(F.max("at_height").alias("at_height"))


def _changes(log: DataFrame, *following: str) -> DataFrame:
    """The stored changes of each key, in one pass; with these columns of its next change as _next_..., null for the last one."""
    w = Window.partitionBy(*ENTITY, "pk").orderBy("height", "seq")
    columns = {f"_next_{c}": F.lead(c).over(w) for c in {"height", *following}}
    # of rows written again at one height, the last is followed by another height
    return log.where("height is not null").withColumns(columns).where("_next_height is null or _next_height > height")


def _heights(rows: DataFrame, marks: DataFrame, step: Column) -> DataFrame:
    """Each height of an entity once, in ranges of heights: (entity, height, _range, step, _mark: whether it is a snapshot's)."""
    known = rows.dropna(subset=[*ENTITY, "height"]).select(*ENTITY, "height", step.cast("long").alias("step"), F.lit(False).alias("_mark"))
    own = marks.select(*ENTITY, F.col("at_height").alias("height"), F.lit(0).cast("long").alias("step"), F.lit(True).alias("_mark"))
    both = known.unionByName(own).groupBy(*ENTITY, "height").agg(F.sum("step").alias("step"), F.max("_mark").alias("_mark"))
    return both.withColumn("_range", F.expr(f"height div {RANGE}"))


def _running(rows: DataFrame, marks: DataFrame, step: Column) -> DataFrame:
    """For every snapshot the sum of `step` over the rows at or below its height: (entity, at_height, total).

    Within a range of heights, steps go to the next snapshot there or to the
    range's end; only these sums are ordered for the whole entity.
    """
    within = Window.partitionBy(*ENTITY, "_range").orderBy(F.desc("height")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    following = F.min(F.when(F.col("_mark"), F.col("height"))).over(within)
    sums = _heights(rows, marks, step).withColumn("at_height", following).groupBy(*ENTITY, "_range", "at_height").agg(F.sum("step").alias("step"), F.max("_mark").alias("_mark"))
    run = Window.partitionBy(*ENTITY).orderBy("_range", F.asc_nulls_last("at_height")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sums.withColumn("total", F.sum("step").over(run)).where("_mark").select(*ENTITY, "at_height", "total")


def _places(log: DataFrame, marks: DataFrame) -> DataFrame:
    """For every height in the log the number of its entity's snapshots below it: (entity, height, _place)."""
    heights = _heights(log, marks, F.lit(0))
    one = F.col("_mark").cast("long")
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    ranges = heights.groupBy(*ENTITY, "_range").agg(F.sum(one).alias("_n"))
    ranges = ranges.select(*ENTITY, "_range", F.coalesce(F.sum("_n").over(before(*ENTITY, "_range")), F.lit(0)).alias("_below"))
    inside = heights.withColumn("_in", F.coalesce(F.sum(one).over(before(*ENTITY, "_range", "height")), F.lit(0)))
    return inside.join(ranges, [*ENTITY, "_range"]).select(*ENTITY, "height", (F.col("_in") + F.col("_below")).alias("_place"))


def reindex(log: DataFrame, indexes: DataFrame) -> DataFrame:
    """Every snapshot recomputed from the log: (entity, pk, at_height, height).

    A key is live from a change to the next, so a change belongs to the
    snapshots in between: they are numbered by height within their entity, a
    change knows the numbers it lies between, and the heights come to it in
    arrays of a fixed length, as many as it needs.  Only rows of the result are
    made.
    """
    marks = indexes.select(*ENTITY, "at_height").distinct().where("at_height is not null")
    numbered = marks.withColumn("_place", F.row_number().over(Window.partitionBy(*ENTITY).orderBy("at_height")) - 1)
    chunks = numbered.groupBy(*ENTITY, F.expr(f"_place div {CHUNK}").alias("_chunk")).agg(F.sort_array(F.collect_list("at_height")).alias("_marks"))
    counts = marks.groupBy(*ENTITY).agg(F.count(F.lit(1)).alias("_n"))
    rows = log.select(*ENTITY, "height", "pk", "seq", (~dead(log)).alias("_live")).join(_places(log, marks), [*ENTITY, "height"])
    spans = _changes(rows, "_place").where("_live").join(counts, list(ENTITY))
    spans = spans.withColumn("_end", F.coalesce("_next__place", "_n")).where("_place < _end")
    parts = spans.withColumn("_chunk", F.explode(F.sequence(F.expr(f"_place div {CHUNK}"), F.expr(f"(_end - 1) div {CHUNK}"))))
    first = F.greatest(F.col("_place") - F.col("_chunk") * CHUNK, F.lit(0))
    stop = F.least(F.col("_end") - F.col("_chunk") * CHUNK, F.lit(CHUNK))
    mine = F.slice("_marks", (first + 1).cast("int"), (stop - first).cast("int"))
    return parts.join(chunks, [*ENTITY, "_chunk"]).withColumn("at_height", F.explode(mine)).select(*ENTITY, "pk", "at_height", "height")


def squelched(log: DataFrame, indexes: DataFrame) -> DataFrame:
    """For every snapshot the stored mutations since the one before: (entity, at_height, squelched)."""
    keys = log.select(*ENTITY, "height", "pk").distinct()
    sums = _running(keys, indexes.select(*ENTITY, "at_height"), F.lit(1))
    before = F.lag("total", 1, 0).over(Window.partitionBy(*ENTITY).orderBy("at_height"))
    return sums.select(*ENTITY, "at_height", (F.col("total") - before).alias("squelched"))


def live_counts(log: DataFrame, indexes: DataFrame) -> DataFrame:
    """Live rows of every snapshot, without the rows: (entity, at_height, live_rows).

    Each change adds or takes one from its height on.  Steps are summed between
    two marks before anything is ordered, so the running sum goes over
    snapshots, not over changes.
    """
    w = Window.partitionBy(*ENTITY, "pk").orderBy("height")
    changes = _changes(log.select(*ENTITY, "height", "pk", "seq", (~dead(log)).cast("long").alias("live")))
    steps = changes.withColumn("step", F.col("live") - F.coalesce(F.lag("live").over(w), F.lit(0)))
    return _running(steps, indexes.select(*ENTITY, "at_height"), F.col("step")).withColumnRenamed("total", "live_rows")


def list_indexes(indexes: DataFrame, height: int = 0, lower: Column | None = None, key: str = "identifier") -> DataFrame:
    """Snapshots of each entity counted; height 0 is no bound, lower bounds the entity key."""
    rows = indexes if height == 0 else indexes.where(F.col("at_height") <= height)
    if lower is not None:
        rows = rows.where(F.col(key) >= lower)
    return rows.groupBy(*ENTITY).agg(
        F.count(F.lit(1)).alias("indexes"), F.min("at_height").alias("first_height"), F.max("at_height").alias("last_height")
    )


def hydrate(index_rows: DataFrame, log: DataFrame) -> DataFrame:
    """Values of a snapshot's keys: an equi-join on the full key, which the engine broadcasts only if it finds it small.

    Keys that the log lacks are left out; a stored value that is empty is an error.
    """
    rows = index_rows.join(upsert(log), [*ENTITY, "pk", "height"])
    broken = F.concat(F.lit("a snapshot names a deleted row of "), F.col("identifier").cast("string"), F.lit(" at height "), F.col("height").cast("string"))
    return rows.where(F.when(dead(rows), F.raise_error(broken).cast("boolean")).otherwise(True))


def missing_entities(index_rows: DataFrame, log: DataFrame) -> DataFrame:
    """Entities of whose snapshot the log has no row at all."""
    found = index_rows.select(*ENTITY, "pk", "height").join(log.select(*ENTITY, "pk", "height").distinct(), [*ENTITY, "pk", "height"], "left_semi")
    return index_rows.select(*ENTITY).distinct().join(found.select(*ENTITY).distinct(), list(ENTITY), "left_anti")


def check_rows(index_rows: DataFrame, log: DataFrame) -> None:
    """Raises if nothing of an entity's snapshot is stored: the read behind it can't be right."""
    lost = missing_entities(index_rows, log).select(*ENTITY).limit(5).collect()
    if lost:
        raise NotFound(f"no row of these entities' snapshots is stored: {[tuple(r) for r in lost]}")


def as_maps(index_rows: DataFrame, meta: DataFrame) -> DataFrame:
    """The short form: (entity, at_height, squelched, rows as a map from primary key to height); one without rows has an empty map.

    One snapshot is one value here, for interchange; jobs use the long form.
    """
    maps = index_rows.groupBy(*ENTITY, "at_height").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("pk", "height")))).alias("rows"))
    none = F.map_from_arrays(F.array().cast(f"array<{index_rows.schema['pk'].dataType.simpleString()}>"), F.array().cast("array<bigint>"))
    return meta.select(*ENTITY, "at_height", "squelched").join(maps, [*ENTITY, "at_height"], "left").withColumn("rows", F.coalesce("rows", none))


def from_maps(maps: DataFrame) -> DataFrame:
    """The long form of as_maps: (entity, pk, at_height, height)."""
    return maps.select(*ENTITY, "at_height", F.explode("rows").alias("pk", "height")).select(*ENTITY, "pk", "at_height", "height")
