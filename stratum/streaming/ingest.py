"""Blocks into logs: mapping, contiguity, and micro-batches that commit their checkpoint last."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import keys
from ..model import BlockRef, Checkpoint, ContiguityError
from ..operators.maintenance import index_tables
from ..sources.indexstore import IndexStore
from ..sources.logstore import LogStore
from .requests import singlet_entries, tablet_rows

#: A block maps to mutations by any DataFrame function: explode, a Python UDTF, mapInPandas.
BlockMapper = Callable[[DataFrame], DataFrame]


def json_mapper(blocks: DataFrame, per_block: int = 20) -> DataFrame:
    """events with JSON `props` as blocks: each key of props is one mutation."""
    entries = F.from_json("props", "map<string, double>")
    return blocks.select(
        F.lit(3).alias("collection"),
        F.col("event_type").alias("identifier"),
        F.floor(F.col("event_id") / per_block).cast("long").alias("height"),
        F.col("event_id").alias("seq"),
        F.explode(entries).alias("pk", "value"),
    )


def check_next(first_height: int | None, last: Checkpoint) -> None:
    """The first block of a batch follows the checkpoint; older ones may be replayed, a fresh store takes any."""
    if first_height is not None and last.height not in (0, 1) and first_height > last.height + 1:
        raise ContiguityError(f"height {first_height} does not follow {last.height}")


def write_batch(store: LogStore, log: str, rows: DataFrame, batch: int, skip_checkpoint: bool = False) -> None:
    """One batch of mutations of one log; an empty one does nothing, a repeated one replaces itself.

    The checkpoint names the block_id of the highest row, where rows have one.
    """
    block = F.max_by("block_id", "height") if "block_id" in rows.columns else F.max("height").cast("string")
    span = rows.agg(F.min("height").alias("lo"), F.max("height").alias("hi"), block.alias("block")).first()
    if span["lo"] is None:
        return
    last = store.checkpoint()
    check_next(span["lo"], last)
    store.append(log, rows, batch)
    if not skip_checkpoint and span["hi"] >= last.height:
        store.commit(Checkpoint(span["hi"], BlockRef(span["hi"], span["block"])))


@dataclass(frozen=True)
class Written:
    """What a batch of requests came to: the counters and sizes of its block log line."""

    requests: int = 0
    tablet_rows: int = 0
    singlet_entries: int = 0
    bytes: int = 0
    checkpoint: Checkpoint = Checkpoint()
    indexed: int = 0


def write_requests(store: LogStore, requests: DataFrame, batch: int, config: Config | None = None) -> Written:
    """Writes a batch of requests (REQUEST) into the logs `tablets` and `singlets`, then its checkpoint, then the snapshots that are due.

    The first request must follow the checkpoint; the height and block of the
    last one become the new checkpoint, unless the options say that it is to be
    skipped.  Nothing is written for an empty batch.
    """
    config = config or Config(store.path, inject=True)
    requests = requests.persist()  # every step below reads them, and they may be costly to make
    try:
        span = requests.agg(F.min("height").alias("lo"), F.max("height").alias("hi"), F.max_by("block", "height").alias("block"), F.count(F.lit(1)).alias("n")).first()
        if not span["n"]:
            return Written()
        last = store.checkpoint(config.checkpoint_key)
        check_next(span["lo"], last)
        counts, size = {}, 0
        for name, rows in (("tablets", tablet_rows(requests)), ("singlets", singlet_entries(requests))):
            key = keys.tablet_row_key(F.col("collection"), F.col("identifier"), F.col("height"), F.col("pk")) if name == "tablets" else keys.singlet_key_at(F.col("collection"), F.col("identifier"), F.col("height"))
            got = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(key) + F.coalesce(F.length("value"), F.lit(0))).alias("size")).first()
            counts[name], size = got["n"], size + (got["size"] or 0)
            if got["n"]:
                store.append(name, rows.drop("pos"), batch)
    finally:
        requests.unpersist()
    done = Checkpoint(span["hi"], BlockRef(span["block"]["num"], span["block"]["id"]))
    if not config.skip_checkpoint and span["hi"] >= last.height:
        store.commit(done, config.checkpoint_key)
    indexed = 0
    if not config.disable_indexing and store._exists("tablets"):
        indexed = index_tables(IndexStore(store), store.read("tablets").drop("bucket"), span["hi"], config.ignore_index_range).count()
    return Written(span["n"], counts["tablets"], counts["singlets"], size, done, indexed)


def start_requests(requests: DataFrame, store: LogStore, checkpoint_location: str, config: Config | None = None, **trigger):
    """A streaming query that writes requests (REQUEST) as they become final."""
    each = lambda batch, n: write_requests(store, batch, n, config)
    return requests.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint_location).trigger(**(trigger or {"availableNow": True})).start()


def start_ingest(
    blocks: DataFrame, store: LogStore, log: str, mapper: BlockMapper, checkpoint_location: str, block_filter: BlockMapper | None = None, **trigger
):
    """A streaming query that maps and writes final blocks; pass trigger arguments such as availableNow=True."""

    def each(batch: DataFrame, n: int) -> None:
        rows = mapper(block_filter(batch) if block_filter else batch)
        rows = rows.persist()
        try:
            write_batch(store, log, rows, n)
        finally:
            rows.unpersist()

    return blocks.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint_location).trigger(**(trigger or {"availableNow": True})).start()
