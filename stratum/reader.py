"""Reads of a store that may have a live chain above it, and what a process knows of itself."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import BlockNotFound, BlockRef, Checkpoint, NotReady
from .operators import reads
from .operators.forks import ForkView
from .plans.snapshots import row_with_indexes, state_with_indexes
from .sources.indexstore import IndexStore
from .sources.logstore import LogStore
from .streaming.requests import WriteRequest, as_frame, speculative

#: A block younger than this is near real time (seconds, fixed value).
NEAR = 15.0


@contextmanager
def span(spark: SparkSession, name: str) -> Iterator[None]:
    """Jobs inside carry the name in Spark's UI and event log."""
    sc = spark.sparkContext
    before = sc.getLocalProperty("spark.job.description")
    sc.setJobDescription(name)
    try:
        yield
    finally:
        sc.setLocalProperty("spark.job.description", before)


@dataclass
class Metrics:
    """Gauges of a process: the head's number, and how old its block was when it came (seconds)."""

    head_block_number: int = 0
    head_block_time_drift: float = 0.0
    ready: bool = False

    def saw(self, num: int, block_time: float, head_known: bool, now: float | None = None) -> None:
        """A new block at a time (epoch seconds); the first recent one behind a known head makes the process ready."""
        now = time.time() if now is None else now
        self.head_block_number, self.head_block_time_drift = num, now - block_time
        if not self.ready and head_known and now - NEAR < block_time:
            self.ready = True


class Reader:
    """Queries by height, or by block on any known fork, over the logs `tablets` and `singlets`.

    Without a view (no live chain) the head is the checkpoint's block and
    nothing is speculative.
    """

    def __init__(self, store: LogStore, view: ForkView | None = None, indexes: IndexStore | None = None):
        self.store, self.spark, self.view = store, store.spark, view
        self.indexes = indexes or IndexStore(store)
        self.metrics = Metrics()

    def process(self, step: str, request: WriteRequest, parent_id: str, block_time: float, now: float | None = None) -> None:
        """Takes up a block of the live chain; as a reader it follows the writer's checkpoint."""
        if self.view is None:
            raise NotReady("this reader has no live chain")
        if step == "new":
            self.metrics.saw(request.block.num, block_time, self.view.head is not None, now)
        self.view.process(step, request.block.id, request.block.num, parent_id, request, self.store.checkpoint)

    def head(self) -> BlockRef:
        if self.view is not None and self.view.head is not None:
            return BlockRef(self.view.blocks[self.view.head][0], self.view.head)
        return self.store.checkpoint().block

    def speculative(self, block: BlockRef | None = None) -> tuple[list[WriteRequest], int]:
        """(requests above finality up to a block, the final height they stand on); the block may be a number alone."""
        if self.view is not None:
            return self.view.speculative(None if block is None or block.id else block.num, None if block is None else block.id or None)
        head = self.head()
        if head == BlockRef():
            raise NotReady("nothing has been written yet")
        if block is None:
            return [], 0
        if block.num > head.num:
            raise BlockNotFound(f"block {block.num} is above the head")
        return [], block.num

    def reversible(self, block_id: str) -> tuple[BlockRef, WriteRequest] | None:
        """One block that isn't final, and its writes."""
        found = None if self.view is None else self.view.reversible(block_id)
        return None if found is None else (BlockRef(found[0], block_id), found[1])

    def _overlay(self, block: BlockRef | None, kind: str) -> DataFrame | None:
        if self.view is None:
            return None
        requests, _ = self.speculative(block)
        # what the writer has committed meanwhile is stored already
        done = self.store.checkpoint().height
        requests = [r for r in requests if r.height > done]
        return speculative(as_frame(self.spark, requests), kind) if requests else None

    def _log(self, name: str) -> DataFrame:
        return self.store.read(name).drop("bucket")

    def tablets(self, height: int, block: BlockRef | None = None) -> DataFrame:
        """Live rows of all tablets as of a height, with the writes up to a block on top, in order of their keys."""
        with span(self.spark, f"tablets at {height}"):
            log, spec = self._log("tablets"), self._overlay(block, "tablet_rows")
            meta = self.indexes.at(height)
            if meta is None:
                return reads.by_key(reads.state_at(log, height, spec))
            return reads.by_key(state_with_indexes(log, meta, self.indexes.rows(meta), height, spec))

    def tablet(self, collection: int, identifier, height: int, block: BlockRef | None = None) -> DataFrame:
        """Live rows of one tablet."""
        return self.tablets(height, block).where((F.col("collection") == collection) & (F.col("identifier") == identifier))

    def tablet_row(self, height: int, pk, block: BlockRef | None = None) -> DataFrame:
        """The rows with one primary key."""
        log, spec = self._log("tablets"), self._overlay(block, "tablet_rows")
        meta = self.indexes.at(height)
        if meta is None:
            return reads.row_at(log, height, pk, spec)
        return row_with_indexes(log, meta, self.indexes.rows(meta), height, pk, spec)

    def singlets(self, height: int, block: BlockRef | None = None) -> DataFrame:
        return reads.by_key(reads.singlet_at(self._log("singlets"), height, self._overlay(block, "singlet_entries")))

    def history(self, block: BlockRef | None = None) -> DataFrame:
        return reads.history(self._log("singlets").select("collection", "identifier", "height", "value", "seq"), self._overlay(block, "singlet_entries"))

    def checkpoint(self) -> Checkpoint:
        return self.store.checkpoint()
