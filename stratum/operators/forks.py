"""Forks: walking from a block to finality, and prefixes of the speculative list."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import BlockNotFound, Checkpoint, NotReady


def segment(blocks: DataFrame, head_id, lib_num: int, window: int = 50_000) -> DataFrame:
    """Blocks from a head down to, but without, the last irreversible one: (id, num, parent_id).

    Parents are lower than their children, so only heights between finality
    and the head matter.  Up to `window` such blocks, which is far more than
    chains keep reversible, the links are walked on the driver (three short
    values for each, read once); beyond, a recursive query walks them.
    """
    spark = blocks.sparkSession
    head = blocks.where(F.col("id") == head_id).select("num").first()
    near = blocks.where((F.col("num") > lib_num) & (F.col("num") <= (head["num"] if head else lib_num))).select("id", "num", "parent_id")
    got = near.limit(window + 1).collect()
    if len(got) > window:
        return _recursive(near, head_id)
    links = {r["id"]: r for r in got}
    rows, at = [], head_id
    while at in links:
        rows.append(tuple(links[at]))
        at = links[at]["parent_id"]
    return spark.createDataFrame(rows, near.schema)


def _recursive(blocks: DataFrame, head_id) -> DataFrame:
    # the session's limits are lifted for this walk alone
    spark = blocks.sparkSession
    limits = ("spark.sql.cteRecursionLevelLimit", "spark.sql.cteRecursionRowLimit")
    before = {c: spark.conf.get(c) for c in limits}
    for c in limits:
        spark.conf.set(c, "-1")
    try:
        rows = spark.sql(
            """
            WITH RECURSIVE walk(id, num, parent_id) AS (
                SELECT id, num, parent_id FROM {blocks} WHERE id = :head
                UNION ALL
                SELECT b.id, b.num, b.parent_id FROM walk w JOIN {blocks} b ON b.id = w.parent_id
            ) SELECT id, num, parent_id FROM walk
            """,
            args={"head": head_id},
            blocks=blocks,
        )
        return spark.createDataFrame(rows.toArrow()) if not rows.isEmpty() else rows.limit(0)  # the walk runs here, under these limits
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def prefix_by_height(speculative: DataFrame, num: int) -> DataFrame:
    """The part of the ordered list up to a height."""
    return speculative.where(F.col("height") <= num)


def prefix_by_id(speculative: DataFrame, block_id) -> DataFrame:
    """The part of the ordered list up to and with a block; empty if it isn't on this chain."""
    upto = speculative.where(F.col("block_id") == block_id).groupBy().agg(F.max("ord").alias("_upto"))
    return speculative.crossJoin(F.broadcast(upto)).where("ord <= _upto").drop("_upto")  # one row


class ForkView:
    """The reversible blocks that a reader or writer knows, on the driver: a few hundred at most.

    Blocks link by parent ids; writes of the current chain above the last
    irreversible block are speculative, in chain order.
    """

    def __init__(self, first_streamable: int = 1, keep_below: int = 0, poll_seconds: float = 2.0):
        self.blocks: dict[str, tuple[int, str, object]] = {}
        self.first_streamable, self.keep_below = first_streamable, keep_below
        self.poll_seconds, self.polled = poll_seconds, float("-inf")
        self.head: str | None = None
        self.lib: tuple[int, str] | None = None

    def add(self, block_id: str, num: int, parent_id: str, writes: object = None) -> None:
        """A new block; the first streamable one is final at once."""
        self.blocks[block_id] = (num, parent_id, writes)
        self.head = block_id
        if num == self.first_streamable and self.lib is None:
            self.lib = (num, block_id)

    def process(self, step: str, block_id: str, num: int, parent_id: str = "", writes: object = None, checkpoint: Callable[[], Checkpoint] | None = None) -> None:
        """One step of the block stream: `new`, or `irreversible`; no other exists.

        With a checkpoint (a reader beside a writer) finality follows what the
        writer has committed, looked up every two seconds at most; else the
        block itself is final.
        """
        if step == "new":
            self.add(block_id, num, parent_id, writes)
        elif step != "irreversible":
            raise ValueError(f"a block is new or irreversible, not {step!r}")
        elif checkpoint is None:
            self.finalize(block_id, num)
        elif (now := time.monotonic()) - self.polled >= self.poll_seconds:
            self.polled = now
            self.follow(checkpoint(), num)

    def follow(self, written: Checkpoint, num: int) -> None:
        """Moves finality to the writer's block if that is known, above the old one, and below the block at hand."""
        low = -1 if self.lib is None else self.lib[0]
        if low < written.block.num < num and written.block.id in self.blocks:
            self.finalize(written.block.id, written.block.num)

    def finalize(self, block_id: str, num: int) -> None:
        """Moves finality and forgets what is too far below it."""
        self.lib = (num, block_id)
        self.blocks = {k: v for k, v in self.blocks.items() if v[0] >= num - self.keep_below}

    def chain(self, block_id: str) -> list[str]:
        """Ids from above finality to the block."""
        if self.lib is None:
            raise NotReady("no irreversible block is known yet")
        out, at = [], block_id
        while at != self.lib[1]:
            if at not in self.blocks or self.blocks[at][0] <= self.lib[0]:
                raise BlockNotFound(block_id)
            out.append(at)
            at = self.blocks[at][1]
        return out[::-1]

    def speculative(self, num: int | None = None, block_id: str | None = None) -> tuple[list[object], int]:
        """(writes in chain order, height of finality) for the head, a height, or a block on any known fork.

        A block at finality or below isn't on a fork, but for the first
        streamable one, whose own writes are given.
        """
        if self.lib is None or self.head is None:
            raise NotReady("no irreversible block is known yet")
        head = self.blocks[self.head][0]
        if block_id in self.blocks:
            num = self.blocks[block_id][0] if num is None else num
        if num is not None and num > head:
            raise BlockNotFound(f"block {num} is above the head")
        if block_id and block_id == self.lib[1] and self.lib[0] == self.first_streamable and block_id in self.blocks:
            return [self.blocks[block_id][2]], self.lib[0]
        if block_id and self.lib[1] == block_id:
            return [], self.lib[0]
        ids = self.chain(block_id or self.head)
        if num is not None and not block_id:
            ids = [i for i in ids if self.blocks[i][0] <= num]
        return [self.blocks[i][2] for i in ids], self.lib[0]

    def reversible(self, block_id: str):
        """(num, writes) of one reversible block, or None."""
        found = self.blocks.get(block_id)
        return None if found is None else (found[0], found[2])
