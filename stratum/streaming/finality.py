"""Finality as a stateful stream: reversible blocks wait in keyed state until they become final.

Finality is data (each block says which height is irreversible), not event
time: it may stall or jump, so no watermark stands in for it.

Of a table, where all blocks are there at once, nothing waits: the walk from the
head goes over ranges of heights, which are worked on side by side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.scratch import scratch

#: Blocks, and bytes of their texts, in one range of heights of a table (fixed values).
RANGE_ROWS = 200_000
RANGE_BYTES = 64 << 20
TREES = "chain string, id string, num long, parent_id string, lib_num long, payload string, tree long, pre long, size long, root boolean, top boolean"

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "chain string, id string, num long, parent_id string, payload string"


class Finality(StatefulProcessor):
    """Emits, in chain order, the blocks between the old and the new last irreversible block of the longest chain.

    The highest block seen is the head (of equally high ones the first), and it
    stays that between batches; finality is what the head's block says.  It moves
    only when the walk from the head reaches the block that was final last, or,
    at first, the first streamable height: as long as an ancestor is late,
    everything waits.

    A batch's blocks of one chain are held in memory; only those that still
    wait after it go into the state, where every access is a call of its own.
    """

    def __init__(self, first_streamable: int = 1):
        self.first_streamable = first_streamable

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getMapState("waiting", "id string", "num long, parent_id string, lib_num long, payload string")
        self.final = handle.getValueState("final", "num long, id string")
        self.head = handle.getValueState("head", "num long, id string, lib_num long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        final, final_id = self.final.get() if self.final.exists() else (-1, None)
        head = tuple(self.head.get()) if self.head.exists() else None
        fresh: dict[str, tuple[int, str, int, str]] = {}
        for batch in rows:
            batch = batch[batch["num"] > final].sort_values("num", kind="stable")
            for block_id, num, parent, lib, payload in zip(*(batch[c] for c in ("id", "num", "parent_id", "lib_num", "payload")), strict=True):
                fresh[block_id] = (int(num), parent, int(lib), payload)
                if head is None or num > head[0]:
                    head = (int(num), block_id, int(lib))
        if head is None:
            return
        self.head.update(head)
        out = self.walk(key[0], head, final, final_id, fresh) if head[2] > final else []
        if out:
            for (block_id,), (num, *_) in list(self.waiting.iterator()):
                if num <= head[2]:
                    self.waiting.removeKey((block_id,))
            self.final.update((out[0][2], out[0][1]))
        for block_id, block in fresh.items():
            if not out or block[0] > head[2]:
                self.waiting.updateValue((block_id,), block)
        if out:
            yield pd.DataFrame(out[::-1], columns=["chain", "id", "num", "parent_id", "payload"])

    def walk(self, chain, head: tuple[int, str, int], final: int, final_id: str | None, fresh: dict[str, tuple[int, str, int, str]]) -> list[tuple]:
        """Blocks from the new last irreversible one down to, but without, the old; none if an ancestor is missing."""
        out, at, lowest = [], head[1], None
        while at in fresh or self.waiting.containsKey((at,)):
            num, parent, _, payload = fresh[at] if at in fresh else self.waiting.getValue((at,))
            if final < num <= head[2]:
                out.append((chain, at, num, parent, payload))
            lowest, at = num, parent
        return out if at == final_id or (final_id is None and lowest <= self.first_streamable) else []

    def close(self) -> None:
        pass


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of heights, sorted by chain and height: every block's tree of links within the range, and its place there.

    Places are numbered so that a block's descendants follow it: those of b and
    what descends from it are from pre to pre + size.  root: its parent isn't in
    the range; top: none of its chain is higher there.
    """
    got = list(batches)
    if not got:
        return
    rows = pa.Table.from_batches(got).combine_chunks()
    chains = rows["chain"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    nums = rows["num"].to_numpy()
    starts = [0, *(np.flatnonzero(np.diff(chains)) + 1).tolist(), len(rows)]
    parent, top = np.full(len(rows), -1), np.zeros(len(rows), dtype=bool)
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        part = rows.slice(a, b - a)
        found = pc.index_in(part["parent_id"], value_set=part["id"].combine_chunks(), skip_nulls=True)
        at = pc.fill_null(found, -1).to_numpy().astype(np.int64)
        parent[a:b] = np.where((at >= 0) & (nums[a + at] < nums[a:b]), a + at, -1)
        top[a:b] = nums[a:b] == nums[b - 1]
    up = parent.tolist()
    size, pre, after, tree, free = [1] * len(up), [0] * len(up), [0] * len(up), [0] * len(up), 0
    for i in range(len(up) - 1, -1, -1):
        if up[i] >= 0:
            size[up[i]] += size[i]
    for i, p in enumerate(up):
        if p < 0:
            pre[i], tree[i] = free, i
            free += size[i]
        else:
            pre[i], tree[i] = after[p], tree[p]
            after[p] += size[i]
        after[i] = pre[i] + 1
    base = TaskContext.get().partitionId() << 32
    more = {"tree": np.array(tree, dtype=np.int64) + base, "pre": np.array(pre, dtype=np.int64), "size": np.array(size, dtype=np.int64), "root": parent < 0, "top": top}
    for name, values in more.items():
        rows = rows.append_column(name, pa.array(values))
    yield from rows.to_batches(10_000)


def _path(first_streamable: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def walk(links: pd.DataFrame) -> pd.DataFrame:
        """The trees on the way from a chain's head, with the place at which each is entered; none if the way ends too high."""
        by_tree = {t: rest for t, *rest in zip(*(links[c].tolist() for c in ("tree", "next", "entry", "lowest")), strict=True)}
        at, place, lib = (int(links[c].iloc[0]) for c in ("head_tree", "head_pre", "lib"))
        out = []
        while at >= 0:
            out.append((at, place, lib))
            at, place, lowest = by_tree[at]
        return pd.DataFrame(out if lowest <= first_streamable else [], columns=["tree", "place", "lib"])

    return walk


def final_table(blocks: DataFrame, first_streamable: int = 1) -> DataFrame:
    """Final blocks of a table: what the processor gives for one batch of all; of equally high heads the one with the least id.

    Ranges of heights are linked into trees, each in a task; of a chain, only
    the links between ranges come to one task.  A block's parent is lower than
    it, and an id names one block.
    """
    spark, path = blocks.sparkSession, scratch(blocks.sparkSession, "finality")
    columns = ["chain", "id", F.col("num").cast("long"), "parent_id", F.col("lib_num").cast("long"), "payload"]
    blocks.where("num > -1").select(*columns).write.parquet(f"{path}/blocks")
    rows = spark.read.parquet(f"{path}/blocks")
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in ("chain", "id", "parent_id", "payload")), F.lit(0).cast("long"))
    n = rows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()
    ranges = 1 + max(n["rows"] // RANGE_ROWS, n["bytes"] // RANGE_BYTES)
    rows.repartitionByRange(ranges, "chain", "num").sortWithinPartitions("chain", "num").mapInArrow(_trees, TREES).write.parquet(f"{path}/trees")
    trees = spark.read.schema(TREES).parquet(f"{path}/trees")
    trees.where("root").select("chain", "tree", "parent_id", F.col("num").alias("lowest")).write.parquet(f"{path}/roots")
    roots = spark.read.parquet(f"{path}/roots")
    below = trees.select(F.col("chain").alias("_chain"), "id", "num", F.col("tree").alias("next"), F.col("pre").alias("entry"))
    same = F.col("chain").eqNullSafe(F.col("_chain"))
    links = roots.join(below, same & (F.col("parent_id") == F.col("id")) & (F.col("num") < F.col("lowest")))
    links = links.groupBy("tree").agg(F.min(F.struct("next", "entry")).alias("_to")).select("tree", "_to.*")
    heads = trees.where("top").groupBy(F.col("chain").alias("_chain")).agg(F.min(F.struct((-F.col("num")).alias("_up"), "id", "lib_num", "tree", "pre")).alias("_head"))
    heads = heads.select("_chain", F.col("_head.lib_num").alias("lib"), F.col("_head.tree").alias("head_tree"), F.col("_head.pre").alias("head_pre")).where("lib >= 0")
    steps = roots.join(links, "tree", "left").fillna(-1, ["next", "entry"]).join(heads, same)
    steps = steps.select("chain", "tree", "next", "entry", "lowest", "head_tree", "head_pre", "lib")
    steps.groupBy("chain").applyInPandas(_path(first_streamable), "tree long, place long, lib long").write.parquet(f"{path}/path")
    inside = (F.col("pre") <= F.col("place")) & (F.col("place") < F.col("pre") + F.col("size")) & (F.col("num") <= F.col("lib"))
    return trees.join(spark.read.parquet(f"{path}/path"), "tree").where(inside).select("chain", "id", "num", "parent_id", "payload")


def final_blocks(blocks: DataFrame, first_streamable: int = 1) -> DataFrame:
    """Final blocks of a stream (or a table) of (chain, id, num, parent_id, lib_num, payload); a stream needs the RocksDB state store."""
    if not blocks.isStreaming:
        return final_table(blocks, first_streamable)
    return blocks.groupBy("chain").transformWithStateInPandas(Finality(first_streamable), OUT, "Append", "None")
