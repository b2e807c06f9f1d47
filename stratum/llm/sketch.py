"""A count sketch of a fixed size: how often hashes occur over all rows, as levels above the mean.

Every task counts into its own cells and gives them out in slices; slices are
summed by partitions, and one byte for each cell reaches the driver, whatever
the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textblock import U64

BITS = 22
CELLS = 1 << BITS  # 4 MB of levels
SLICE = 1 << 16


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U64(64 - BITS)).astype(np.int64)


def cells() -> np.ndarray:
    """A task's own cells."""
    return np.zeros(CELLS, dtype=np.int32)


def add(counts: np.ndarray, hashes: np.ndarray) -> None:
    """Counts hashes into a task's cells."""
    np.add(counts, np.bincount(_cell(hashes), minlength=CELLS), out=counts, casting="unsafe")


def pieces(counts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """(slice, counts): the slices of a task's cells that hold anything."""
    used = [i for i in range(CELLS // SLICE) if counts[i * SLICE : (i + 1) * SLICE].any()]
    return pa.array(used, pa.int32()), pa.array([counts[i * SLICE : (i + 1) * SLICE].tobytes() for i in used], pa.binary())


def levels_of(seen: DataFrame) -> np.ndarray:
    """From rows (slice, counts): for each cell how far above the mean it is, in eighths of powers of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in zip(batch.column("slice").to_pylist(), batch.column("counts"), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(part.as_buffer(), dtype=np.int32).astype(np.int64)
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["slice", "counts"])

    parts = seen.where("slice is not null").select("slice", "counts")
    counts = np.zeros(CELLS, dtype=np.int64)
    for row in parts.repartition(CELLS // SLICE, "slice").mapInArrow(run, "slice int, counts binary").toLocalIterator():
        counts[row["slice"] * SLICE : (row["slice"] + 1) * SLICE] += np.frombuffer(row["counts"], dtype=np.int64)
    mean = max(1.0, counts.sum() / CELLS)
    return np.minimum(np.floor(8 * np.log2(np.maximum(counts / mean, 1))), 255).astype(np.uint8)


def level(levels: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return levels[_cell(hashes)]
