"""Settings of the four run modes and their validation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from .model import live_checkpoint_key, shard_checkpoint_key

@dataclass(frozen=True)
class Config:
    """server answers reads, inject writes, the two reprocessing modes split and write shards."""

    store: str
    server: bool = False
    inject: bool = False
    shard: bool = False
    inject_shards: bool = False
    shard_count: int = 0
    shard_index: int = 0
    start: int = 0
    stop: int = 0
    disable_indexing: bool = False
    skip_checkpoint: bool = False
    ignore_index_range: tuple[int, int] = (0, 0)
    on_server: Callable | None = None  # called with the reader before it serves
    on_inject: Callable | None = None  # called with the store before the first write; not if the server mode runs too

    @property
    def checkpoint_key(self) -> str:
        """Sharded writing has a checkpoint for each shard."""
        return shard_checkpoint_key(self.shard_index) if self.inject_shards else live_checkpoint_key()

    def validate(self) -> None:
        modes = [self.server or self.inject, self.shard, self.inject_shards]
        if sum(modes) != 1:
            raise ValueError("choose server and/or inject, or one of the two reprocessing modes")
        if (self.shard or self.inject_shards) and self.shard_count <= 0:
            raise ValueError("a shard count above 0 is needed")
        if self.inject_shards and not 0 <= self.shard_index < self.shard_count:
            raise ValueError("the shard index is below the shard count")
        if self.shard and self.stop < self.start:
            raise ValueError("stop is at start or above")
