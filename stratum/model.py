"""Collections, their registry, and the errors of the engine."""

from __future__ import annotations

from dataclasses import dataclass, field


class StratumError(Exception):
    """Base of the engine's errors."""


class NotFound(StratumError):
    """Nothing is stored under what was asked for."""


class BlockNotFound(NotFound):
    """The requested block is above the head, below finality, or not on a known fork."""


class NotReady(StratumError):
    """Finality isn't known yet."""


class InvalidKey(StratumError):
    """Bytes that aren't a key of the expected kind."""


class ContiguityError(StratumError):
    """A write or a shard file does not follow what is stored."""


#: Ids from here on are reserved (fixed value).
RESERVED_COLLECTIONS = 0xFFEF
#: Collection of the snapshots themselves (fixed value).
INDEX_COLLECTION = 0xFFFF


@dataclass(frozen=True)
class CollectionSpec:
    """A kind of entity: `tablet` owns rows with primary keys, `singlet` a single value."""

    id: int
    name: str
    kind: str
    identifier_bytes: int | None = None
    pk_bytes: int | None = None

    def __post_init__(self):
        if self.kind not in ("tablet", "singlet"):
            raise ValueError(f"unknown kind {self.kind!r}")


@dataclass
class Registry:
    """Collections by id; ids are unique across both kinds."""

    specs: dict[int, CollectionSpec] = field(default_factory=dict)

    def register(self, spec: CollectionSpec) -> CollectionSpec:
        if not 0 <= spec.id < RESERVED_COLLECTIONS:
            raise ValueError(f"collection 0x{spec.id:04x} is out of the open range")
        if spec.id in self.specs:
            raise ValueError(f"collection 0x{spec.id:04x} is taken by {self.specs[spec.id].name}")
        self.specs[spec.id] = spec
        return spec

    def __getitem__(self, collection: int) -> CollectionSpec:
        if collection not in self.specs:
            raise NotFound(f"collection 0x{collection:04x} is not registered")
        return self.specs[collection]


@dataclass(frozen=True)
class BlockRef:
    """Identity of a block."""

    num: int = 0
    id: str = ""


@dataclass(frozen=True)
class Checkpoint:
    """The last durable height and block; height 0 and an empty block before the first write."""

    height: int = 0
    block: BlockRef = BlockRef()


def live_checkpoint_key() -> str:
    return "checkpoint"


def shard_checkpoint_key(shard: int) -> str:
    return f"shard-{shard:03d}"
