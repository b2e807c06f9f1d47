"""Byte keys as column expressions, and their decoding.

Layouts (fixed formats, big-endian): tablet = collection(2) identifier; tablet
at a height adds height(8), a row adds its primary key; singlet entries carry
the bitwise complement of the height, so that the newest sorts first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import InvalidKey, Registry


def _be(value: Column, width: int) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("long")), width * 2, "0"))


def tablet_key(collection: Column, identifier: Column) -> Column:
    return F.concat(_be(collection, 2), identifier)


def tablet_key_at(collection: Column, identifier: Column, height: Column) -> Column:
    return F.concat(tablet_key(collection, identifier), _be(height, 8))


def tablet_row_key(collection: Column, identifier: Column, height: Column, pk: Column) -> Column:
    return F.concat(tablet_key_at(collection, identifier, height), pk)


singlet_key = tablet_key


def singlet_key_at(collection: Column, identifier: Column, height: Column) -> Column:
    return F.concat(singlet_key(collection, identifier), _be(F.bitwise_not(height.cast("long")), 8))


def hex_key(key: Column) -> Column:
    return F.lower(F.hex(key))


def is_deletion(value: Column) -> Column:
    """Null and empty values are tombstones."""
    return value.isNull() | (F.length(value) == 0)


def same_entity(collection_a: Column, identifier_a: Column, collection_b: Column, identifier_b: Column) -> Column:
    return collection_a.eqNullSafe(collection_b) & identifier_a.eqNullSafe(identifier_b)


def row_text(name: Column, height: Column, pk: Column) -> Column:
    """entity:height in 16 hex digits:primary key."""
    return F.concat_ws(":", name, F.lpad(F.lower(F.hex(height.cast("long"))), 16, "0"), pk)


def decode_height(key: Column, at: int, inverted: bool = False) -> Column:
    """Height in the eight bytes from the given one (from 0); null if they aren't all there."""
    raw = F.substring(key, at + 1, 8)
    value = F.conv(F.hex(raw), 16, -10).cast("long")
    return F.when(F.length(raw) == 8, F.bitwise_not(value) if inverted else value)


def tablet_text(name: Column, identifier: Column) -> Column:
    """entity name and identifier."""
    return F.concat_ws(":", name, identifier)


def entry_text(name: Column, height: Column) -> Column:
    """entity:complement of the height in 16 hex digits, as a singlet entry's key sorts."""
    return F.concat_ws(":", name, F.lower(F.hex(F.bitwise_not(height.cast("long")))))


def _collection(key: Column) -> Column:
    return F.conv(F.hex(F.substring(key, 1, 2)), 16, 10).cast("int")


def _by_spec(registry: Registry, kind: str, key: Column, of) -> Column:
    """of(spec) for the registered collection of a key; null for others."""
    out = None
    for spec in registry.specs.values():
        if spec.kind == kind:
            case = _collection(key) == spec.id
            out = F.when(case, of(spec)) if out is None else out.when(case, of(spec))
    return out if out is not None else F.lit(None)


def decode_tablet(registry: Registry, key: Column) -> Column:
    """struct(collection, identifier) of a tablet key; null if it isn't one."""

    def of(spec):
        width = F.lit(spec.identifier_bytes) if spec.identifier_bytes is not None else F.length(key) - 2
        value = F.struct(F.lit(spec.id).alias("collection"), F.substring(key, F.lit(3), width).alias("identifier"))
        return F.when(F.length(key) >= F.greatest(F.lit(3), 2 + width), value)

    return _by_spec(registry, "tablet", key, of)


def decode_singlet(registry: Registry, key: Column) -> Column:
    """struct(collection, identifier) of a singlet key; null if it isn't one."""

    def of(spec):
        width = F.lit(spec.identifier_bytes) if spec.identifier_bytes is not None else F.length(key) - 2
        value = F.struct(F.lit(spec.id).alias("collection"), F.substring(key, F.lit(3), width).alias("identifier"))
        return F.when(F.length(key) >= 2 + width, value)

    return _by_spec(registry, "singlet", key, of)


def decode_row(registry: Registry, key: Column) -> Column:
    """struct(collection, identifier, height, pk) of a row key; null if it isn't one or its collection has no fixed identifier length."""

    def of(spec):
        if spec.identifier_bytes is None:
            return F.lit(None)
        n = spec.identifier_bytes
        fits = F.length(key) >= 2 + n + 8 if spec.pk_bytes is None else F.length(key) == 2 + n + 8 + spec.pk_bytes
        value = F.struct(
            F.lit(spec.id).alias("collection"),
            F.substring(key, 3, n).alias("identifier"),
            decode_height(key, 2 + n).alias("height"),
            F.substring(key, F.lit(2 + n + 8 + 1), F.length(key)).alias("pk"),
        )
        return F.when(fits, value)

    return _by_spec(registry, "tablet", key, of)


def decode_entry(registry: Registry, key: Column) -> Column:
    """struct(collection, identifier, height) of a singlet entry's key; null if it isn't one."""

    def of(spec):
        width = F.lit(spec.identifier_bytes) if spec.identifier_bytes is not None else F.length(key) - 10
        raw = F.substring(key, 3 + width, F.lit(8))
        height = F.bitwise_not(F.conv(F.hex(raw), 16, -10).cast("long"))
        value = F.struct(F.lit(spec.id).alias("collection"), F.substring(key, F.lit(3), width).alias("identifier"), height.alias("height"))
        return F.when((F.length(key) == 2 + width + 8) & (width >= 0), value)

    return _by_spec(registry, "singlet", key, of)


def file_span(name: Column) -> Column:
    """(first, last) of a shard file called first-last; null if it isn't called so, or past 32 bits."""
    good = name.rlike(r"^\d+-\d+$")
    bound = lambda i: F.element_at(F.split(name, "-"), i).try_cast("decimal(38,0)")
    ok = good & (bound(1) <= 0xFFFFFFFF) & (bound(2) <= 0xFFFFFFFF)
    return F.when(ok, F.struct(bound(1).cast("long").alias("first"), bound(2).cast("long").alias("last")))


def segment_name(first: Column, last: Column) -> Column:
    return F.format_string("%010d-%010d", first, last)


def shard_folder(shard: Column) -> Column:
    return F.format_string("%03d", shard)


def near_realtime(block_time: Column, now: Column | None = None) -> Column:
    """Whether a block is younger than 15 seconds."""
    return (now if now is not None else F.current_timestamp()) - F.expr("INTERVAL 15 SECONDS") < block_time


def decode_tablet_key(registry: Registry, key: bytes) -> tuple[int, bytes]:
    """(collection, identifier); at least three bytes and a registered tablet."""
    if len(key) < 3:
        raise InvalidKey(f"a tablet key has 3 bytes or more, not {len(key)}")
    collection = int.from_bytes(key[:2], "big")
    spec = registry[collection]
    if spec.kind != "tablet":
        raise InvalidKey(f"{spec.name} is a singlet")
    return collection, key[2 : None if spec.identifier_bytes is None else 2 + spec.identifier_bytes]


def decode_singlet_key(registry: Registry, key: bytes) -> tuple[int, bytes]:
    """(collection, identifier); at least two bytes and a registered singlet."""
    if len(key) < 2:
        raise InvalidKey(f"a singlet key has 2 bytes or more, not {len(key)}")
    collection = int.from_bytes(key[:2], "big")
    spec = registry[collection]
    if spec.kind != "singlet":
        raise InvalidKey(f"{spec.name} is a tablet")
    return collection, key[2 : None if spec.identifier_bytes is None else 2 + spec.identifier_bytes]


def decode_row_key(registry: Registry, key: bytes) -> tuple[int, bytes, int, bytes]:
    """(collection, identifier, height, primary key)."""
    collection, identifier = decode_tablet_key(registry, key)
    spec = registry[collection]
    if spec.identifier_bytes is None:
        raise InvalidKey("rows can be decoded only with a fixed identifier length")
    rest = key[2 + spec.identifier_bytes :]
    if len(identifier) != spec.identifier_bytes or len(rest) < 8 or (spec.pk_bytes is not None and len(rest) != 8 + spec.pk_bytes):
        raise InvalidKey("a row key has an identifier, a height of 8 bytes and a primary key")
    return collection, identifier, int.from_bytes(rest[:8], "big"), rest[8:]


def decode_entry_key(registry: Registry, key: bytes) -> tuple[int, bytes, int]:
    """(collection, identifier, height) of a singlet entry."""
    collection, identifier = decode_singlet_key(registry, key)
    spec = registry[collection]
    width = spec.identifier_bytes if spec.identifier_bytes is not None else len(key) - 10
    if len(key) != 2 + width + 8 or width < 0:
        raise InvalidKey("an entry key ends with a height of 8 bytes")
    return collection, key[2 : 2 + width], (1 << 64) - 1 - int.from_bytes(key[-8:], "big")
