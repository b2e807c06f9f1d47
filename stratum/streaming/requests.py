"""Write requests: all mutations of one block, as objects, as rows of a DataFrame, and as logs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import BlockRef
from ..operators.reads import ENTITY

ENTRY = "struct<collection: int, identifier: binary, height: long, value: binary>"
ROW = "struct<collection: int, identifier: binary, height: long, pk: binary, value: binary>"
#: A request as a row; the height of a mutation is its own, that of the request names its block.
REQUEST = f"height long, block struct<num: long, id: string>, singlet_entries array<{ENTRY}>, tablet_rows array<{ROW}>"


@dataclass
class WriteRequest:
    """What a block mapper returns for one block; an empty value deletes."""

    height: int
    block: BlockRef
    singlet_entries: list[tuple[int, bytes, int, bytes]] = field(default_factory=list)
    tablet_rows: list[tuple[int, bytes, int, bytes, bytes]] = field(default_factory=list)

    def append_singlet_entry(self, collection: int, identifier: bytes, value: bytes, height: int | None = None) -> None:
        self.singlet_entries.append((collection, identifier, self.height if height is None else height, value))

    def append_tablet_row(self, collection: int, identifier: bytes, pk: bytes, value: bytes, height: int | None = None) -> None:
        self.tablet_rows.append((collection, identifier, self.height if height is None else height, pk, value))

    def as_row(self) -> tuple:
        return self.height, (self.block.num, self.block.id), self.singlet_entries, self.tablet_rows

    @classmethod
    def from_row(cls, row) -> WriteRequest:
        entries = [(e["collection"], bytes(e["identifier"]), e["height"], bytes(e["value"] or b"")) for e in row["singlet_entries"]]
        rows = [(r["collection"], bytes(r["identifier"]), r["height"], bytes(r["pk"]), bytes(r["value"] or b"")) for r in row["tablet_rows"]]
        return cls(row["height"], BlockRef(row["block"]["num"], row["block"]["id"]), entries, rows)


def as_frame(spark: SparkSession, requests: list[WriteRequest]) -> DataFrame:
    return spark.createDataFrame([r.as_row() for r in requests], REQUEST)


def _mutations(requests: DataFrame, column: str) -> DataFrame:
    # of mutations under one key the last request's last one holds: seq is the request's height, then the place in it
    rows = requests.select(F.col("height").alias("request"), "block", F.posexplode(column).alias("pos", "m"))
    seq = F.shiftleft("request", 24) + F.col("pos")
    return rows.select("m.*", seq.alias("seq"), "request", F.col("block.id").alias("block_id"), F.col("pos").cast("long").alias("pos"))


def tablet_rows(requests: DataFrame) -> DataFrame:
    """The tablet log of requests: collection, identifier, height, pk, value, seq, request, block_id, pos."""
    return _mutations(requests, "tablet_rows")


def singlet_entries(requests: DataFrame) -> DataFrame:
    """The singlet log of requests."""
    return _mutations(requests, "singlet_entries")


def pack(tablets: DataFrame, singlets: DataFrame, blocks: DataFrame) -> DataFrame:
    """Logs as requests again: one for each block (height, block), with mutations or without, in order of seq."""

    def lists(rows: DataFrame, name: str, *columns: str) -> DataFrame:
        one = F.struct("seq", F.struct(*columns).alias("m"))
        return rows.groupBy(F.col("request").alias("height")).agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["m"]).alias(name))

    entries = lists(singlets, "singlet_entries", *ENTITY, "height", "value")
    rows = lists(tablets, "tablet_rows", *ENTITY, "height", "pk", "value")
    out = blocks.select("height", "block").join(entries, "height", "left").join(rows, "height", "left")
    for c, kind in (("singlet_entries", ENTRY), ("tablet_rows", ROW)):
        out = out.withColumn(c, F.coalesce(c, F.array().cast(f"array<{kind}>")))
    return out.select("height", "block", "singlet_entries", "tablet_rows")


def speculative(requests: DataFrame, kind: str = "tablet_rows") -> DataFrame:
    """Requests as speculative rows for reads: they override stored rows in the order of requests, then of mutations."""
    rows = _mutations(requests, kind)
    return rows.withColumn("ord", F.col("request")).drop("request")
