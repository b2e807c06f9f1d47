"""A live feed of blocks as a streaming source.

    spark.dataSource.register(LiveBlocks)
    spark.readStream.format("stratum-live").option("feed", "package.module:function").load()

The feed is a function (start, limit) that returns blocks as (num, id,
parent_id, lib_num, payload) from the start-th on, in the order in which
they came, as many as there are now: a gRPC client, a folder of one-block
files, a queue.  Its module must be importable where Spark runs Python; it runs
beside the driver, which holds one batch of `limit` blocks.
A batch that is read again after a failure comes from the feed again.
"""

from __future__ import annotations

from collections.abc import Iterator
from importlib import import_module

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


class LiveBlocks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stratum-live"

    def schema(self) -> str:
        return "num long, id string, parent_id string, lib_num long, payload string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802
        return LiveReader(self.options)


class LiveReader(SimpleDataSourceStreamReader):
    """Offsets are counts of blocks that the feed has given."""

    def __init__(self, options: dict[str, str]):
        module, name = options["feed"].split(":")
        self.feed = getattr(import_module(module), name)
        self.limit = int(options.get("limit", "1000"))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = [tuple(r) for r in self.feed(start["at"], self.limit)]
        return iter(rows), {"at": start["at"] + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter([tuple(r) for r in self.feed(start["at"], end["at"] - start["at"])])

    def commit(self, end: dict) -> None:
        pass
