"""Jobs: python -m stratum MODE --store PATH ..."""

from __future__ import annotations

import argparse
from importlib import import_module

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import Config
from .operators import maintenance
from .operators.sharding import inject_shard, write_shards
from .reader import Reader, span
from .sources.indexstore import IndexStore
from .sources.logstore import LogStore
from .streaming.ingest import start_ingest, start_requests

MODES = ("server", "inject", "shard", "inject-shards")
JOBS = ("index", "reindex", "prune", "finish-sharding")


def hook(path: str | None):
    """A function by its place, package.module:function."""
    if path is None:
        return None
    module, name = path.split(":")
    return getattr(import_module(module), name)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("stratum")
    p.add_argument("mode", choices=[*MODES, *JOBS])
    p.add_argument("--store", required=True)
    p.add_argument("--log", default="tablets")
    p.add_argument("--input", help="folder of blocks, requests or shards")
    p.add_argument("--mapper", help="package.module:function from blocks to mutations; without one the input has write requests")
    p.add_argument("--on-server", help="package.module:function called with the reader")
    p.add_argument("--on-inject", help="package.module:function called with the store")
    p.add_argument("--height", type=int)
    p.add_argument("--frequency", type=int, default=2)
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--disable-indexing", action="store_true")
    p.add_argument("--skip-checkpoint", action="store_true")
    for name in ("--shard-count", "--shard-index", "--start", "--stop", "--ignore-start", "--ignore-stop"):
        p.add_argument(name, type=int, default=0)
    return p


def run(a: argparse.Namespace, spark: SparkSession) -> None:
    """One mode or job on a session."""
    store = LogStore(spark, a.store)
    if a.mode in JOBS:
        job(a, store)
        return
    config = Config(
        a.store, server=a.mode == "server", inject=a.mode == "inject", shard=a.mode == "shard", inject_shards=a.mode == "inject-shards",
        shard_count=a.shard_count, shard_index=a.shard_index, start=a.start, stop=a.stop, disable_indexing=a.disable_indexing,
        skip_checkpoint=a.skip_checkpoint, ignore_index_range=(a.ignore_start, a.ignore_stop), on_server=hook(a.on_server), on_inject=hook(a.on_inject),
    )
    config.validate()
    with span(spark, f"stratum {a.mode}"):
        if config.server:
            reader = Reader(store)
            if config.on_server:
                config.on_server(reader)
            reader.tablets(a.height if a.height is not None else reader.checkpoint().height).show(100, truncate=False)
        elif config.inject:
            if config.on_inject:
                config.on_inject(store)
            blocks = spark.readStream.schema(spark.read.parquet(a.input).schema).parquet(a.input)
            if a.mapper:
                query = start_ingest(blocks, store, a.log, hook(a.mapper), f"{a.store}/stream")
            else:
                query = start_requests(blocks, store, f"{a.store}/stream", config)
            query.awaitTermination()
        elif config.shard:
            store.check_clean_for_sharding()
            write_shards(spark.read.parquet(a.input).where(F.col("height").isNotNull()), f"{a.store}/shards", a.shard_count, a.start, a.stop)
        else:
            inject_shard(store, f"{a.store}/shards", a.shard_index, a.log)


def job(a: argparse.Namespace, store: LogStore) -> None:
    """Maintenance of a store: snapshots that are due, rebuilt or pruned, and the end of sharded writing."""
    indexes = IndexStore(store)
    with span(store.spark, f"stratum {a.mode}"):
        if a.mode == "finish-sharding":
            print(store.finish_sharding(a.shard_count))
        elif a.mode == "prune":
            print(maintenance.prune_tablet_indexes(indexes, a.frequency, a.height or 0, dry_run=a.dry_run))
        else:
            log = store.read(a.log).drop("bucket")
            if a.mode == "reindex":
                print(maintenance.reindex_tablets(indexes, log, a.height or 0, dry_run=a.dry_run))
            else:
                height = a.height if a.height is not None else store.checkpoint().height
                maintenance.index_tables(indexes, log, height, (a.ignore_start, a.ignore_stop)).show(100, truncate=False)


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    run(a, SparkSession.builder.appName(f"stratum {a.mode}").getOrCreate())


if __name__ == "__main__":
    main()
