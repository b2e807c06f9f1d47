"""Parquet-backed store: append-only logs, snapshots, and checkpoints that are committed last."""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from ..functions.keys import is_deletion
from ..model import BlockRef, Checkpoint, ContiguityError, NotFound, live_checkpoint_key, shard_checkpoint_key
from ..operators.reads import latest

class LogStore:
    """A folder (any URI that Spark can write to) with logs partitioned by collection and entity bucket.

    Appending is idempotent by batch: rows of a batch go into a folder of their
    own, which a retry replaces.  A checkpoint names the height up to which
    rows count; it is written after them.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _fs(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def _exists(self, name: str) -> bool:
        fs, p = self._fs(name)
        return fs.exists(p)

    def _names(self, name: str) -> list[str]:
        fs, p = self._fs(name)
        return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []

    def append(self, log: str, rows: DataFrame, batch: int) -> None:
        """Adds the rows of a batch; empty values become null, the one form of a tombstone in a log.

        Ranges of (collection, bucket, entity, height) go to the tasks, so an
        entity with very many rows is spread over several, and entity and height
        prune row groups.
        """
        if isinstance(rows.schema["value"].dataType, BinaryType | StringType):
            rows = rows.withColumn("value", F.when(~is_deletion(F.col("value")), F.col("value")))
        bucketed = rows.withColumn("bucket", bucket_of(F.col("collection"), F.col("identifier"), self.buckets))
        key = ("collection", "bucket", "identifier", "height")
        (
            bucketed.repartitionByRange(*key)
            .sortWithinPartitions(*key)
            .write.mode("overwrite")
            .partitionBy("collection", "bucket")
            .option("compression", "zstd")
            .parquet(f"{self.path}/{log}/batch={batch}")
        )

    def read(self, log: str) -> DataFrame:
        """All rows of a log; filters on collection, bucket and height reach the scan."""
        if not self._exists(log):
            raise NotFound(f"no log {log} is stored")
        return self.spark.read.option("basePath", f"{self.path}/{log}").parquet(f"{self.path}/{log}").drop("batch")

    def between(self, log: str, start: int | None = None, stop: int | None = None) -> DataFrame:
        """Rows with heights in [start, stop), in order of their keys; no stop is the end of the log."""
        rows = self.read(log)
        if start is not None:
            rows = rows.where(F.col("height") >= start)
        return rows if stop is None else rows.where(F.col("height") < stop)

    def entity(self, log: str, collection: int, identifier, keys_only: bool = False) -> DataFrame:
        """One entity's rows, with its bucket pruned by hand; keys_only reads no values."""
        rows = self.read(log)
        kind = rows.schema["collection"].dataType
        bucket = bucket_of(F.lit(collection).cast(kind), F.lit(identifier).cast(rows.schema["identifier"].dataType), self.buckets)
        rows = rows.where((F.col("collection") == collection) & (F.col("bucket") == bucket) & (F.col("identifier") == identifier))
        return rows.drop("value") if keys_only else rows

    def fetch(self, log: str, collection: int, identifier, height: int, pk=None) -> Row:
        """The row under one full key; NotFound without one."""
        rows = self.entity(log, collection, identifier).where(F.col("height") == height)
        rows = rows if pk is None else rows.where(F.col("pk") == pk)
        row = rows.orderBy(F.desc("seq")).first()
        if row is None:
            raise NotFound(f"nothing is stored under {(collection, identifier, height, pk)}")
        return row

    def compact(self, log: str, keys: tuple[str, ...], into: str) -> None:
        """Rewrites a log without overwritten rows, in few files."""
        rows = latest(self.read(log), keys, F.desc("seq")).drop("bucket")
        LogStore(self.spark, self.path, self.buckets).append(into, rows, 0)

    def purge(self, log: str, gone: DataFrame, into: str) -> None:
        """Rewrites a log without the rows under the given keys (columns of `gone`)."""
        rows = self.read(log).drop("bucket")
        LogStore(self.spark, self.path, self.buckets).append(into, rows.join(gone.distinct(), gone.columns, "left_anti").select(*rows.columns), 0)

    # checkpoints: a small file for each version, named by its number, in a folder for each key

    def commit(self, checkpoint: Checkpoint, key: str | None = None) -> None:
        """Makes a checkpoint the newest of its key.

        The file of a version is only ever created, so of two writers with the
        same version one fails.  Versions before the last two go.
        """
        key = key or live_checkpoint_key()
        versions = self._names(f"checkpoints/{key}")
        version = int(versions[-1]) + 1 if versions else 0
        fs, p = self._fs(f"checkpoints/{key}/{version:012d}")
        try:
            out = fs.create(p, False)
        except Py4JJavaError as e:
            raise ContiguityError(f"another writer has committed version {version} of {key}") from e
        out.write(json.dumps({"height": checkpoint.height, "num": checkpoint.block.num, "id": checkpoint.block.id}).encode())
        out.close()
        for old in versions[:-1]:
            fs, p = self._fs(f"checkpoints/{key}/{old}")
            fs.delete(p, False)

    def checkpoint(self, key: str | None = None) -> Checkpoint:
        """The newest checkpoint, or height 0 without a block."""
        key = key or live_checkpoint_key()
        for version in reversed(self._names(f"checkpoints/{key}")):
            fs, p = self._fs(f"checkpoints/{key}/{version}")
            stream = fs.open(p)
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            if text.endswith("}"):  # else a writer was lost before it had written it
                got = json.loads(text)
                return Checkpoint(got["height"], BlockRef(got["num"], got["id"]))
        return Checkpoint()

    def drop_checkpoint(self, key: str) -> None:
        fs, p = self._fs(f"checkpoints/{key}")
        fs.delete(p, True)

    def check_clean_for_sharding(self) -> None:
        if self._names(f"checkpoints/{live_checkpoint_key()}"):
            raise ContiguityError("the store has a live checkpoint; sharded writing needs a clean one")

    def shard_checkpoints(self) -> DataFrame:
        """(shard, height, block) of the shards that have one."""
        keys = [k for k in self._names("checkpoints") if k.startswith("shard-")]
        found = [(int(k.rsplit("-", 1)[1]), self.checkpoint(k)) for k in keys]
        return self.spark.createDataFrame([(i, c.height, (c.block.num, c.block.id)) for i, c in found], "shard int, height long, block struct<num: long, id: string>")

    def finish_sharding(self, shards: int) -> Checkpoint:
        """Promotes the common checkpoint of all shards and deletes theirs."""
        from ..operators.stats import verify_all_shards

        verify_all_shards(self.shard_checkpoints(), shards)
        done = self.checkpoint(shard_checkpoint_key(0))
        self.commit(done)
        for i in range(shards):
            self.drop_checkpoint(shard_checkpoint_key(i))
        return done


def bucket_of(collection: Column, identifier: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(collection, identifier), F.lit(buckets)).cast("int")
