"""Stored snapshots: their keys, rows and life.

Two logs beside the others: `index_meta` names every version of a snapshot
(entity, at_height, run, squelched, row_count), `index_rows` has the rows that a
run wrote.  A run is one job; nothing is changed in place: the highest run of an
(entity, at_height) holds, and a run may say that it is gone.  Rows are written
before their meta, so a snapshot that can be found is whole.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import singlet_key_at, tablet_key
from ..model import INDEX_COLLECTION
from ..operators.indexing import index_at
from ..operators.reads import ENTITY, latest
from .logstore import LogStore

log = logging.getLogger(__name__)

#: Bytes of one encoded snapshot from which it is worth a warning (fixed value).
HEAVY = 25 * 1000 * 1000
KEY = (*ENTITY, "at_height")


class IndexStore:
    def __init__(self, store: LogStore, name: str = "index"):
        self.store, self.spark, self.name = store, store.spark, name
        self._newest: DataFrame | None = None

    def _path(self, what: str) -> str:
        return f"{self.store.path}/{self.name}_{what}"

    def _run(self) -> int:
        names = self.store._names(f"{self.name}_meta")
        return 1 + max((int(n.split("=")[1]) for n in names if n.startswith("run=")), default=-1)

    def write(self, rows: DataFrame, meta: DataFrame) -> DataFrame:
        """Adds snapshots: rows (entity, pk, at_height, height), meta (entity, at_height, squelched); returns the meta written.

        A snapshot without live rows is one too, if anything was squelched.
        Rows are spread by their keys (a range of keys would be drawn by making
        all rows once more, and a large snapshot be one task's); sorted files
        still have the rows of one snapshot side by side.
        """
        run = self._run()
        rows.repartition(*KEY, "pk").sortWithinPartitions(*KEY, "pk").write.mode("overwrite").option("compression", "zstd").parquet(f"{self._path('rows')}/run={run}")
        back = self.spark.read.schema(rows.schema).parquet(f"{self._path('rows')}/run={run}")
        width = F.length("pk") if dict(rows.dtypes)["pk"] in ("string", "binary") else F.lit(8)
        sizes = back.groupBy(*KEY).agg(F.count(F.lit(1)).alias("row_count"), F.sum(width + 8).alias("bytes"))
        full = meta.select(*KEY, "squelched").join(sizes, list(KEY), "left").fillna(0, ["row_count", "bytes"])
        self._put(full.where("row_count > 0 or squelched > 0").withColumn("gone", F.lit(False)), run)
        written = self._meta(run)
        for r in written.where(F.col("bytes") > HEAVY).orderBy(F.desc("bytes")).limit(20).collect():
            log.warning("the snapshot of %s at height %s has %s bytes", r["identifier"], r["at_height"], r["bytes"])
        return written

    def delete(self, indexes: DataFrame) -> None:
        """The snapshots with these keys are gone."""
        none = {"squelched": 0, "row_count": 0, "bytes": 0}
        gone = indexes.select(*KEY).withColumns({k: F.lit(v).cast("long") for k, v in none.items()}).withColumn("gone", F.lit(True))
        self._put(gone, self._run())

    def _put(self, meta: DataFrame, run: int) -> None:
        meta.coalesce(8).write.mode("overwrite").parquet(f"{self._path('meta')}/run={run}")
        if self._newest is not None:
            self._newest.unpersist()
            self._newest = None

    def _meta(self, run: int) -> DataFrame:
        return self.spark.read.parquet(f"{self._path('meta')}/run={run}")

    def meta(self, height: int = 0, lower: Column | None = None) -> DataFrame | None:
        """Keys of all snapshots (height 0) or those up to a height, of entities whose key is at `lower` or above; None if none was ever written."""
        if not self.store._exists(f"{self.name}_meta"):
            return None
        rows = latest(self.spark.read.option("basePath", self._path("meta")).parquet(self._path("meta")), KEY, F.desc("run")).where("not gone")
        if height:
            rows = rows.where(F.col("at_height") <= height)
        return rows if lower is None else rows.where(key_of(rows) >= lower)

    def newest(self) -> DataFrame | None:
        """The newest snapshot of each entity, kept in memory until something is written."""
        if self._newest is None and (meta := self.meta()) is not None:
            self._newest = latest(meta, ENTITY, F.desc("at_height")).cache()
        return self._newest

    def at(self, height: int, ignore: tuple[int, int] = (0, 0)) -> DataFrame | None:
        """The newest snapshot of each entity at or below a height, but for the ignored range."""
        meta = self.meta()
        return None if meta is None else meta.join(index_at(meta, height, ignore), list(KEY), "left_semi")

    def rows(self, meta: DataFrame) -> DataFrame:
        """Rows of these snapshots: (entity, pk, at_height, height)."""
        every = self.spark.read.option("basePath", self._path("rows")).parquet(self._path("rows"))
        return every.join(meta.select(*KEY, "run"), [*KEY, "run"], "left_semi").select(*ENTITY, "pk", "at_height", "height")


def _text(identifier: Column, kind: str) -> Column:
    return identifier if kind == "binary" else F.encode(identifier.cast("string"), "utf-8")


def key_of(rows: DataFrame) -> Column:
    """The tablet key of an entity, by which tablets are ordered."""
    return tablet_key(F.col("collection"), _text(F.col("identifier"), dict(rows.dtypes)["identifier"]))


def index_key(rows: DataFrame) -> Column:
    """The key under which a snapshot is an entry: the index collection, the tablet's key, the complement of its height."""
    return singlet_key_at(F.lit(INDEX_COLLECTION), key_of(rows), F.col("at_height"))
