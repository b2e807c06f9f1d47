"""Stores, snapshots, requests, forks and the jobs around them on small cases."""

import random
import time

import pandas as pd
import pytest
from block_feed import ROWS
from pyspark.sql import functions as F
from stratum.__main__ import parser, run
from stratum.config import Config
from stratum.functions import keys
from stratum.model import BlockNotFound, BlockRef, Checkpoint, CollectionSpec, ContiguityError, NotFound, NotReady, Registry
from stratum.operators import forks, indexing, maintenance, reads, sharding
from stratum.plans.snapshots import row_with_indexes, state_with_indexes
from stratum.reader import Metrics, Reader
from stratum.sources.indexstore import IndexStore
from stratum.sources.live import LiveBlocks
from stratum.sources.logstore import LogStore
from stratum.streaming import finality as finality_module
from stratum.streaming import requests as wr
from stratum.streaming.finality import ROCKSDB, final_blocks
from stratum.streaming.ingest import start_requests, write_requests

LOG = "collection int, identifier string, height long, pk string, value string, seq long"


def tablet(spark, rows, identifier="tbl"):
    return spark.createDataFrame([(1, identifier, h, pk, v, i) for i, (h, pk, v) in enumerate(rows)], LOG)


def state(df):
    return [(r["pk"], r["height"], r["value"]) for r in reads.by_key(df).collect()]


def request(height, rows=(), entries=(), block=None):
    r = wr.WriteRequest(height, BlockRef(height, block or f"{height:08x}aa"))
    for pk, value in rows:
        r.append_tablet_row(1, b"tbl", pk, value)
    for value in entries:
        r.append_singlet_entry(2, b"sgl", value)
    return r


# tombstones


@pytest.mark.parametrize("kind", ["string", "binary"])
def test_empty_values_delete(spark, tmp_path, kind):
    log = tablet(spark, [(1, "a", "x"), (1, "b", "y"), (2, "a", ""), (3, "c", None), (4, "b", "z")]).withColumn("value", F.col("value").cast(kind))
    text = lambda df: [(r["pk"], r["height"]) for r in reads.by_key(df).collect()]
    assert text(reads.state_at(log, 1)) == [("a", 1), ("b", 1)]
    assert text(reads.state_at(log, 4)) == [("b", 4)]
    assert text(indexing.snapshot(log, 4)) == [("b", 4)]
    assert [r["is_deletion"] for r in reads.history(log.where("pk = 'a'").drop("pk")).orderBy("at").collect()] == [True, False]
    probes = spark.createDataFrame([(1, "tbl", 2, 9)], "collection int, identifier string, probe_height long, probe_id int")
    assert reads.as_of(probes, log.where("pk = 'a'"), reads.ENTITY).count() == 0
    store = LogStore(spark, str(tmp_path / kind))
    store.append("log", log, 0)
    assert store.read("log").where("value is null").count() == 2 and store.read("log").where("length(value) = 0").count() == 0


# stored snapshots


def test_reads_with_stored_indexes(spark, tmp_path):
    log = tablet(spark, [(100, "002", "abc"), (100, "003", "old"), (124, "002", None), (130, "004", "new")])
    indexes = IndexStore(LogStore(spark, str(tmp_path)))
    assert indexes.at(500) is None and indexes.newest() is None
    marks = log.select("collection", "identifier", F.lit(123).cast("long").alias("at_height")).distinct()
    indexes.write(indexing.reindex(log, marks), indexing.squelched(log, marks))
    for height in (99, 100, 123, 124, 200):
        meta = indexes.at(height)
        rows = indexes.rows(meta)
        assert state(state_with_indexes(log, meta, rows, height, check=True)) == state(reads.state_at(log, height))
        assert state(row_with_indexes(log, meta, rows, height, "003", check=True)) == state(reads.row_at(log, height, "003"))
    meta = indexes.at(123)
    # rows of which the log has lost some are left out; all of them lost, or one empty, is an error
    rows = indexes.rows(meta)
    assert state(state_with_indexes(log.where("pk <> '003'"), meta, rows, 123, check=True)) == [("002", 100, "abc")]
    with pytest.raises(NotFound):
        state_with_indexes(log.where("height > 100"), meta, rows, 123, check=True)
    with pytest.raises(NotFound):
        row_with_indexes(log.where("pk <> '003'"), meta, rows, 123, "003", check=True)
    with pytest.raises(Exception, match="names a deleted row"):
        state_with_indexes(log.withColumn("value", F.lit("")), meta, rows, 123).collect()


def test_index_jobs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(indexing, "INDEX_AFTER", 3)
    indexes = IndexStore(LogStore(spark, str(tmp_path)))
    log = tablet(spark, [(1, "a", "1"), (1, "a", "2"), (2, "b", "1"), (3, "a", None), (5, "c", "1"), (6, "c", "2"), (6, "d", "1"), (9, "d", None)])
    small = tablet(spark, [(1, "a", "1")], "small")
    both = log.unionByName(small)
    got = lambda df: [(r["identifier"], r["at_height"], r["squelched"], r["row_count"]) for r in df.orderBy("identifier", "at_height").collect()]
    assert got(maintenance.index_tables(indexes, both, 3)) == [("tbl", 3, 3, 1)]
    assert maintenance.index_tables(indexes, both, 5).count() == 0  # one mutation since
    assert got(maintenance.index_tables(indexes, both, 6)) == [("tbl", 6, 3, 3)]
    assert [(r["pk"], r["height"]) for r in indexes.rows(indexes.at(6)).orderBy("pk").collect()] == [("b", 2), ("c", 6), ("d", 6)]
    assert got(indexes.newest()) == [("tbl", 6, 3, 3)]
    # an ignored snapshot isn't built upon
    again = maintenance.index_tables(indexes, both.unionByName(tablet(spark, [(8, "e", "1"), (8, "f", "1"), (8, "g", "1")])), 9, (4, 7))
    assert got(again) == [("tbl", 9, 7, 5)]
    # rebuilt from the log
    counts = maintenance.reindex_tablets(indexes, both, dry_run=True)
    assert counts == maintenance.Counts(1, 3, 0)
    assert maintenance.reindex_tablets(indexes, both).changed == 3
    assert got(indexes.meta()) == [("tbl", 3, 3, 1), ("tbl", 6, 3, 3), ("tbl", 9, 1, 2)]
    rows, written = maintenance.reindex_tablet(indexes, both, 1, "tbl", 7, write=True)
    assert written and sorted(r["pk"] for r in rows.collect()) == ["b", "c", "d"]
    assert got(indexes.meta())[1] == ("tbl", 6, 3, 3)
    assert maintenance.reindex_tablet(indexes, both, 1, "none") == (None, False)


def counting(spark, rows):
    """Rows, and an accumulator of how many of them were made."""
    made = spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            made.add(len(f))
            yield f

    return rows.mapInPandas(count, rows.schema), made


def test_index_job_reads_the_log_twice(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(indexing, "INDEX_AFTER", 3)
    indexes = IndexStore(LogStore(spark, str(tmp_path)))
    log, made = counting(spark, tablet(spark, [(1, "a", "1"), (1, "a", None), (2, "b", "1"), (3, "b", "2"), (5, "c", None), (5, "c", "2"), (6, "d", "1"), (6, "b", None)]))
    first = maintenance.index_tables(indexes, log, 3)
    assert [(r["squelched"], r["row_count"]) for r in first.collect()] == [(3, 1)] and made.value <= 2 * 8
    second = maintenance.index_tables(indexes, log, 6)
    assert [(r["squelched"], r["row_count"]) for r in second.collect()] == [(3, 2)] and made.value <= 4 * 8
    assert sorted((r["pk"], r["height"]) for r in indexes.rows(indexes.at(6)).collect()) == [("c", 5), ("d", 6)]


def marked_log(spark, monkeypatch):
    """A log of random changes with rows written again, snapshots above, below and between them, small ranges, and each snapshot's rows and counts."""
    monkeypatch.setattr(indexing, "RANGE", 4)
    monkeypatch.setattr(indexing, "CHUNK", 3)
    rng = random.Random(5)
    rows = [(1, rng.choice(["a", "b", None]), rng.choice([*range(40, 90), None]), rng.choice("pqrs"), rng.choice(["v", "w", None]), i) for i in range(600)]
    at = {(c, h) for c in ("a", "b", "none") for h in rng.sample(range(20, 120), 40)} | {(None, 60)}
    state, counts = {}, {}
    for c, h in at:
        mine = sorted((r for r in rows if c is not None and r[1] == c and r[2] is not None and r[2] <= h), key=lambda r: (r[2], r[5]))
        state[c, h] = {r[3]: (r[2], r[4]) for r in mine}
        counts[c, h] = len({(r[2], r[3]) for r in mine})
    live = {k: {(p, h) for p, (h, v) in s.items() if v is not None} for k, s in state.items()}
    before = {(c, h): max((x for d, x in at if d == c and x < h), default=None) for c, h in at}
    since = {(c, h): n - counts.get((c, before[c, h]), 0) for (c, h), n in counts.items()}
    marks = spark.createDataFrame([(1, *k) for k in sorted(at, key=str)], "collection int, identifier string, at_height long")
    return spark.createDataFrame(rows, LOG), marks.unionByName(marks.limit(5)), live, since


def test_rebuilding_over_ranges_of_heights(spark, monkeypatch):
    log, marks, live, since = marked_log(spark, monkeypatch)
    got = [(r["identifier"], r["at_height"], r["pk"], r["height"]) for r in indexing.reindex(log, marks).collect()]
    assert sorted(got) == sorted((*k, *x) for k, rows in live.items() for x in rows) and len(got) > 100
    assert {(r["identifier"], r["at_height"]): r["squelched"] for r in indexing.squelched(log, marks).collect()} == since


def test_live_counts_over_ranges_of_heights(spark, monkeypatch):
    log, marks, live, _ = marked_log(spark, monkeypatch)
    got = [((r["identifier"], r["at_height"]), r["live_rows"]) for r in indexing.live_counts(log, marks).collect()]
    assert dict(got) == {k: len(v) for k, v in live.items()} and len(got) == len(live)


def test_large_snapshot_is_written_by_several_tasks(spark, tmp_path):
    indexes = IndexStore(LogStore(spark, str(tmp_path)))
    rows = spark.range(20000).select(F.lit(1).alias("collection"), F.lit("t").alias("identifier"), F.col("id").alias("pk"), F.lit(9).cast("long").alias("at_height"), F.col("id").alias("height"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        indexes.write(rows, rows.limit(1).select("collection", "identifier", "at_height", F.lit(20000).cast("long").alias("squelched")))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "index_rows" / "run=0").glob("*.parquet"))) == 4 and indexes.rows(indexes.at(9)).count() == 20000


def test_index_pruning(spark, tmp_path):
    indexes = IndexStore(LogStore(spark, str(tmp_path)))
    assert maintenance.prune_tablet_indexes(indexes, 2) == maintenance.Counts(0, 0, 0)
    marks = spark.createDataFrame([(1, t, h) for t, n in (("aa", 10), ("bb", 4), ("cc", 3)) for h in range(1, n + 1)], "collection int, identifier string, at_height long")
    none = marks.limit(0).select("collection", "identifier", F.lit("").alias("pk"), "at_height", F.lit(0).cast("long").alias("height"))
    indexes.write(none, marks.withColumn("squelched", F.lit(1).cast("long")))
    lower = keys.tablet_key(F.lit(1), F.encode(F.lit("bb"), "utf-8"))
    assert maintenance.prune_tablet_indexes(indexes, 2, lower=lower) == maintenance.Counts(0, 7, 0)
    assert maintenance.prune_tablet_indexes(indexes, 2, height=4) == maintenance.Counts(0, 11, 0)
    assert maintenance.prune_tablet_indexes(indexes, 2, dry_run=True) == maintenance.Counts(1, 17, 4)
    assert indexes.meta().count() == 17
    assert maintenance.prune_tablet_indexes(indexes, 2).changed == 4
    assert sorted(r["at_height"] for r in indexes.meta().where("identifier = 'aa'").collect()) == [1, 3, 5, 7, 9, 10]
    with pytest.raises(ValueError):
        maintenance.prune_tablet_indexes(indexes, 1)


def test_empty_index_is_no_entry(spark, tmp_path):
    indexes = IndexStore(LogStore(spark, str(tmp_path)))
    log = tablet(spark, [(5, "a", "1"), (6, "a", None)])
    marks = spark.createDataFrame([(1, "tbl", 3), (1, "tbl", 7)], "collection int, identifier string, at_height long")
    indexes.write(indexing.reindex(log, marks), indexing.squelched(log, marks))
    assert [(r["at_height"], r["squelched"], r["row_count"]) for r in indexes.meta().collect()] == [(7, 2, 0)]


# requests and stores


def test_requests(spark, tmp_path):
    store = LogStore(spark, str(tmp_path), buckets=2)
    first = [request(1, [(b"001", b"a"), (b"002", b"b"), (b"001", b"c")], [b"s1"]), request(2, [(b"002", b"")], [b"s2"])]
    frame = wr.as_frame(spark, first)
    assert [wr.WriteRequest.from_row(r) for r in frame.orderBy("height").collect()] == first
    assert write_requests(store, frame.limit(0), 0).requests == 0 and store.checkpoint() == Checkpoint()
    done = write_requests(store, frame, 0)
    assert (done.requests, done.tablet_rows, done.singlet_entries, done.indexed) == (2, 4, 2, 0)
    assert done.bytes == 4 * 16 + 3 + 2 * 13 + 4
    assert store.checkpoint() == Checkpoint(2, BlockRef(2, "00000002aa"))
    rows = reads.state_at(store.read("tablets"), 2).collect()
    assert [(bytes(r["pk"]), bytes(r["value"])) for r in rows] == [(b"001", b"c")]
    with pytest.raises(ContiguityError):
        write_requests(store, wr.as_frame(spark, [request(9)]), 1)
    write_requests(store, wr.as_frame(spark, [request(3)]), 1, Config(store.path, inject=True, skip_checkpoint=True))
    assert store.checkpoint().height == 2
    assert bytes(store.fetch("tablets", 1, b"tbl", 1, b"001")["value"]) == b"c"
    assert "value" not in store.entity("tablets", 1, b"tbl", keys_only=True).columns
    with pytest.raises(NotFound):
        store.fetch("tablets", 1, b"tbl", 1, b"009")
    with pytest.raises(NotFound):
        store.read("nothing")
    assert store.between("tablets", 2).count() == 1 and store.between("tablets", 0, 2).count() == 3
    store.purge("tablets", spark.createDataFrame([(1,)], "height long"), "kept")
    assert store.read("kept").count() == 1


def test_requests_are_made_once(spark, tmp_path):
    store = LogStore(spark, str(tmp_path), buckets=2)
    frame, made = counting(spark, wr.as_frame(spark, [request(h, [(b"%03d" % h, b"v")], [b"s"]) for h in range(1, 6)]))
    done = write_requests(store, frame, 0)
    assert (done.requests, done.tablet_rows, done.singlet_entries, store.checkpoint().height) == (5, 5, 5, 5)
    assert made.value == 5 and store.read("tablets").count() == 5


def test_checkpoint_versions(spark, tmp_path):
    store = LogStore(spark, str(tmp_path))
    for h in range(1, 6):
        store.commit(Checkpoint(h, BlockRef(h, "x")))
    assert len(store._names("checkpoints/checkpoint")) == 2 and store.checkpoint().height == 5
    (tmp_path / "checkpoints/checkpoint" / f"{5:012d}").write_text('{"height": 6')  # of a writer that was lost
    assert store.checkpoint().height == 5
    rival = LogStore(spark, str(tmp_path))
    rival._names = lambda name: [f"{4:012d}"]
    with pytest.raises(ContiguityError):
        rival.commit(Checkpoint(7, BlockRef(7, "y")))


def test_request_stream(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "store"), buckets=2)
    frame = wr.as_frame(spark, [request(h, [(b"%03d" % h, b"v")]) for h in range(1, 6)])
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    start_requests(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")), store, str(tmp_path / "cp")).awaitTermination()
    assert store.checkpoint().height == 5 and store.read("tablets").count() == 5


def test_block_manifest(spark, tmp_path):
    rows = tablet(spark, [(1, "a", "1"), (2, "a", "1")]).unionByName(tablet(spark, [(2, "a", "1")], "other"))
    sharding.write_shards(rows, str(tmp_path), 3, 1, 2)
    got = spark.read.parquet(str(tmp_path / "blocks" / sharding.segment(1, 2)))
    assert got.count() == 6 and got.where("height = 2").agg(F.sum("rows")).first()[0] == 2


# forks


def test_fork_steps(spark):
    view = forks.ForkView(keep_below=200, poll_seconds=0.0)
    for i, n, p in [("1a", 1, "0a"), ("2a", 2, "1a"), ("3a", 3, "2a"), ("3b", 3, "2a")]:
        view.process("new", i, n, p, f"w{i}")
    assert view.speculative(block_id="1a") == (["w1a"], 1)  # the first streamable block
    assert view.speculative(num=2) == (["w2a"], 1) and view.head == "3b"
    with pytest.raises(ValueError):
        view.process("undo", "3b", 3)
    written = lambda: Checkpoint(2, BlockRef(2, "2a"))
    view.process("irreversible", "2a", 2, checkpoint=written)  # not above the writer's block: nothing moves
    assert view.lib == (1, "1a")
    view.process("irreversible", "3a", 3, checkpoint=written)
    assert view.lib == (2, "2a") and "1a" in view.blocks
    view.poll_seconds = 60.0
    view.process("irreversible", "3a", 3, checkpoint=lambda: pytest.fail("too early"))
    view.process("irreversible", "3a", 3)
    assert view.lib == (3, "3a")


def test_reader_over_forks(spark, tmp_path):
    store = LogStore(spark, str(tmp_path), buckets=2)
    write_requests(store, wr.as_frame(spark, [request(1, [(b"002", b"abc")], [b"001"], "1a")]), 0)
    plain = Reader(store)
    assert plain.head() == BlockRef(1, "1a") and plain.speculative() == ([], 0) and plain.speculative(BlockRef(1)) == ([], 1)
    assert plain.reversible("1a") is None
    with pytest.raises(BlockNotFound):
        plain.speculative(BlockRef(2))
    with pytest.raises(NotReady):
        Reader(LogStore(spark, str(tmp_path / "none"))).speculative()
    with pytest.raises(NotReady):
        plain.process("new", request(2), "1a", 0.0)
    reader = Reader(store, forks.ForkView())
    with pytest.raises(NotReady):
        reader.speculative()
    now = time.time()
    for r, parent in [
        (request(1, [(b"002", b"abc")], [], "1a"), "0a"), (request(2, [(b"002", b"")], [b"002"], "2a"), "1a"),
        (request(3, [(b"002", b"def"), (b"003", b"x")], [], "3a"), "2a"), (request(3, [(b"004", b"y")], [], "3b"), "2a"),
    ]:
        reader.process("new", r, parent, now - 100 if r.height < 3 else now - 1, now)
    values = lambda df: [(bytes(r["pk"]), r["height"], bytes(r["value"])) for r in df.collect()]
    assert reader.head() == BlockRef(3, "3b") and reader.metrics.ready and reader.metrics.head_block_number == 3
    assert values(reader.tablets(3)) == [(b"004", 3, b"y")]
    assert values(reader.tablets(3, BlockRef(3, "3a"))) == [(b"002", 3, b"def"), (b"003", 3, b"x")]
    assert values(reader.tablets(2, BlockRef(2))) == []
    assert values(reader.tablet(1, b"tbl", 3, BlockRef(3, "3a")).where("height = 3")) == [(b"002", 3, b"def"), (b"003", 3, b"x")]
    assert values(reader.tablet_row(3, b"003", BlockRef(3, "3a"))) == [(b"003", 3, b"x")]
    assert [bytes(r["value"]) for r in reader.singlets(3).collect()] == [b"002"]
    assert [bytes(r["value"]) for r in reader.history().orderBy("at").collect()] == [b"002", b"001"]
    assert reader.reversible("3a")[0] == BlockRef(3, "3a") and values(plain.tablets(1)) == [(b"002", 1, b"abc")]


def test_metrics():
    m = Metrics()
    m.saw(5, 100.0, True, 110.0)
    assert (m.head_block_number, m.head_block_time_drift, m.ready) == (5, 10.0, True)
    m = Metrics()
    m.saw(5, 100.0, False, 110.0)
    m.saw(6, 100.0, True, 120.0)
    assert not m.ready


def finality(spark, tmp_path, batches):
    schema = "chain string, id string, num long, parent_id string, lib_num long, payload string"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    got = []
    try:
        for rows in batches:
            full = [("c", i, int(i[:-1]), p, lib, "w" + i) for i, p, lib in rows]
            spark.createDataFrame(full, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = final_blocks(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream
            stream = stream.foreachBatch(lambda df, n: got.append([r["id"] for r in df.collect()])).option("checkpointLocation", str(tmp_path / "cp"))
            stream.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return [x for x in got if x]


def test_finality_waits_for_a_late_ancestor(spark, tmp_path):
    batches = [[("1a", "0a", 0)], [("3a", "2a", 0), ("4a", "3a", 3)], [("2a", "1a", 0)], [("5a", "4a", 4)]]
    assert sum(finality(spark, tmp_path, batches), []) == ["1a", "2a", "3a", "4a"]


def test_finality_keeps_its_head(spark, tmp_path):
    batches = [[("1a", "0a", 0), ("2a", "1a", 1), ("3a", "2a", 1), ("4a", "3a", 1)], [("3b", "2a", 2)], [("5a", "4a", 3)]]
    assert sum(finality(spark, tmp_path, batches), []) == ["1a", "2a", "3a"]


class _State(dict):
    """A stub of keyed state that counts what is put into it."""

    puts = 0

    def updateValue(self, k, v):  # noqa: N802
        self.puts += 1
        self[k] = v

    containsKey, getValue, removeKey, iterator = dict.__contains__, dict.__getitem__, dict.__delitem__, dict.items  # noqa: N815


class _Value(list):
    exists, get = list.__len__, lambda self: self[0]

    def update(self, v):
        self[:] = [v]


def test_finality_keeps_only_waiting_blocks():
    state = _State()
    f = finality_module.Finality()
    f.waiting, f.final, f.head = state, _Value(), _Value()
    rows = [(str(n), n, str(n - 1), max(0, n - 3), "w") for n in range(1, 5001)]
    frames = [pd.DataFrame(rows[i : i + 999], columns=["id", "num", "parent_id", "lib_num", "payload"]) for i in range(0, 5000, 999)]
    out = pd.concat(f.handleInputRows(("c",), iter(frames), None))
    assert out["num"].tolist() == list(range(1, 4998)) and sorted(state) == [("4998",), ("4999",), ("5000",)] and state.puts == 3
    more = pd.DataFrame([("5001", 5001, "5000", 4999, "w")], columns=frames[0].columns)
    assert [r for df in f.handleInputRows(("c",), iter([more]), None) for r in df["id"]] == ["4998", "4999"] and sorted(state) == [("5000",), ("5001",)]


def test_finality_of_a_table_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(finality_module, "RANGE_ROWS", 7)
    rng, rows, want = random.Random(3), [], set()
    for chain in ("a", "b", "late", "one", None):
        top = 1 if chain == "one" else rng.randint(40, 90)
        blocks = {}
        for n in range(1, top + 1):
            for kind in "mxy"[: rng.randint(1, 3)]:  # side blocks hang on the main chain, on each other, far below or on nothing
                parents = [f"m{n - 1}"] if kind == "m" else [f"m{n - 1}", f"x{n - 1}", f"m{max(0, n - 30)}", "none"]
                blocks[f"{kind}{n}"] = (n, rng.choice(parents), max(0, n - 5))
        if chain == "late":
            del blocks["m20"]
        blocks["m%d" % (top + 1)] = (top + 1, f"m{top}", top - 4)
        rows += [(chain, i, n, p, lib, "w" + i) for i, (n, p, lib) in blocks.items()]
        at, lib = f"m{top + 1}", top - 4
        while chain != "late" and at in blocks:
            want |= {(chain, at, blocks[at][0], blocks[at][1], "w" + at)} if blocks[at][0] <= lib else set()
            at = blocks[at][1]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "chain string, id string, num long, parent_id string, lib_num long, payload string")
    got = [tuple(r) for r in final_blocks(table).collect()]
    assert len(got) == len(want) > 100 and set(got) == want
    assert final_blocks(table.limit(0)).count() == 0


def test_live_source(spark, tmp_path):
    spark.dataSource.register(LiveBlocks)
    query = (
        spark.readStream.format("stratum-live").option("feed", "tests.block_feed:blocks").option("limit", "3").load()
        .writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    )
    rows = lambda: spark.read.schema(LiveBlocks({}).schema()).parquet(str(tmp_path / "out"))
    try:
        ended = time.time() + 90
        while time.time() < ended and (not (tmp_path / "out" / "_spark_metadata").exists() or rows().count() < 7):
            time.sleep(1)
    finally:
        query.stop()
    assert [tuple(r) for r in rows().orderBy("num").collect()] == ROWS


# jobs


def test_modes(spark, tmp_path, capsys):

    frame = wr.as_frame(spark, [request(h, [(b"%03d" % h, b"v")]) for h in range(1, 4)])
    frame.write.parquet(str(tmp_path / "in"))
    go = lambda *a: run(parser().parse_args([*a, "--store", str(tmp_path / "s")]), spark)

    go("inject", "--input", str(tmp_path / "in"), "--on-inject", "stratum.reader:Metrics")
    go("server", "--height", "3", "--on-server", "stratum.reader:Metrics")
    go("index", "--height", "3")
    go("reindex", "--dry-run")
    go("prune", "--dry-run")
    out = capsys.readouterr().out
    assert "30 30 31" in out and "Counts(tablets=0, indexes=0, changed=0)" in out
    with pytest.raises(ValueError):
        go("inject-shards", "--shard-count", "2", "--shard-index", "2")





# codecs


def test_key_columns(spark):
    reg = Registry()
    reg.register(CollectionSpec(1, "t", "tablet", 3, 3))
    reg.register(CollectionSpec(2, "s", "singlet"))
    reg.register(CollectionSpec(3, "open", "tablet"))
    raw = [b"\0\1abc" + (10).to_bytes(8, "big") + b"ghi", b"\0\2abcd" + ((1 << 64) - 11).to_bytes(8, "big"), b"\0\3xy", b"\0\1ab", b"\0\x09abc", b"", None]
    df = spark.createDataFrame([(k,) for k in raw], "k binary")
    k = F.col("k")
    got = df.select(keys.decode_row(reg, k), keys.decode_entry(reg, k), keys.decode_tablet(reg, k), keys.decode_singlet(reg, F.when(F.length(k) == 14, F.substring(k, 1, 6)))).collect()
    assert tuple(got[0][0]) == (1, b"abc", 10, b"ghi") and [r[0] for r in got[1:]] == [None] * 6
    assert tuple(got[1][1]) == (2, b"abcd", 10) and got[0][1] is None
    assert tuple(got[2][2]) == (3, b"xy") and got[3][2] is None and tuple(got[0][2]) == (1, b"abc")
    assert tuple(got[1][3]) == (2, b"abcd")
