"""Behaviour of the state engine on small cases."""

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from stratum import catalog
from stratum.config import Config
from stratum.functions import keys
from stratum.model import (
    BlockNotFound, BlockRef, Checkpoint, CollectionSpec, ContiguityError, InvalidKey, NotReady, Registry, shard_checkpoint_key,
)
from stratum.operators import forks, indexing, reads, sharding, stats
from stratum.plans.snapshots import choose, state_from_snapshot
from stratum.sources.logstore import LogStore
from stratum.streaming.finality import ROCKSDB, final_blocks
from stratum.streaming.ingest import check_next, json_mapper, start_ingest, write_batch

LOG = "collection int, identifier string, height long, pk string, value string, seq long"
SINGLET = "collection int, identifier string, height long, value string, seq long"


def tablet(spark, rows):
    return spark.createDataFrame([(1, "tbl", h, pk, v, i) for i, (h, pk, v) in enumerate(rows)], LOG)


def speculative(spark, rows):
    """[(request, height, pk, value)]"""
    return spark.createDataFrame([(1, "tbl", h, pk, v, 0, o, i) for i, (o, h, pk, v) in enumerate(rows)], LOG + ", ord long, pos long")


def state(df):
    return [(r["pk"], r["height"], r["value"]) for r in df.orderBy("pk").collect()]


def test_deletion_by_overlay(spark):
    assert state(reads.state_at(tablet(spark, [(123, "002", "abc")]), 124, speculative(spark, [(1, 124, "002", None)]))) == []


def test_only_overlay_and_no_height_filter(spark):
    empty = tablet(spark, [(900, "x", "y")])
    assert state(reads.state_at(empty, 124, speculative(spark, [(1, 999, "002", "abc")]))) == [("002", 999, "abc")]
    order = speculative(spark, [(1, 130, "002", "a"), (2, 125, "002", "b"), (2, 125, "002", "c")])
    assert state(reads.state_at(empty, 124, order)) == [("002", 125, "c")]


def test_snapshot_then_deletion_then_overlay(spark):
    log = tablet(spark, [(123, "002", "abc"), (100, "003", "old"), (124, "002", None)])
    snap = indexing.snapshot(log, 123)
    assert state(state_from_snapshot(log, snap, 123, 123)) == [("002", 123, "abc"), ("003", 100, "old")]
    assert state(state_from_snapshot(log, snap, 123, 125)) == [("003", 100, "old")]
    assert state(state_from_snapshot(log, snap, 123, 125, speculative(spark, [(1, 125, "002", "def")]))) == [("002", 125, "def"), ("003", 100, "old")]
    assert choose([100, 123, 200], 150) == 123 and choose([5], 4) is None


def test_row_at_height_0(spark):
    assert state(reads.row_at(tablet(spark, [(0, "002", "abc"), (0, "003", "x")]), 0, "002")) == [("002", 0, "abc")]


@pytest.mark.parametrize("stored,at,want", [((3, 5), 6, 5), ((3, 5), 4, 3), ((3, 4, 5), 4, 4), ((3, 5), 5, 5), ((3, 5), 3, 3), ((3, 5), 2, None), ((0, 1, 5), 0, 0)])
def test_singlet_as_of(spark, stored, at, want):
    log = spark.createDataFrame([(1, "s", h, str(h), h) for h in stored], SINGLET)
    assert [r["value"] for r in reads.singlet_at(log, at).collect()] == ([] if want is None else [str(want)])


def test_history(spark):
    log = spark.createDataFrame([(1, "s", h, str(h), h) for h in (0, 2, 1)], SINGLET)
    spec = spark.createDataFrame([(1, "s", 3, "3", 0, 1, 0)], SINGLET + ", ord long, pos long")
    assert [r["height"] for r in reads.history(log, spec).orderBy("at").collect()] == [3, 2, 1, 0]
    spec = spark.createDataFrame([(1, "s", h, str(h), 0, h, 0) for h in (0, 2, 5)], SINGLET + ", ord long, pos long")
    assert [r["height"] for r in reads.history(log.where("height > 9"), spec).orderBy("at").collect()] == [0, 2, 5]


def test_has_seen_counts_tombstones(spark):
    log = tablet(spark, [(5, "a", None)])
    assert reads.has_seen(log, 1, "tbl") and not reads.has_seen(log, 1, "other")


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 12), st.sampled_from("abc"), st.one_of(st.none(), st.text("xyz", min_size=1, max_size=2))), min_size=1, max_size=25), st.integers(0, 12), st.integers(0, 12))
def test_state_is_the_fold(spark, rows, at, snap_at):
    fold = {}
    for h, pk, v in sorted(rows, key=lambda r: r[0]):
        if h <= at:
            fold[pk] = (pk, h, v)
    want = sorted(x for x in fold.values() if x[2] is not None)
    log = tablet(spark, rows)
    assert state(reads.state_at(log, at)) == want
    low = min(at, snap_at)
    assert state(state_from_snapshot(log, indexing.snapshot(log, low), low, at)) == want


def test_key_vectors(spark):
    ident, pk = F.encode(F.lit("abc"), "utf-8"), F.encode(F.lit("ghi"), "utf-8")
    row = spark.range(1).select(
        keys.hex_key(keys.tablet_key(F.lit(0xFFF2), ident)),
        keys.hex_key(keys.tablet_key_at(F.lit(0xFFF2), ident, F.lit(10))),
        keys.hex_key(keys.tablet_row_key(F.lit(0xFFF2), ident, F.lit(10), pk)),
        keys.hex_key(keys.singlet_key_at(F.lit(0xFFF1), ident, F.lit(0))),
        keys.hex_key(keys.singlet_key_at(F.lit(0xFFF1), ident, F.lit(10))),
        keys.hex_key(keys.singlet_key_at(F.lit(0xFFF1), ident, F.lit(-1))),
        keys.file_span(F.lit("0103500000-0103999999")),
        keys.file_span(F.lit("abc-1")),
        keys.file_span(F.lit("123")),
        keys.segment_name(F.lit(5), F.lit(70)),
        keys.is_deletion(F.lit("")),
    ).first()
    assert row[:6] == ("fff2616263", "fff2616263000000000000000a", "fff2616263000000000000000a676869", "fff1616263" + "f" * 16, "fff1616263fffffffffffffff5", "fff1616263" + "0" * 16)
    assert tuple(row[6]) == (103500000, 103999999) and row[7] is None and row[8] is None
    assert row[9] == "0000000005-0000000070" and row[10]


def test_decoding_and_registry():
    reg = Registry()
    reg.register(CollectionSpec(1, "t", "tablet", 3, 3))
    reg.register(CollectionSpec(2, "s", "singlet", 3))
    assert keys.decode_row_key(reg, b"\0\1abc" + (10).to_bytes(8, "big") + b"ghi") == (1, b"abc", 10, b"ghi")
    assert keys.decode_entry_key(reg, b"\0\2abc" + ((1 << 64) - 11).to_bytes(8, "big")) == (2, b"abc", 10)
    for bad in (b"\0\1", b"\0\1abc\0", b"\0\2abc" + bytes(11)):
        with pytest.raises(InvalidKey):
            keys.decode_row_key(reg, bad)
    for spec in (CollectionSpec(1, "again", "singlet"), CollectionSpec(0xFFEF, "high", "tablet"), CollectionSpec(0xFFFF, "idx", "singlet")):
        with pytest.raises(ValueError):
            reg.register(spec)
    reg.register(CollectionSpec(0, "low", "tablet"))
    reg.register(CollectionSpec(0xFFEE, "top", "tablet"))


POLICY = [
    (None, 1, False), (None, 24999, False), (None, 25000, True), (None, 35000, True), (12500, 24999, False), (12500, 35000, True), (50000, 25000, True),
    (50001, 25000, False), (50001, 35000, True), (200000, 75000, False), (200000, 100000, False), (200000, 100001, True), (200001, 99999, False),
    (200001, 100000, False), (200001, 100001, True), (200002, 100000, True),
]


def test_index_policy(spark):
    df = spark.createDataFrame([(m, r, w) for r, m, w in POLICY], "m long, r long, want boolean")
    assert df.where(indexing.should_index(F.col("m"), F.col("r")) != F.col("want")).count() == 0


def test_prune_needs_a_frequency(spark):
    with pytest.raises(ValueError):
        indexing.prune(spark.range(1), 1)
    rows = spark.createDataFrame([(1, 1, h) for h in range(1, 11)], "collection int, identifier int, at_height long")
    assert sorted(r["at_height"] for r in indexing.prune(rows, 2).collect()) == [2, 4, 6, 8]


def test_forks():
    view = forks.ForkView(first_streamable=1, keep_below=0)
    with pytest.raises(NotReady):
        view.speculative()
    for i, n, p in [("1a", 1, "0a"), ("2a", 2, "1a"), ("3a", 3, "2a"), ("3b", 3, "2a"), ("4a", 4, "3a")]:
        view.add(i, n, p, f"w{i}")
    assert view.speculative() == (["w2a", "w3a", "w4a"], 1)
    assert view.speculative(num=3)[0] == ["w2a", "w3a"]
    assert view.speculative(block_id="3b")[0] == ["w2a", "w3b"]
    with pytest.raises(BlockNotFound):
        view.speculative(num=9)
    view.finalize("3a", 3)
    assert view.speculative() == (["w4a"], 3)
    with pytest.raises(BlockNotFound):
        view.speculative(block_id="3b")
    assert view.reversible("4a") == (4, "w4a") and view.reversible("2a") is None


def test_segment_both_ways(spark):
    rows = [("1a", 1, "0a"), ("2a", 2, "1a"), ("3a", 3, "2a"), ("3b", 3, "2a"), ("4a", 4, "3a")]
    blocks = spark.createDataFrame(rows, "id string, num long, parent_id string")
    for window in (100, 1):
        assert sorted(r["id"] for r in forks.segment(blocks, "4a", 1, window).collect()) == ["2a", "3a", "4a"]
    assert forks.segment(blocks, "zz", 1).count() == 0


def test_store_and_shards(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "s"), buckets=2)
    assert store.checkpoint() == Checkpoint()
    store.check_clean_for_sharding()
    rows = spark.createDataFrame(
        [(1, "tb1", 1, "001", "a", 0), (1, "tb1", 1, "002", "b", 1), (1, "tb2", 2, "001", "c", 2), (1, "tb2", 2, "002", "d", 3), (1, "tb1", 3, "002", "e", 4), (1, "tb2", 3, "001", "f", 5)], LOG
    )
    sharding.write_shards(rows, str(tmp_path / "sh"), 2, 1, 3)
    assert stats.shard_progress(store.shard_checkpoints(), 2).where("status = 'missing'").count() == 2
    for shard in (0, 1):
        assert sharding.inject_shard(store, str(tmp_path / "sh"), shard, "rows", "00000003aa") == Checkpoint(3, BlockRef(3, "00000003aa"))
        sharding.inject_shard(store, str(tmp_path / "sh"), shard, "rows")  # again: nothing to do
    done = store.finish_sharding(2)
    assert done == store.checkpoint() == Checkpoint(3, BlockRef(3, "00000003aa"))
    assert store.checkpoint(shard_checkpoint_key(0)) == Checkpoint()
    with pytest.raises(ContiguityError):
        store.check_clean_for_sharding()
    log = spark.read.option("basePath", str(tmp_path / "s/rows")).parquet(str(tmp_path / "s/rows/*/*"))
    assert [(r["identifier"], r["pk"], r["height"]) for r in reads.state_at(log, 3).orderBy("identifier", "pk").collect()] == [("tb1", "001", 1), ("tb1", "002", 3), ("tb2", "001", 3), ("tb2", "002", 2)]
    with pytest.raises(ContiguityError):
        stats.verify_all_shards(spark.createDataFrame([(0, 3), (1, 2)], "shard int, height long"), 2)


def test_write_batches(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "w"))
    write_batch(store, "log", tablet(spark, []), 0)
    assert store.checkpoint() == Checkpoint()
    write_batch(store, "log", tablet(spark, [(5, "a", "1"), (6, "a", "2")]), 1)
    write_batch(store, "log", tablet(spark, [(5, "a", "1"), (6, "a", "2")]), 1)
    assert store.read("log").count() == 2 and store.checkpoint().height == 6
    assert store.entity("log", 1, "tbl").count() == 2 and store.entity("log", 1, "zzz").count() == 0
    with pytest.raises(ContiguityError):
        write_batch(store, "log", tablet(spark, [(9, "a", "1")]), 2)
    check_next(9, Checkpoint(1, BlockRef()))
    write_batch(store, "log", tablet(spark, [(6, "a", "3"), (7, "b", "4")]), 3)
    store.compact("log", ("collection", "identifier", "height", "pk"), "small")
    assert store.read("small").count() == 3


def test_streaming_ingest(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    store = LogStore(spark, str(tmp_path / "store"), buckets=2)
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    start_ingest(stream, store, "log", json_mapper, str(tmp_path / "cp")).awaitTermination()
    assert store.read("log").count() == json_mapper(events).count()
    assert store.checkpoint().height == 49


def test_finality_stream(spark, tmp_path):
    schema = "chain string, id string, num long, parent_id string, lib_num long, payload string"
    first = [("c", "1a", 1, "0a", 0, "w1"), ("c", "2a", 2, "1a", 0, "w2a"), ("c", "2b", 2, "1a", 0, "w2b")]
    second = [("c", "3b", 3, "2b", 2, "w3b")]
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        got = []
        for rows in (first, second):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            q = (
                final_blocks(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
                .writeStream.foreachBatch(lambda df, n: got.extend(r["payload"] for r in df.collect()))
                .option("checkpointLocation", str(tmp_path / "cp"))
                .trigger(availableNow=True)
                .start()
            )
            q.awaitTermination()
        assert got == ["w1", "w2b"]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


@pytest.mark.parametrize("bad", [dict(), dict(server=True, shard=True, shard_count=2), dict(shard=True), dict(inject_shards=True, shard_count=2, shard_index=2)])
def test_config(bad):
    with pytest.raises(ValueError):
        Config("s", **bad).validate()
    Config("s", server=True, inject=True).validate()
    Config("s", inject_shards=True, shard_count=2, shard_index=1).validate()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_oracle(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("events", "orders", "documents", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, folder)
    cols = sorted(df.columns)
    got = sorted(map(str, (tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect())))
    rel = con.execute(f"SELECT {', '.join('"' + c + '"' for c in cols)} FROM ({catalog.ORACLE[name]})")
    want = sorted(map(str, (tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rel.fetchall())))
    assert got == want
