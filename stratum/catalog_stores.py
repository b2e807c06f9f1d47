"""Queries through stores, snapshots, shards, requests and forks, with the same result in SQL."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import keys
from .model import BlockRef, Checkpoint, CollectionSpec, Registry, shard_checkpoint_key
from .operators import forks, indexing, maintenance, reads, sharding, stats
from .plans.snapshots import row_with_indexes, state_with_indexes
from .sources.indexstore import IndexStore, index_key, key_of
from .sources.logstore import LogStore
from .sources.scratch import scratch
from .sources.tables import event_log, order_indexes, table
from .streaming import requests as wr
from .streaming.finality import final_blocks
from .streaming.ingest import write_requests as write_all

OUT = ("identifier", "pk", "height", "value")
HEIGHT = 250


def _top(log: DataFrame) -> int:
    return log.agg(F.max("height")).first()[0] or 0


def _bytes(c: str):
    return F.encode(F.col(c).cast("string"), "utf-8")


def text_log(s: SparkSession, d: str) -> DataFrame:
    """The event log with texts as values: the event's type, empty for errors."""
    e = table(s, d, "events").select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("text"))
    return event_log(s, d).join(e, "seq").select("collection", "identifier", "height", "pk", F.col("text").alias("value"), "seq")


def line_log(s: SparkSession, d: str) -> DataFrame:
    """lineitem as a log of two large tablets: ten orders a block, one row for each part, seventh lines as tombstones."""
    x = table(s, d, "lineitem")
    return x.select(
        F.lit(5).alias("collection"),
        F.col("l_linestatus").alias("identifier"),
        F.floor(F.col("l_orderkey") / 10).cast("long").alias("height"),
        F.col("l_partkey").alias("pk"),
        F.when(F.col("l_linenumber") < 7, F.col("l_quantity")).alias("value"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )


@cache
def _stored(app: str, d: str) -> tuple[LogStore, IndexStore]:
    """The event log in a store, with snapshots at height 200; built once for an application."""
    s = SparkSession.getActiveSession()
    store = LogStore(s, scratch(s, "events"))
    log = event_log(s, d)
    store.append("tablets", log, 0)
    indexes = IndexStore(store)
    marks = log.select("collection", "identifier", F.lit(200).cast("long").alias("at_height")).distinct()
    indexes.write(indexing.reindex(log, marks), indexing.squelched(log, marks))
    return store, indexes


def stored(s: SparkSession, d: str) -> tuple[DataFrame, IndexStore]:
    store, indexes = _stored(s.sparkContext.applicationId, d)
    return store.read("tablets").drop("bucket"), indexes


def empty_values(s: SparkSession, d: str) -> DataFrame:
    log = text_log(s, d)
    return reads.state_at(log, _top(log)).select(*OUT)


def empty_values_stored(s: SparkSession, d: str) -> DataFrame:
    log = text_log(s, d)
    store = LogStore(s, scratch(s, "empty"))
    store.append("log", log, 0)
    return reads.state_at(store.read("log"), _top(log)).select(*OUT)


def rows_sorted(s: SparkSession, d: str) -> DataFrame:
    rows = reads.state_at(event_log(s, d), HEIGHT)
    return rows.withColumn("at", F.row_number().over(Window.partitionBy("identifier").orderBy("pk")).cast("long")).select(*OUT, "at")


def tablet_at_indexed(s: SparkSession, d: str) -> DataFrame:
    log, indexes = stored(s, d)
    meta = indexes.at(HEIGHT)
    return state_with_indexes(log, meta, indexes.rows(meta), HEIGHT).select(*OUT)


def tablet_row_indexed(s: SparkSession, d: str) -> DataFrame:
    log, indexes = stored(s, d)
    meta = indexes.at(HEIGHT)
    return row_with_indexes(log, meta, indexes.rows(meta), HEIGHT, 11).select(*OUT)


def index_counters(s: SparkSession, d: str) -> DataFrame:
    log, indexes = stored(s, d)
    return maintenance.counters(log, indexes.newest(), _top(log)).select("identifier", "mutations", "at_height", "row_count")


def log_range(s: SparkSession, d: str) -> DataFrame:
    store, _ = _stored(s.sparkContext.applicationId, d)
    return store.between("tablets", 100, 300).select(*OUT, "seq")


def index_tables(s: SparkSession, d: str) -> DataFrame:
    log = line_log(s, d)
    indexes = IndexStore(LogStore(s, scratch(s, "lines")))
    last = _top(log)
    maintenance.index_tables(indexes, log, last * 9 // 10)
    maintenance.index_tables(indexes, log, last)
    return indexes.meta().select("identifier", "at_height", "squelched", "row_count")


def reindex_rows(s: SparkSession, d: str) -> DataFrame:
    log = event_log(s, d)
    indexes = IndexStore(LogStore(s, scratch(s, "reindex")))
    marks = log.select("collection", "identifier", (F.floor(F.col("height") / 100) * 100).alias("at_height")).distinct()
    wrong = indexing.reindex(log, marks).where("pk % 3 > 0")
    indexes.write(wrong, marks.withColumn("squelched", F.lit(1).cast("long")))
    maintenance.reindex_tablets(indexes, log)
    return indexes.rows(indexes.meta()).select("identifier", "pk", "at_height", "height")


def reindex_tablet(s: SparkSession, d: str) -> DataFrame:
    log, indexes = stored(s, d)
    rows, _ = maintenance.reindex_tablet(indexes, log, 1, 2, HEIGHT)
    return rows.select("identifier", "pk", "at_height", "height")


def prune_stored(s: SparkSession, d: str) -> DataFrame:
    marks = order_indexes(s, d)
    indexes = IndexStore(LogStore(s, scratch(s, "prune")))
    none = marks.limit(0).select("collection", "identifier", F.col("at_height").alias("pk"), "at_height", F.col("at_height").alias("height"))
    indexes.write(none, marks.withColumn("squelched", F.lit(1).cast("long")))
    maintenance.prune_tablet_indexes(indexes, 3)
    return indexes.meta().select("identifier", "at_height")


def checkpoints(s: SparkSession, d: str) -> DataFrame:
    store = LogStore(s, scratch(s, "checkpoints"))
    tops = event_log(s, d).groupBy("identifier").agg(F.max("height").alias("h")).orderBy("identifier").collect()
    for r in tops:
        for h in (0, r["h"]):
            store.commit(Checkpoint(h, BlockRef(h, f"b{h}")), shard_checkpoint_key(r["identifier"]))
    store.commit(Checkpoint(7, BlockRef(7, "b7")))
    live = store.checkpoint()
    rows = store.shard_checkpoints().select("shard", "height", F.col("block.id").alias("block_id"))
    return rows.unionByName(s.createDataFrame([(-1, live.height, live.block.id)], rows.schema))


def shard_round_trip(s: SparkSession, d: str) -> DataFrame:
    log = event_log(s, d)
    path, last = scratch(s, "shards"), _top(log)
    store = LogStore(s, f"{path}/store")
    store.check_clean_for_sharding()
    half = last // 2
    for start, stop in ((0, half), (half + 1, last)):
        sharding.write_shards(log, f"{path}/shards", 3, start, stop)
    for shard in range(3):
        sharding.inject_shard(store, f"{path}/shards", shard, "rows", "end")
    done = store.finish_sharding(3)
    rows = s.read.option("basePath", f"{path}/store/rows").parquet(*[f"{path}/store/rows/{n}/*" for n in store._names("rows")])
    return reads.state_at(rows, done.height).select(*OUT)


def shard_manifest(s: SparkSession, d: str) -> DataFrame:
    rows = event_log(s, d).withColumn("shard", stats.shard_of(3))
    manifest = sharding.block_manifest(rows, 3)
    return manifest.groupBy("height").agg(F.count_distinct("shard").alias("shards"), F.sum("rows").alias("rows"))


def shard_of_entities(s: SparkSession, d: str) -> DataFrame:
    rows = event_log(s, d).withColumn("identifier", F.col("pk"))
    per = stats.shard_stats(rows, stats.shard_of(5)).agg(F.sum("rows").alias("rows"), F.max("last_height").alias("last_height"))
    one = rows.withColumn("shard", stats.shard_of(5)).groupBy("identifier").agg(F.count_distinct("shard").alias("shards"))
    return one.crossJoin(F.broadcast(per))  # one row


def request_logs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The text log as the logs of requests, and their blocks."""
    rows = text_log(s, d)
    common = [F.col("collection"), _bytes("identifier").alias("identifier"), "height", _bytes("value").alias("value"), "seq", F.col("height").alias("request")]
    tablets = rows.select(*common, _bytes("pk").alias("pk"))
    singlets = rows.where("seq % 7 = 0").select(*common)
    blocks = rows.select("height").distinct().withColumn("block", F.struct(F.col("height").alias("num"), F.concat(F.lit("b"), F.col("height").cast("string")).alias("id")))
    return tablets, singlets, blocks


def request_round_trip(s: SparkSession, d: str) -> DataFrame:
    packed = wr.pack(*request_logs(s, d))
    text = lambda c: F.decode(c, "utf-8").alias(c)
    tablets = wr.tablet_rows(packed).select(F.lit("row").alias("kind"), "block_id", text("identifier"), "height", text("pk"), text("value"), "pos")
    entries = wr.singlet_entries(packed).select(F.lit("entry").alias("kind"), "block_id", text("identifier"), "height", F.lit("").alias("pk"), text("value"), "pos")
    return tablets.unionByName(entries)


def write_requests(s: SparkSession, d: str) -> DataFrame:
    packed = wr.pack(*request_logs(s, d))
    store = LogStore(s, scratch(s, "requests"))
    half = _top(packed) // 2
    write_all(store, packed.where(F.col("height") <= half), 0)
    write_all(store, packed.where(F.col("height") > half), 1)
    rows = reads.state_at(store.read("tablets"), store.checkpoint().height)
    text = lambda c: F.decode(c, "utf-8").alias(c)
    return rows.select(text("identifier"), text("pk"), "height", text("value"), F.lit(store.checkpoint().block.id).alias("checkpoint"))


def registry() -> Registry:
    out = Registry()
    out.register(CollectionSpec(1, "tst", "tablet", 3, 6))
    out.register(CollectionSpec(2, "sts", "singlet", 3))
    return out


def decode_keys(s: SparkSession, d: str) -> DataFrame:
    log, reg = event_log(s, d), registry()
    pad = lambda c, n: F.encode(F.lpad(F.col(c).cast("string"), n, "0"), "utf-8")
    row = keys.tablet_row_key(F.lit(1), pad("identifier", 3), F.col("height"), pad("pk", 6))
    entry = keys.singlet_key_at(F.lit(2), pad("identifier", 3), F.col("height"))
    got = log.select("seq", keys.decode_row(reg, row).alias("r"), keys.decode_entry(reg, entry).alias("e"), keys.decode_tablet(reg, row).alias("t"), keys.decode_singlet(reg, entry).alias("s"),
                     keys.decode_row(reg, F.substring(row, 1, 15)).alias("cut"), keys.decode_entry(reg, row).alias("other"))
    text = lambda c: F.decode(c, "utf-8")
    return got.select(
        "seq", F.col("r.collection").alias("collection"), text("r.identifier").alias("identifier"), F.col("r.height").alias("height"), text("r.pk").alias("pk"),
        text("e.identifier").alias("entry_identifier"), F.col("e.height").alias("entry_height"), text("t.identifier").alias("tablet"), text("s.identifier").alias("singlet"),
        F.col("cut").isNull().alias("cut_is_refused"), F.col("other").isNull().alias("other_is_refused"),
    )


def key_texts(s: SparkSession, d: str) -> DataFrame:
    log = event_log(s, d)
    return log.select("seq", keys.tablet_text(F.lit("tst"), F.col("identifier").cast("string")).alias("tablet"), keys.entry_text(F.lit("sts"), F.col("height")).alias("entry"))


def scalar_codecs(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    first, last = F.col("event_id") * 1_000_000, F.col("event_id") * 1_000_000 + 999_999
    name = F.when(F.col("event_id") % 9 == 0, F.lit("abc-1")).otherwise(keys.segment_name(first, last))
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    return e.select(
        "event_id", name.alias("name"), keys.file_span(name)["first"].alias("first"), keys.file_span(name)["last"].alias("last"),
        keys.shard_folder(F.col("event_id") % 500).alias("folder"), keys.near_realtime(F.col("ts"), now).alias("near"),
        keys.same_entity(F.lit(1), F.col("user_id") % 4, F.lit(1), F.when(F.col("user_id") % 5 > 0, F.col("user_id") % 3)).alias("same"),
    )


def index_codec(s: SparkSession, d: str) -> DataFrame:
    log = event_log(s, d)
    marks = log.select("collection", "identifier", F.lit(HEIGHT).cast("long").alias("at_height")).distinct()
    rows, meta = indexing.reindex(log, marks), indexing.squelched(log, marks)
    maps = indexing.as_maps(rows, meta)
    back = indexing.from_maps(maps).join(maps.select("collection", "identifier", "at_height", "squelched", F.size("rows").cast("long").alias("row_count")), ["collection", "identifier", "at_height"])
    key = keys.tablet_row_key(F.col("collection"), _bytes("identifier"), F.col("height"), _bytes("pk"))
    return back.select("identifier", "pk", "height", "squelched", "row_count", keys.hex_key(key).alias("row_key"), keys.hex_key(index_key(back)).alias("index_key"))


def tablets_by_key(s: SparkSession, d: str) -> DataFrame:
    marks = order_indexes(s, d)
    at = marks.groupBy("collection", "identifier").agg(F.count(F.lit(1)).alias("indexes"))
    lower = keys.tablet_key(F.lit(2), F.encode(F.lit("5"), "utf-8"))
    ranked = at.where(key_of(at) >= lower)
    # ranges of keys first, then places within them: no task orders all keys
    return ranked.withColumn("at", _rank(ranked, key_of(ranked))).select("identifier", "indexes", "at")


def _rank(rows: DataFrame, key):
    return F.row_number().over(Window.orderBy(key)).cast("long")


def write_totals(s: SparkSession, d: str) -> DataFrame:
    log = text_log(s, d)
    key = keys.tablet_row_key(F.col("collection"), _bytes("identifier"), F.col("height"), _bytes("pk"))
    return stats.totals(log, (F.length(key) + F.octet_length("value")).cast("long"))


def event_chain(s: SparkSession, d: str) -> DataFrame:
    """Blocks of the event log with side blocks: (id, num, parent_id); every fifth height has a second block, b, that nothing follows."""
    heights = event_log(s, d).select("height").distinct()
    main = heights.select(F.concat(F.lit("a"), "height").alias("id"), F.col("height").alias("num"), F.concat(F.lit("a"), F.col("height") - 1).alias("parent_id"))
    side = heights.where("height % 5 = 0").select(F.concat(F.lit("b"), "height").alias("id"), F.col("height").alias("num"), F.concat(F.lit("a"), F.col("height") - 1).alias("parent_id"))
    return main.unionByName(side)


def chain_log(s: SparkSession, d: str) -> DataFrame:
    """The event log with the block of each row: odd events of a height with two blocks are in b."""
    side = (F.col("height") % 5 == 0) & (F.col("seq") % 2 == 1)
    return event_log(s, d).withColumn("block_id", F.concat(F.when(side, "b").otherwise("a"), F.col("height").cast("string")))


def _fork(s: SparkSession, d: str, kind: str) -> DataFrame:
    """The state at a block 10 to 14 below the top, over what is final 30 below that: on the main chain or on a side block."""
    log = chain_log(s, d)
    num = (_top(log) - 10) // 5 * 5
    final = num - 30
    chain = forks.segment(event_chain(s, d), f"{kind}{num}", final)
    spec = log.where(F.col("height") > final).join(chain.select(F.col("id").alias("block_id"), F.col("num").alias("ord")), "block_id").withColumn("pos", F.col("seq"))
    stored_rows = log.where((F.col("height") <= final) & F.col("block_id").startswith("a"))
    return reads.state_at(stored_rows, num, spec).select(*OUT)


def fork_state_main(s: SparkSession, d: str) -> DataFrame:
    return _fork(s, d, "a")


def fork_state_side(s: SparkSession, d: str) -> DataFrame:
    return _fork(s, d, "b")


def final_chain(s: SparkSession, d: str) -> DataFrame:
    chain, num = F.col("user_id") % 3, F.row_number().over(Window.partitionBy(F.col("user_id") % 3).orderBy("event_id"))
    blocks = table(s, d, "events").select(
        F.concat(F.lit("c"), chain).alias("chain"), F.concat_ws("-", chain, num).alias("id"), num.cast("long").alias("num"), F.concat_ws("-", chain, num - 1).alias("parent_id"),
        F.greatest(num - 3, F.lit(0)).cast("long").alias("lib_num"), F.col("event_type").alias("payload"),
    )
    return final_blocks(blocks).select("chain", "id", "num", "payload")


QUERIES = {
    f.__name__: f
    for f in (
        empty_values, empty_values_stored, rows_sorted, tablet_at_indexed, tablet_row_indexed, index_counters, log_range, index_tables, reindex_rows, reindex_tablet,
        prune_stored, checkpoints, shard_round_trip, shard_manifest, shard_of_entities, request_round_trip, write_requests, decode_keys, key_texts, scalar_codecs,
        index_codec, tablets_by_key, write_totals, fork_state_main, fork_state_side, final_chain,
    )
}

_LOG = """log AS (SELECT event_id AS seq, cast(floor(event_id / 20) AS bigint) AS height, user_id % 4 AS identifier, user_id AS pk,
    CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS label FROM events)"""


def _state(where: str, value: str = "value", order: str = "height DESC, seq DESC") -> str:
    return f"""SELECT identifier, pk, height, value FROM (SELECT identifier, pk, height, {value} AS value, row_number() OVER (PARTITION BY identifier, pk
        ORDER BY {order}) AS rn FROM log WHERE {where}) WHERE rn = 1 AND value IS NOT NULL"""


def _snapshot(at: str, where: str) -> str:
    return f"SELECT identifier, pk, cast({at} AS bigint) AS at_height, height FROM ({_state(where)})"


_LINES = """log AS (SELECT l_linestatus AS identifier, cast(floor(l_orderkey / 10) AS bigint) AS height, l_partkey AS pk,
    CASE WHEN l_linenumber < 7 THEN l_quantity END AS value, l_orderkey * 10 + l_linenumber AS seq FROM lineitem)"""
_DUE = """CASE WHEN m < 25000 THEN false WHEN r IS NULL OR r <= 50000 THEN true WHEN r // 2 <= 100000 THEN m > r // 2 ELSE m >= 100000 END"""


def _fork_sql(kind: str) -> str:
    side = "height % 5 = 0 AND seq % 2 = 1"
    last = f"(height < n AND NOT ({side}) OR height = n AND " + (f"NOT ({side})" if kind == "a" else f"({side})") + ")"
    return f"""WITH {_LOG}, n AS (SELECT (max(height) - 10) // 5 * 5 AS n FROM log)
        SELECT identifier, pk, height, value FROM (SELECT identifier, pk, height, value, row_number() OVER (PARTITION BY identifier, pk
        ORDER BY height DESC, seq DESC) AS rn FROM log, n WHERE {last}) WHERE rn = 1 AND value IS NOT NULL"""


_HEX = "lower(hex(encode(cast({} AS varchar))))"
_EMPTY = f"WITH {_LOG} " + _state("true", "label")

ORACLE = {
    "empty_values": _EMPTY,
    "empty_values_stored": _EMPTY,
    "rows_sorted": f"WITH {_LOG} SELECT *, row_number() OVER (PARTITION BY identifier ORDER BY pk) AS at FROM ({_state('height <= 250')})",
    "tablet_at_indexed": f"WITH {_LOG} {_state('height <= 250')}",
    "tablet_row_indexed": f"WITH {_LOG} SELECT * FROM ({_state('height <= 250')}) WHERE pk = 11",
    "index_counters": f"""WITH {_LOG}, snap AS (SELECT identifier, count(*) AS n FROM ({_state('height <= 200')}) GROUP BY 1)
        SELECT l.identifier, count(*) AS mutations, cast(200 AS bigint) AS at_height, max(coalesce(s.n, 0)) AS row_count
        FROM log l LEFT JOIN snap s ON s.identifier = l.identifier WHERE height > 200 GROUP BY 1""",
    "log_range": f"WITH {_LOG} SELECT identifier, pk, height, value, seq FROM log WHERE height >= 100 AND height < 300",
    "index_tables": f"""WITH {_LINES}, h AS (SELECT max(height) AS h2, max(height) * 9 // 10 AS h1 FROM log),
        first AS (SELECT identifier, count(DISTINCT (pk, height)) AS squelched FROM log, h WHERE height <= h1 GROUP BY 1 HAVING count(*) >= 25000),
        live1 AS (SELECT identifier, count(*) AS n FROM (SELECT identifier, value, row_number() OVER (PARTITION BY identifier, pk ORDER BY height DESC, seq DESC) AS rn
            FROM log, h WHERE height <= h1) WHERE rn = 1 AND value IS NOT NULL GROUP BY 1),
        live2 AS (SELECT identifier, count(*) AS n FROM (SELECT identifier, value, row_number() OVER (PARTITION BY identifier, pk ORDER BY height DESC, seq DESC) AS rn
            FROM log) WHERE rn = 1 AND value IS NOT NULL GROUP BY 1),
        second AS (SELECT l.identifier, count(*) AS m, count(DISTINCT (pk, height)) AS squelched, max(CASE WHEN f.identifier IS NOT NULL THEN coalesce(live1.n, 0) END) AS r
            FROM log l CROSS JOIN h LEFT JOIN first f ON f.identifier = l.identifier LEFT JOIN live1 ON live1.identifier = l.identifier
            WHERE f.identifier IS NULL OR height > h1 GROUP BY 1)
        SELECT f.identifier, h1 AS at_height, f.squelched, coalesce(live1.n, 0) AS row_count FROM first f CROSS JOIN h LEFT JOIN live1 ON live1.identifier = f.identifier
        UNION ALL SELECT s.identifier, h2, s.squelched, coalesce(live2.n, 0) FROM second s CROSS JOIN h LEFT JOIN live2 ON live2.identifier = s.identifier WHERE {_DUE}""",
    "reindex_rows": f"""WITH {_LOG}, mark AS (SELECT DISTINCT identifier, cast(floor(height / 100) * 100 AS bigint) AS at_height FROM log)
        SELECT identifier, pk, at_height, height FROM (SELECT m.identifier, m.at_height, l.pk, l.height, l.value, row_number() OVER (PARTITION BY m.identifier, m.at_height, l.pk
            ORDER BY l.height DESC, l.seq DESC) AS rn FROM mark m JOIN log l ON l.identifier = m.identifier AND l.height <= m.at_height) WHERE rn = 1 AND value IS NOT NULL""",
    "reindex_tablet": f"WITH {_LOG} SELECT * FROM ({_snapshot('200', 'height <= 200')}) WHERE identifier = 2",
    "prune_stored": """SELECT identifier, at_height FROM (SELECT o_custkey AS identifier, o_orderkey AS at_height, row_number() OVER (PARTITION BY o_custkey
        ORDER BY o_orderkey DESC) AS pos, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE NOT (n > 5 AND pos > 1 AND pos < n AND (pos - 1) % 3 = 0)""",
    "checkpoints": f"""WITH {_LOG} SELECT cast(identifier AS integer) AS shard, max(height) AS height, 'b' || max(height) AS block_id FROM log GROUP BY 1
        UNION ALL SELECT -1, 7, 'b7'""",
    "shard_round_trip": f"WITH {_LOG} {_state('true')}",
    "shard_manifest": f"WITH {_LOG} SELECT height, cast(3 AS bigint) AS shards, count(*) AS rows FROM log GROUP BY 1",
    "shard_of_entities": f"""WITH {_LOG} SELECT DISTINCT pk AS identifier, cast(1 AS bigint) AS shards, (SELECT count(*) FROM log) AS rows,
        (SELECT max(height) FROM log) AS last_height FROM log""",
    "request_round_trip": f"""WITH {_LOG}, t AS (SELECT *, row_number() OVER (PARTITION BY height ORDER BY seq) - 1 AS pos FROM log),
        e AS (SELECT *, row_number() OVER (PARTITION BY height ORDER BY seq) - 1 AS pos FROM log WHERE seq % 7 = 0)
        SELECT 'row' AS kind, 'b' || height AS block_id, cast(identifier AS varchar) AS identifier, height, cast(pk AS varchar) AS pk, coalesce(label, '') AS value, pos FROM t
        UNION ALL SELECT 'entry', 'b' || height, cast(identifier AS varchar), height, '', coalesce(label, ''), pos FROM e""",
    "write_requests": f"""WITH {_LOG} SELECT cast(identifier AS varchar) AS identifier, cast(pk AS varchar) AS pk, height, value,
        (SELECT 'b' || max(height) FROM log) AS checkpoint FROM ({_state('true', 'label')})""",
    "decode_keys": f"""WITH {_LOG} SELECT seq, 1 AS collection, lpad(cast(identifier AS varchar), 3, '0') AS identifier, height, lpad(cast(pk AS varchar), 6, '0') AS pk,
        lpad(cast(identifier AS varchar), 3, '0') AS entry_identifier, height AS entry_height, lpad(cast(identifier AS varchar), 3, '0') AS tablet,
        lpad(cast(identifier AS varchar), 3, '0') AS singlet, true AS cut_is_refused, true AS other_is_refused FROM log""",
    "key_texts": f"""WITH {_LOG} SELECT seq, 'tst:' || identifier AS tablet, 'sts:' || lower(to_hex(cast(18446744073709551615 - height AS ubigint))) AS entry FROM log""",
    "scalar_codecs": """WITH x AS (SELECT event_id, ts, user_id, event_id * 1000000 AS a, event_id * 1000000 + 999999 AS b FROM events)
        SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'abc-1' ELSE printf('%010d-%010d', a, b) END AS name,
            CASE WHEN event_id % 9 > 0 AND b <= 4294967295 THEN a END AS first, CASE WHEN event_id % 9 > 0 AND b <= 4294967295 THEN b END AS last,
            printf('%03d', event_id % 500) AS folder, TIMESTAMP '2024-01-01 11:59:45' < ts AS near,
            CASE WHEN user_id % 5 > 0 THEN user_id % 4 = user_id % 3 ELSE false END AS same FROM x""",
    "index_codec": f"""WITH {_LOG}, snap AS ({_state('height <= 250')}), c AS (SELECT identifier, count(*) AS n FROM snap GROUP BY 1),
        q AS (SELECT identifier, count(DISTINCT (pk, height)) AS squelched FROM log WHERE height <= 250 GROUP BY 1)
        SELECT s.identifier, s.pk, s.height, q.squelched, c.n AS row_count,
            '0001' || {_HEX.format('s.identifier')} || lpad(lower(to_hex(s.height)), 16, '0') || {_HEX.format('s.pk')} AS row_key,
            'ffff0001' || {_HEX.format('s.identifier')} || lower(to_hex(cast(18446744073709551615 - 250 AS ubigint))) AS index_key
        FROM snap s JOIN c ON c.identifier = s.identifier JOIN q ON q.identifier = s.identifier""",
    "tablets_by_key": """SELECT identifier, indexes, row_number() OVER (ORDER BY cast(identifier AS varchar)) AS at FROM
        (SELECT o_custkey AS identifier, count(*) AS indexes FROM orders GROUP BY 1) WHERE cast(identifier AS varchar) >= '5'""",
    "write_totals": f"""WITH {_LOG} SELECT count(*) AS rows, count(DISTINCT identifier) AS entities,
        cast(sum(10 + length(cast(identifier AS varchar)) + length(cast(pk AS varchar)) + length(coalesce(label, ''))) AS bigint) AS bytes FROM log""",
    "fork_state_main": _fork_sql("a"),
    "fork_state_side": _fork_sql("b"),
    "final_chain": """WITH b AS (SELECT user_id % 3 AS c, event_type, row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) AS num FROM events),
        t AS (SELECT c, max(num) AS top FROM b GROUP BY 1)
        SELECT 'c' || b.c AS chain, b.c || '-' || num AS id, num, event_type AS payload FROM b JOIN t ON t.c = b.c WHERE num <= top - 3""",
}
