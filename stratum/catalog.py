"""Queries over the plain tables for each operator, with the same result in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import keys
from .operators import forks, indexing, reads, stats
from .plans.snapshots import state_from_snapshot
from .sources.tables import event_blocks, event_log, order_indexes, singlet_log, table
from .streaming.ingest import json_mapper

HEIGHT = 250
OUT = ("identifier", "pk", "height", "value")


def top(log: DataFrame) -> int:
    """The highest height."""
    return log.agg(F.max("height")).first()[0] or 0


def _spec(log: DataFrame, above: int) -> DataFrame:
    """Rows above a height as a speculative list: one request for each block."""
    return log.where(F.col("height") > above).withColumns({"ord": F.col("height"), "pos": F.col("seq")})


def write_upsert(s: SparkSession, d: str) -> DataFrame:
    return reads.upsert(event_log(s, d)).select(*OUT, "seq")


def tablet_at(s: SparkSession, d: str) -> DataFrame:
    return reads.state_at(event_log(s, d), HEIGHT).select(*OUT)


def tablet_at_snapshot(s: SparkSession, d: str) -> DataFrame:
    log = event_log(s, d)
    return state_from_snapshot(log, indexing.snapshot(log, 200), 200, HEIGHT).select(*OUT)


def tablet_row_at(s: SparkSession, d: str) -> DataFrame:
    return reads.row_at(event_log(s, d), HEIGHT, 11).select(*OUT)


def singlet_at(s: SparkSession, d: str) -> DataFrame:
    return reads.singlet_at(singlet_log(s, d), HEIGHT).select("identifier", "height", "value")


def singlet_entries(s: SparkSession, d: str) -> DataFrame:
    return reads.history(singlet_log(s, d)).select("identifier", "height", "value", "at", "is_deletion")


def singlet_entries_speculative(s: SparkSession, d: str) -> DataFrame:
    log = singlet_log(s, d)
    final = top(log) - 20
    return reads.history(log.where(F.col("height") <= final), _spec(log, final)).select("identifier", "height", "value", "at", "is_deletion")


def has_seen(s: SparkSession, d: str) -> DataFrame:
    return reads.seen(event_log(s, d)).select("identifier")


def overlay(s: SparkSession, d: str) -> DataFrame:
    log = event_log(s, d)
    final = top(log) - 20
    return reads.state_at(log, final, _spec(log, final)).select(*OUT)


def asof_probe(s: SparkSession, d: str) -> DataFrame:
    probes = table(s, d, "orders").select(
        F.lit(1).alias("collection"),
        F.col("o_custkey").alias("identifier"),
        F.col("o_orderkey").alias("probe_id"),
        (F.col("o_orderkey") % 500).alias("probe_height"),
    )
    return reads.as_of(probes, singlet_log(s, d), reads.ENTITY).select("probe_id", "identifier", "probe_height", "height", "value")


def index_snapshot(s: SparkSession, d: str) -> DataFrame:
    return indexing.snapshot(event_log(s, d), HEIGHT).select("identifier", "pk", "at_height", "height")


def index_advance(s: SparkSession, d: str) -> DataFrame:
    log = event_log(s, d)
    return indexing.advance(indexing.snapshot(log, 200), log, 200, HEIGHT).select("identifier", "pk", "at_height", "height")


def index_stats(s: SparkSession, d: str) -> DataFrame:
    return indexing.snapshot_stats(event_log(s, d), HEIGHT, 200).select("identifier", "live_rows", "squelched")


def should_index(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    m, r = F.col("o_orderkey") * 9, F.when(F.col("o_orderkey") % 5 > 0, F.col("o_custkey") * 211)
    return o.select("o_orderkey", m.alias("mutations"), r.alias("index_rows"), indexing.should_index(m, r).alias("due"))


def prune_indexes(s: SparkSession, d: str) -> DataFrame:
    return indexing.prune(order_indexes(s, d), 3).select("identifier", "at_height")


def tablet_index_at(s: SparkSession, d: str) -> DataFrame:
    return indexing.index_at(order_indexes(s, d), 1000).select("identifier", "at_height")


def ignore_range(s: SparkSession, d: str) -> DataFrame:
    return indexing.index_at(order_indexes(s, d), 1200, (400, 1000)).select("identifier", "at_height")


def list_indexes(s: SparkSession, d: str) -> DataFrame:
    return indexing.list_indexes(order_indexes(s, d), 1200, F.lit(50)).select("identifier", "indexes", "first_height", "last_height")


def reindex(s: SparkSession, d: str) -> DataFrame:
    marks = event_log(s, d).select("collection", "identifier", (F.floor(F.col("height") / 10) * 10).alias("at_height")).distinct()
    return indexing.live_counts(event_log(s, d), marks).select("identifier", "at_height", "live_rows")


def mutation_counts(s: SparkSession, d: str) -> DataFrame:
    return stats.mutation_counts(event_log(s, d)).select("identifier", "mutations")


def write_stats_top5(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select(F.lit(4).alias("collection"), F.col("source").alias("identifier"), "text")
    top = stats.top_entities(stats.write_stats(docs, F.octet_length("text").cast("long")))
    return top.select("identifier", "rows", "bytes")


def shard_stats(s: SparkSession, d: str) -> DataFrame:
    return stats.shard_stats(event_log(s, d), (F.col("identifier") % 3).cast("int"))


def shard_progress(s: SparkSession, d: str) -> DataFrame:
    marks = event_log(s, d).groupBy((F.col("identifier") * 2).cast("int").alias("shard")).agg(F.max(F.floor(F.col("height") / 4) * 4).alias("height"))
    return stats.shard_progress(marks, 8)


def fork_segment(s: SparkSession, d: str) -> DataFrame:
    return forks.segment(event_blocks(s, d), 480, 415).select("id", "num", "parent_id")


def spec_prefix_height(s: SparkSession, d: str) -> DataFrame:
    log = event_log(s, d)
    return forks.prefix_by_height(_spec(log, -1), top(log) // 2).select("height", "pk", "ord")


def spec_prefix_id(s: SparkSession, d: str) -> DataFrame:
    log = event_log(s, d)
    return forks.prefix_by_id(_spec(log, -1).withColumn("block_id", F.col("height").cast("string")), str(top(log) // 2)).select("height", "pk", "ord")


def stats_block_mapper(s: SparkSession, d: str) -> DataFrame:
    rows = json_mapper(table(s, d, "events"))
    return rows.groupBy("identifier", "pk").agg(F.count(F.lit(1)).alias("mutations"), F.sum("value").alias("total"), F.max("height").alias("last_height"))


def keys_codec(s: SparkSession, d: str) -> DataFrame:
    log = event_log(s, d)
    ident, pk = F.encode(F.lpad(F.col("identifier").cast("string"), 3, "0"), "utf-8"), F.encode(F.lpad(F.col("pk").cast("string"), 6, "0"), "utf-8")
    c = F.lit(0x0102)
    row = keys.tablet_row_key(c, ident, F.col("height"), pk)
    entry = keys.singlet_key_at(c, ident, F.col("height"))
    return log.select(
        "seq",
        keys.hex_key(row).alias("row_key"),
        keys.hex_key(entry).alias("entry_key"),
        keys.decode_height(row, 5).alias("row_height"),
        keys.decode_height(entry, 5, inverted=True).alias("entry_height"),
        keys.row_text(F.lit("tst"), F.col("height"), F.lpad(F.col("pk").cast("string"), 6, "0")).alias("row_text"),
    )


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """The state of every tablet at a height."""
    return tablet_at(spark, folder)


QUERIES = {
    f.__name__: f
    for f in (
        write_upsert, tablet_at, tablet_at_snapshot, tablet_row_at, singlet_at, singlet_entries, singlet_entries_speculative, has_seen, overlay,
        asof_probe, index_snapshot, index_advance, index_stats, should_index, prune_indexes, tablet_index_at, ignore_range, list_indexes, reindex,
        mutation_counts, write_stats_top5, shard_stats, shard_progress, fork_segment, spec_prefix_height, spec_prefix_id, stats_block_mapper, keys_codec,
    )
}

_LOG = """log AS (SELECT event_id AS seq, cast(floor(event_id / 20) AS bigint) AS height, user_id % 4 AS identifier, user_id AS pk,
    CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value FROM events)"""
_ENTRY = """entry AS (SELECT identifier, height, value FROM (SELECT pk AS identifier, height, value, seq,
    row_number() OVER (PARTITION BY pk, height ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1)"""
_STATE = f"""WITH {_LOG} SELECT identifier, pk, height, value FROM (SELECT *, row_number() OVER (PARTITION BY identifier, pk
    ORDER BY height DESC, seq DESC) AS rn FROM log WHERE height <= 250) WHERE rn = 1 AND value IS NOT NULL"""
_SNAP = f"""WITH {_LOG} SELECT identifier, pk, cast(250 AS bigint) AS at_height, height FROM (SELECT *, row_number() OVER (PARTITION BY identifier, pk
    ORDER BY height DESC, seq DESC) AS rn FROM log WHERE height <= 250) WHERE rn = 1 AND value IS NOT NULL"""

ORACLE = {
    "write_upsert": f"""WITH {_LOG} SELECT identifier, pk, height, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY identifier, height, pk
        ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1""",
    "tablet_at": _STATE,
    "tablet_at_snapshot": _STATE,
    "tablet_row_at": _STATE + " AND pk = 11",
    "singlet_at": f"""WITH {_LOG} SELECT identifier, height, value FROM (SELECT pk AS identifier, height, value, row_number() OVER (PARTITION BY pk
        ORDER BY height DESC, seq DESC) AS rn FROM log WHERE height <= 250) WHERE rn = 1 AND value IS NOT NULL""",
    "singlet_entries": f"""WITH {_LOG}, {_ENTRY} SELECT identifier, height, value, row_number() OVER (PARTITION BY identifier ORDER BY height DESC) AS at,
        value IS NULL AS is_deletion FROM entry""",
    "singlet_entries_speculative": f"""WITH {_LOG}, {_ENTRY},
        both_ AS (SELECT identifier, height, value, 1 AS src, -height AS o, 0 AS p FROM entry WHERE height <= (SELECT max(height) - 20 FROM log)
            UNION ALL SELECT pk, height, value, 0, height, seq FROM log WHERE height > (SELECT max(height) - 20 FROM log))
        SELECT identifier, height, value, row_number() OVER (PARTITION BY identifier ORDER BY src, o, p) AS at, value IS NULL AS is_deletion FROM both_""",
    "has_seen": f"WITH {_LOG} SELECT DISTINCT identifier FROM log",
    "overlay": f"""WITH {_LOG} SELECT identifier, pk, height, value FROM (SELECT *, row_number() OVER (PARTITION BY identifier, pk
        ORDER BY CASE WHEN height > (SELECT max(height) - 20 FROM log) THEN 1 ELSE 0 END DESC, height DESC, seq DESC) AS rn FROM log) WHERE rn = 1 AND value IS NOT NULL""",
    "asof_probe": f"""WITH {_LOG}, {_ENTRY}, probe AS (SELECT o_orderkey AS probe_id, o_custkey AS identifier, o_orderkey % 500 AS probe_height FROM orders)
        SELECT probe_id, identifier, probe_height, height, value FROM (SELECT p.probe_id, p.identifier, p.probe_height, e.height, e.value
            FROM probe p ASOF JOIN entry e ON p.identifier = e.identifier AND p.probe_height >= e.height) WHERE value IS NOT NULL""",
    "index_snapshot": _SNAP,
    "index_advance": _SNAP,
    "index_stats": f"""WITH {_LOG}, live AS (SELECT identifier, count(*) AS n FROM ({_STATE}) GROUP BY identifier),
        sq AS (SELECT identifier, count(*) AS n FROM (SELECT DISTINCT identifier, pk, height FROM log WHERE height > 200 AND height <= 250) GROUP BY identifier)
        SELECT coalesce(live.identifier, sq.identifier) AS identifier, coalesce(live.n, 0) AS live_rows, coalesce(sq.n, 0) AS squelched
        FROM live FULL JOIN sq ON live.identifier = sq.identifier""",
    "should_index": """SELECT o_orderkey, mutations, index_rows, CASE WHEN mutations < 25000 THEN false WHEN index_rows IS NULL OR index_rows <= 50000 THEN true
        WHEN index_rows // 2 <= 100000 THEN mutations > index_rows // 2 ELSE mutations >= 100000 END AS due
        FROM (SELECT o_orderkey, o_orderkey * 9 AS mutations, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey * 211 END AS index_rows FROM orders)""",
    "prune_indexes": """SELECT identifier, at_height FROM (SELECT o_custkey AS identifier, o_orderkey AS at_height, row_number() OVER (PARTITION BY o_custkey
        ORDER BY o_orderkey DESC) AS pos, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE n > 5 AND pos > 1 AND pos < n AND (pos - 1) % 3 = 0""",
    "tablet_index_at": "SELECT o_custkey AS identifier, max(o_orderkey) AS at_height FROM orders WHERE o_orderkey <= 1000 GROUP BY 1",
    "ignore_range": """SELECT o_custkey AS identifier, max(o_orderkey) AS at_height FROM orders
        WHERE o_orderkey <= 1200 AND NOT (o_orderkey > 400 AND o_orderkey <= 1000) GROUP BY 1""",
    "list_indexes": """SELECT o_custkey AS identifier, count(*) AS indexes, min(o_orderkey) AS first_height, max(o_orderkey) AS last_height
        FROM orders WHERE o_orderkey <= 1200 AND o_custkey >= 50 GROUP BY 1""",
    "reindex": f"""WITH {_LOG}, kept AS (SELECT identifier, pk, height, value FROM (SELECT *, row_number() OVER (PARTITION BY identifier, pk, height
            ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1),
        span AS (SELECT identifier, height AS lo, lead(height) OVER (PARTITION BY identifier, pk ORDER BY height) AS hi, value FROM kept),
        mark AS (SELECT DISTINCT identifier, cast(floor(height / 10) * 10 AS bigint) AS at_height FROM log)
        SELECT m.identifier, m.at_height, count(s.identifier) AS live_rows FROM mark m LEFT JOIN span s ON s.identifier = m.identifier
            AND s.value IS NOT NULL AND s.lo <= m.at_height AND (s.hi IS NULL OR s.hi > m.at_height) GROUP BY 1, 2""",
    "mutation_counts": f"WITH {_LOG} SELECT identifier, count(*) AS mutations FROM log GROUP BY identifier",
    "write_stats_top5": """SELECT source AS identifier, count(*) AS rows, cast(sum(strlen(text)) AS bigint) AS bytes FROM documents GROUP BY source
        ORDER BY bytes DESC, identifier LIMIT 5""",
    "shard_stats": f"""WITH {_LOG} SELECT cast(identifier % 3 AS integer) AS shard, count(*) AS rows, count(DISTINCT height) AS blocks, max(height) AS last_height
        FROM log GROUP BY 1""",
    "shard_progress": f"""WITH {_LOG}, mark AS (SELECT cast(identifier * 2 AS integer) AS shard, max(cast(floor(height / 4) * 4 AS bigint)) AS height FROM log GROUP BY 1),
        ref AS (SELECT arg_min(height, shard) AS reference FROM mark)
        SELECT cast(r.shard AS integer) AS shard, m.height, CASE WHEN m.height IS NULL THEN 'missing' WHEN m.height <> ref.reference THEN 'faulty' ELSE 'done' END AS status
        FROM (SELECT unnest(range(8)) AS shard) r LEFT JOIN mark m ON m.shard = r.shard CROSS JOIN ref""",
    "fork_segment": """WITH RECURSIVE b AS (SELECT event_id AS id, event_id AS num, event_id - 1 AS parent_id FROM events WHERE event_id > 415),
        walk AS (SELECT id, num, parent_id FROM b WHERE id = 480 UNION ALL SELECT b.id, b.num, b.parent_id FROM walk w JOIN b ON b.id = w.parent_id)
        SELECT id, num, parent_id FROM walk""",
    "spec_prefix_height": f"WITH {_LOG} SELECT height, pk, height AS ord FROM log WHERE height <= (SELECT max(height) // 2 FROM log)",
    "spec_prefix_id": f"WITH {_LOG} SELECT height, pk, height AS ord FROM log WHERE height <= (SELECT max(height) // 2 FROM log)",
    "stats_block_mapper": """SELECT identifier, pk, count(*) AS mutations, sum(v) AS total, max(height) AS last_height FROM (
        SELECT event_type AS identifier, cast(floor(event_id / 20) AS bigint) AS height, k AS pk, cast(json_extract_string(props, '$.' || k) AS double) AS v
        FROM (SELECT *, unnest(json_keys(props)) AS k FROM events)) GROUP BY 1, 2""",
    "keys_codec": """WITH k AS (SELECT event_id AS seq, cast(floor(event_id / 20) AS bigint) AS h, '0102' || lower(hex(encode(lpad(cast(user_id % 4 AS varchar), 3, '0')))) AS t,
            lpad(cast(user_id AS varchar), 6, '0') AS p FROM events)
        SELECT seq, t || lpad(lower(to_hex(h)), 16, '0') || lower(hex(encode(p))) AS row_key, t || lower(to_hex(cast(18446744073709551615 - h AS ubigint))) AS entry_key,
            h AS row_height, h AS entry_height, 'tst:' || lpad(lower(to_hex(h)), 16, '0') || ':' || p AS row_text FROM k""",
}

# the queries over stores, which use the ones above
from . import catalog_stores  # noqa: E402

QUERIES |= catalog_stores.QUERIES
ORACLE |= catalog_stores.ORACLE
