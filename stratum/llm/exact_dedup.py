"""Exact deduplication as a stateful stream.

Every text is reduced to a digest record (digest, id, file it came from).  A
structured stream folds those records into keyed state: one RocksDB entry per
digest with the stable id (the largest), the locator of its content and the
number of copies.  There is no watermark, so nothing expires.  Map-side partial
aggregation leaves one record per digest and task before the shuffle, so a text
that a third of all rows share is as cheap as any other.

Digests alone don't decide: wherever a digest was hit more than once, the whole
texts behind it are compared byte for byte.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, scope, settings, shared_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def digest_records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, source_file): what the stream reads; a null text counts as empty."""
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.unhex(F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"), 256)).alias("digest"),
        F.input_file_name().alias("source_file"),
    )


def fold_stream(records: DataFrame, out: str, checkpoint: str) -> None:
    """Runs the keyed state over a stream of digest records until what is available is read.

    The keys that a micro-batch touched are written to out/batch=N with their
    new state; writing a batch again after a failure replaces that folder.
    """
    state = records.groupBy("digest").agg(
        F.count(F.lit(1)).alias("group_size"),
        F.max(F.struct("doc_id", "source_file")).alias("keeper"),
    )

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

    # a store is closed when its task has committed it: open ones take some MB of disk for each partition
    with settings(records.sparkSession, spark__sql__streaming__stateStore__providerClass=ROCKSDB, spark__sql__streaming__stateStore__unloadOnCommit="true"):
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(write)
            .start()
        )
        query.awaitTermination()


def latest_state(spark: SparkSession, out: str) -> DataFrame:
    """The newest state of every digest: (digest, keep_id, locator, group_size)."""
    schema = "digest binary, group_size long, keeper struct<doc_id: long, source_file: string>, batch long"
    rows = spark.read.schema(schema).parquet(out)
    newest = rows.groupBy("digest").agg(F.max_by(F.struct("group_size", "keeper"), "batch").alias("s"))
    return newest.select(
        "digest",
        F.col("s.keeper.doc_id").alias("keep_id"),
        F.col("s.keeper.source_file").alias("locator"),
        F.col("s.group_size").alias("group_size"),
    )


def clashes(docs: DataFrame, state: DataFrame, text_col: str = "text", few: int = 100_000) -> DataFrame:
    """The digests that different texts share: whole texts behind every digest that was hit again are compared byte for byte.

    Equal texts collapse under partial aggregation, so no task sees a whole
    group of copies.  Up to `few` hits are broadcast, and no other text moves;
    with more of them texts are grouped first and joined then.
    """
    hits = state.where("group_size > 1").select("digest")
    texts = _digested(docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t")))
    if hits.count() <= few:
        texts = texts.join(F.broadcast(hits), "digest", "left_semi")
        return texts.distinct().groupBy("digest").count().where("count > 1").select("digest")
    different = texts.distinct().groupBy("digest").count().where("count > 1").select("digest")
    return different.join(hits, "digest", "left_semi")


def _digested(texts: DataFrame) -> DataFrame:
    return texts.withColumn("digest", F.unhex(F.sha2(F.col("t").cast("binary"), 256)))


def split_by_text(docs: DataFrame, clash: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """What exact_dedup returns for the rows whose digest stands for several texts: groups are the texts themselves."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"), F.input_file_name().alias("source_file"))
    rows = _digested(rows).join(clash, "digest")
    state = rows.groupBy("t").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "source_file")).alias("keeper"))
    state = state.select("t", "group_size", F.col("keeper.doc_id").alias("keep_id"), F.col("keeper.source_file").alias("locator"))
    return rows.join(state, "t").select("doc_id", "digest", "keep_id", "group_size", "locator", F.xxhash64("t").alias("which"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that exact_dedup keeps; of rows that repeat both id and text any one.

    Odd rows are as in exact_dedup; columns of any other name are carried along.
    """
    with scope(docs.sparkSession):
        found = _fates(docs, id_col, text_col).where("group_size > 1")
        copies = found.groupBy(F.struct("doc_id", "digest", "which").alias("row")).agg(F.first(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), F.count(F.lit(1)).alias("times"))
        fates = materialize(copies.where("not kept or times > 1"), "fates", keep=True)
    text = F.coalesce(docs[text_col], F.lit(""))
    row, digest = fates["row"], F.unhex(F.sha2(text.cast("binary"), 256))
    # which tells texts of one digest apart, where that is needed
    same = docs[id_col].cast("long").eqNullSafe(row["doc_id"]) & (digest == row["digest"]) & (row["which"].isNull() | (row["which"] == F.xxhash64(text)))
    single = docs.join(fates, same, "left_anti")
    again = fates.where("kept")
    if again.isEmpty():
        return single
    # one of each: the whole rows under one name, so that no column of docs can clash
    whole = docs.join(again, same).select(F.struct(*(docs[c] for c in docs.columns)).alias("doc"), again["row"].alias("row"))
    return single.unionByName(whole.dropDuplicates(["row"]).select("doc.*"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, locator.

    Of equal texts the row with the largest id stays.  A null text equals an
    empty one.  A null id never wins over another; rows that repeat an id share
    its fate, each of them with the same `kept`.  Different texts of one digest
    are groups of their own.  A text of any length is a digest of 32 bytes; it is
    read whole, and compared whole if the digest comes again.  An empty table
    gives an empty result.  Other columns are not read.
    """
    return _fates(docs, id_col, text_col).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "locator",
    )


def _fates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, digest, keep_id, group_size, locator, which) of every row; which is null but for texts whose digest isn't theirs alone."""
    spark = docs.sparkSession
    records = materialize(digest_records(docs, id_col, text_col), "digests")
    out, checkpoint = shared_path(spark, "dedup-state"), shared_path(spark, "dedup-checkpoint")
    source = records.inputFiles()
    if source:
        folder = source[0].rsplit("/", 1)[0]
        fold_stream(spark.readStream.schema(records.schema).parquet(folder), out, checkpoint)
    spark.range(0).selectExpr(
        "cast(null as binary) digest", "id group_size", "struct(id as doc_id, cast(null as string) as source_file) keeper"
    ).coalesce(1).write.parquet(f"{out}/batch=-1")  # so that an empty stream has a state too
    state = latest_state(spark, out)
    clash = materialize(clashes(docs, state, text_col), "clashes")
    plain = records.join(state, "digest").select("doc_id", "digest", "keep_id", "group_size", "locator", F.lit(None).cast("long").alias("which"))
    if clash.isEmpty():
        return plain
    return plain.join(clash, "digest", "left_anti").unionByName(split_by_text(docs, clash, id_col, text_col))
