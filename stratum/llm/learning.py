"""What the classifiers share: the bounded labelled sample and held-out rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder; a null id is held out."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % modulus == remainder, F.lit(True))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, per_class: int, longest: int = 1 << 18
) -> tuple[pa.Array, np.ndarray]:
    """Texts and 0/1 labels of at most 2 * per_class rows that aren't held out, half of them of each class if there are as many.

    The rows with the least hash of the id are taken: a sample of the whole
    table, the same one on every run, however large the table is; so its ids may
    be broadcast.  Where a class is rare the other one fills up.  Null labels and ids are left out; an
    id that is labelled twice counts with its greatest label.  An id that several
    rows have gives its least text, and texts of more than `longest` bytes aren't
    learnt from (all are scored): so rows and bytes at the driver are bounded.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("y"))
        .where(F.col("y").isNotNull() & F.col("doc_id").isNotNull())
        .where(~held_out("doc_id", modulus, remainder))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    there = {r["y"]: r["count"] for r in known.where("y in (0, 1)").groupBy("y").count().collect()}
    chosen = None
    for y in (0, 1):
        many = max(per_class, 2 * per_class - there.get(1 - y, 0))
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(many)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(
        F.broadcast(chosen), "doc_id"
    )
    rows = rows.where(F.octet_length("text") <= longest).groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    got = rows.toArrow().combine_chunks()
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    got = got.take(pa.array(order))
    text = got.column("text").combine_chunks() if got.num_rows else pa.array([], pa.string())
    return text, got.column("y").to_numpy().astype(np.int64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))
