"""The corpus pipeline: documents in, packed training sequences out.

Every stage works on all that its predecessor kept; all but the last return the
columns of `documents`, whatever they are: extra columns of any name come along.

In every stage a null text counts as empty and stays a row (the passage stage
returns it as empty); a null doc_id stays null, is never preferred to another,
and is held out of training; texts of any length are worked on whole; an empty
table gives an empty one.  What the stages do with ties and repeated rows is
said beside them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stratum.llm import exact_dedup, jaccard, packing, suffix_tree, toxicity
from stratum.llm.shared import discard, materialize, scope


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject; repeated rows share their fate."""
    return toxicity.clean_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts: that with the largest id, and one row of it."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more): that with the least id; rows without an id stay."""
    return jaccard.keep_representatives(docs)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that a document with a smaller id has."""
    return suffix_tree.keep_first_passages(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 1024; repeated rows are packed each on their own."""
    return packing.pack(
        docs,
        public_tokenizers.path("byte_bpe_50k.json"),
        ranks_path=public_tokenizers.path("byte_bpe_50k.tiktoken"),
        pattern=public_tokenizers.PATTERN,
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", drop_passages),
    ("best-fit packing", pack_sequences),
]

#: A trained model decides in the first stage, and tokens in the last: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`; each result is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        with scope(spark):  # what a stage has written beside its result goes with it
            before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{i}", keep=True)
        if i:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
