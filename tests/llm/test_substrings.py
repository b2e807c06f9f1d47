import random

import brute
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from stratum.llm.chunks import cut_chunks, find_repeats, gram_levels, keyed
from stratum.llm.suffix_array import suffix_dedup
from stratum.llm.suffix_tree import keep_first_passages, substring_dedup

SCHEMA = "doc_id long, text string, chunk string, anchor long, marks int"


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocab = ["a", "bb", "ccc", "dé", "E", "日本", "zz-", "q"]
    passages = [" ".join(rng.choices(vocab, k=rng.randint(5, 40))) for _ in range(6)]
    rows = []
    for i in range(n):
        text = " ".join(rng.choices([*passages, *(" ".join(rng.choices(vocab, k=9)) for _ in range(6))], k=rng.randint(0, 5)))
        rows.append((i, text))
    rows += [(n, None), (n + 1, ""), (n + 2, "a " * 300), (n + 3, "same " * 40), (n + 4, "same " * 41), (None, rows[3][1] * 2), (5, rows[5][1])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1, None) for d, t in rows], SCHEMA)


def as_rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup_is_the_definition(spark, seed):
    rows = corpus(seed)
    got = as_rows(suffix_dedup(frame(spark, rows), window=24, gram=8, block=2000), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.suffix_dedup(rows, 24)


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup_is_the_definition(spark, seed):
    rows = corpus(seed)
    got = as_rows(substring_dedup(frame(spark, rows), window=10, gram=3, block=2000, subtree=8), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute.substring_dedup(rows, 10)


def test_generated_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = as_rows(suffix_dedup(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.suffix_dedup(rows, 200)
    assert sum(r[2] for r in got) > 0
    got = as_rows(substring_dedup(docs), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute.substring_dedup(rows, 50)
    assert sum(r[2] for r in got) > 0


def test_empty_tables(spark):
    empty = frame(spark, [(1, "x")]).where(F.lit(False))
    assert suffix_dedup(empty).count() == 0
    assert substring_dedup(empty).count() == 0


def test_many_equal_rows_and_a_common_line(spark):
    """Rows that repeat id and text have their marks once; a line in most texts deals nothing into one block."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    line = " ".join(word() for _ in range(14))
    long = " ".join(word() for _ in range(900))
    rows = [(9, long)] * 300 + [(10, long)] + [(i, f"{' '.join(word() for _ in range(25))} {line} {' '.join(word() for _ in range(25))}") for i in range(20, 220)]
    docs = frame(spark, rows).repartition(6)

    def whole_flags(batches):
        for batch in batches:
            yield pa.record_batch([batch.column("anchor"), batch.column("chunk"), pa.array([b""] * batch.num_rows, pa.binary())], names=["anchor", "chunk", "flags"])

    _, marks = find_repeats(docs, 200, 32, False, False, whole_flags, "anchor long, chunk long, flags binary")
    per_text = {r["n"] for r in marks.select(F.size("marks").alias("n")).collect()}
    assert max(per_text) < 200  # chunks of one text, not of three hundred
    got = as_rows(suffix_dedup(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.suffix_dedup(rows, 200)
    got = as_rows(substring_dedup(docs, window=12, gram=3), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute.substring_dedup(rows, 12)
    levels = gram_levels(keyed(docs), 8, True)
    chunks = cut_chunks(keyed(docs), 20, 8, True, levels).where("doc_id >= 20").groupBy("anchor").count()
    assert chunks.agg(F.max("count")).first()[0] < 20  # no anchor lies in the common line


def test_passages_with_odd_columns(spark):
    rows = [(1, "x y z " * 30, 5), (2, "x y z " * 30, 6), (3, None, 7), (None, "x y z " * 30, None)]
    docs = spark.createDataFrame([(t, d, n, 0) for d, t, n in rows], "text string, doc_id int, rest int, _id int")
    got = keep_first_passages(docs)
    assert got.columns == docs.columns and got.schema["doc_id"] == docs.schema["doc_id"]
    assert sorted(((r["doc_id"], len(r["text"]), r["rest"]) for r in got.collect()), key=str) == sorted([(1, 180, 5), (2, 0, 6), (3, 0, 7), (None, 0, None)], key=str)
