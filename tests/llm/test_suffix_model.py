import tracemalloc

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from stratum.llm.suffix_model import Level, Settings, answer_level, ask, score_texts, unsqueeze

COLUMNS = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def compare(got, want):
    assert got.keys() == want.keys()
    for d, w in want.items():
        assert got[d][:4] == w[:4]
        assert got[d][4] == pytest.approx(w[4], rel=1e-9, abs=1e-9)
        assert got[d][5] == pytest.approx(w[5], rel=1e-7, abs=1e-7)


def result(df):
    return {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in df.collect()}


@pytest.mark.parametrize("settings", [{"least": 4, "block": 1 << 16}, {"depth": 3, "least": 2, "slack": 0.5, "block": 1 << 17}, {"depth": 5, "least": 2, "block": 1 << 20}])
def test_is_the_definition(spark, settings):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = brute.suffix_tree_scores(rows, **{k: v for k, v in settings.items() if k != "block"})
    got = result(score_texts(docs, settings=Settings(**settings)))
    compare(got, want)
    held = [d for d, w in want.items() if w[0]]
    assert sum(got[d][5] for d in held) > sum(got[d][4] for d in held)  # the tree beats the base on texts it has not seen


def test_odd_rows(spark):
    rows = [(1, "a b a b a b"), (2, None), (3, ""), (4, "a"), (6, "A b " * 50), (9, " \n "), (10, "long " * 30_000)]
    frame = spark.createDataFrame([(d, t, 0, "x") for d, t in rows], "doc_id long, text string, block int, rid string")
    compare(result(score_texts(frame, settings=Settings(least=1))), brute.suffix_tree_scores(rows, least=1))
    assert score_texts(frame.where(F.lit(False))).count() == 0


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "a b c")] * 3 + [(2, "a b d"), (None, "a b c"), (None, "a b c")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = score_texts(frame, settings=Settings(least=1)).collect()
    assert len(got) == 6 and {(r["held_out"], r["doc_id"] is None) for r in got if r["doc_id"] is None} == {(True, True)}
    trained = sum(1 for r in rows if r[0] is not None and not brute.suffix_tree_scores([r], least=1)[r[0]][0])
    assert {r["train_tokens"] for r in got} == {4 * trained}
    by_text = {}
    for r in got:
        by_text.setdefault((r["doc_id"] == 2), set()).add(round(r["score"], 9))
    assert all(len(v) == 1 for v in by_text.values())


@pytest.mark.parametrize("merge", [1, 300])
def test_pairs_summed_by_ranges(spark, merge):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    compare(result(score_texts(frame, settings=Settings(least=2, block=1 << 15, merge=merge))), brute.suffix_tree_scores(rows, least=2))


def test_memory_of_a_partition():
    """A million pairs of which one context has a third: the sums, and memory for each pair."""
    random, blocks, n = np.random.default_rng(5), 32, 32_000
    contexts = np.sort(random.integers(1, 1 << 63, 2000, dtype=np.uint64))
    tables, asked, counts = [], [], []
    for block in range(blocks):
        which = np.sort(np.where(random.random(n) < 0.3, 700, random.integers(0, len(contexts), n)))
        pair = random.choice(1 << 18, n, replace=False).astype(np.uint64) * np.uint64(0x3FFFFFF1)
        order = np.lexsort((pair, which))
        context, pair = contexts[which], pair[order]
        count = random.integers(0, 4, n)
        tables.append(ask(Level(np.zeros(n, np.int64), context, pair, count, np.full(n, 0.125), np.full(n, 100_000), which, which), block, False))
        asked.append(context * np.uint64(3) ^ pair)
        counts.append(count)
    batches = pa.concat_tables(tables).to_batches()
    tracemalloc.start()
    try:
        out = pa.Table.from_batches(answer_level(1e9, 1.0)(iter(batches)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    _, number = np.unique(np.concatenate(asked), return_inverse=True)
    want = np.bincount(number, np.concatenate(counts))[number]
    got = np.concatenate([unsqueeze(x.as_py(), np.uint32) for x in out.column("seen")[:blocks]])
    assert got.tolist() == want.astype(int).tolist()
    assert peak < 64 * blocks * n
