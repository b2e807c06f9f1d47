"""Every stage of the pipeline against its plain definition, on what the stage before kept."""

import brute
import corpus_pipeline
from stratum.llm import toxicity

FOLDER = "/root/testdata/sf0.001"


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    got = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / str(i)))
        got[name] = (docs, spark.read.parquet(str(tmp_path / str(i))))
        docs = got[name][1]
        if i < 4:
            assert docs.columns == columns

    before, after = got["toxicity"]
    scores = toxicity.score_toxicity(before, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    assert sorted(d for d, _ in pairs(after)) == sorted(r["doc_id"] for r in scores.where("predicted = 0").collect())

    before, after = got["exact dedup"]
    keep = {}
    for d, t in pairs(before):
        keep[t] = max(d, keep.get(t, d))
    assert sorted(pairs(after)) == sorted((d, t) for t, d in keep.items())

    before, after = got["n-gram Jaccard join"]
    want = brute.jaccard_components(pairs(before))
    assert sorted(d for d, _ in pairs(after)) == sorted(d for d, (_, c) in want.items() if c == d)

    before, after = got["substring dedup"]
    rows = {r[0]: r for r in brute.substring_dedup(pairs(before), 50)}
    original = dict(pairs(before))
    new = {r["doc_id"]: r for r in after.collect()}
    assert new.keys() == original.keys()
    for d, (_, _, removed, sha) in rows.items():
        text = new[d]["text"]
        if removed:
            assert brute.hashlib.sha256(text.encode()).hexdigest() == sha and new[d]["n_chars"] == len(text)
        else:
            assert text == original[d]

    before, after = got["best-fit packing"]
    assert {r["doc_id"] for r in after.select("doc_id").collect()} == set(new)


def test_run(spark):
    rows = corpus_pipeline.run(spark, FOLDER)
    assert rows.count() > 100 and "sequence_id" in rows.columns


def test_odd_rows_go_through_every_stage(spark):
    """Nulls in every column, repeated rows, a very long text, clashing extra columns, no n_chars."""
    long = " ".join(f"w{i % 7919}x{i % 31}" for i in range(60_000))
    text = "a plain text of some words that stands here more than once " * 3
    rows = [(1, text), (2, text), (2, text), (None, text), (None, None), (5, None), (6, ""), (7, long), (8, long + " end"), (9, " \n "), (None, "x")]
    schema = "doc_id long, text string, _id int, near_copy int, row string, rid long, rest int, digest string, marks int, part int"
    docs = spark.createDataFrame([(d, t, *[None] * 8) for d, t in rows], schema)
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, FOLDER)
        assert kept.columns == docs.columns, name
        kept = spark.createDataFrame(kept.collect(), schema)
    ids = sorted(str(r["doc_id"]) for r in kept.select("doc_id").collect())
    # of equal texts the largest id; of near copies the least; rows without an id stay
    assert ids == sorted(["2", "6", "7", "9", "None"])
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, FOLDER)
    assert packed.where("piece = 0").count() == len(ids)


def test_empty_tables_go_through(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0
