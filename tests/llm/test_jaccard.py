import random

import brute
from pyspark.sql import functions as F
from stratum.llm.components import components
from stratum.llm.jaccard import jaccard_components, keep_representatives, list_pairs

SCHEMA = "doc_id long, text string, unit long, gid long, n string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, 1, None) for d, t in rows], SCHEMA)


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def corpus(seed):
    """Near copies with edits, chains, a passage that most texts share, short and empty texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefg", k=rng.randint(1, 6)))
    passage = [word() for _ in range(40)]
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rng.randint(30, 120))]
        for _ in range(rng.choice([1, 3, 25])):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = word()
            if rng.random() < 0.3:
                base = own
            if rng.random() < 0.2:
                own = own + passage
            rows.append(" ".join(own))
    rows += [" ".join(passage + [word() for _ in range(k)]) for k in range(1, 15)]
    rows += ["", None, "  \n", "one", "ONE", "a b c d", "A  b c\td", "a b c d e", "a b c d e f", "x " * 500, "x " * 9]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_is_the_definition(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        assert result(jaccard_components(frame(spark, rows), small=4)) == brute.jaccard_components(rows)


def test_streamed_lists_give_every_member(spark):
    rows = [(t, g, 100, 0) for t, k in ((1, 3), (5, 40), (6, 9), (7, 8), (9, 100)) for g in range(k)]
    rows += [(5, 7, 100, 0), (9, 0, 100, 0), (9, 99, 100, 0)]  # groups that two tasks gave
    lists = spark.createDataFrame(rows, "token long, gid long, n int, place int").coalesce(1).sortWithinPartitions("token", "n", "gid")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size, block in ((5, 10), (16, 10), (1000, 10), (1000, 1 << 16)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = list_pairs(lists, 80, 4, block).where("token is not null").select("token", "gid").collect()
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        assert sorted(map(tuple, got)) == sorted({(t, g) for t, g, _, _ in rows if t != 1})


def test_streamed_lists_lose_no_links(spark):
    # short blocks, and turns in which units meet drawn partners, as often as they take pairs away
    for seed, spare in ((1, 0), (2, 4)):
        rows = corpus(seed)
        assert result(jaccard_components(frame(spark, rows), small=2, block=2, spare=spare)) == brute.jaccard_components(rows)


def test_many_components_in_one_list(spark):
    """A passage that all texts begin with and tails that pair some of them: long lists of many components."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefg", k=rng.randint(2, 6)))
    passage = [word() for _ in range(30)]
    rows = []
    for _ in range(25):
        tail = [word() for _ in range(20)]
        for _ in range(rng.choice([1, 2, 4])):
            own = list(tail)
            own[rng.randrange(len(own))] = word()
            rows.append(" ".join(passage + own))
    rows = list(enumerate(rows))
    assert result(jaccard_components(frame(spark, rows), small=3, spare=0)) == brute.jaccard_components(rows)


def test_generated_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = result(jaccard_components(docs))
    assert got == brute.jaccard_components(rows)
    assert len({c for _, c in got.values()}) < len(got) - 20


def test_odd_rows(spark):
    rows = [(3, "a b c d e f g"), (3, "a b c d e f g"), (None, "a b c d e f g"), (None, "z"), (9, None), (None, None)]
    got = sorted((tuple(r) for r in jaccard_components(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(3, 3, 3), (3, 3, 3), (None, 3, 3), (None, 1, None), (9, 0, 9), (None, 0, None)], key=str)
    assert jaccard_components(frame(spark, rows).where(F.lit(False))).count() == 0


def test_a_clean_text_under_a_repeated_id_stays(spark):
    rows = [(1, "a b c d e f g"), (2, "A b c d e f g"), (2, "quite another text with words of its own"), (None, "a b c d e f g")]
    kept = keep_representatives(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "unit", "gid", "n"]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([rows[0], rows[2], rows[3]], key=str)


def test_components_of_a_chain(spark):
    links = spark.range(1, 60).selectExpr("id as a", "id + 1 as b").unionByName(spark.createDataFrame([(100, 90)], "a long, b long"))
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 90: 90, 100: 90}
