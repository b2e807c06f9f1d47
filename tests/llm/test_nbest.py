import hashlib
import random
import time

import brute
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from stratum.llm.nbest import PieceModel, decode, encode, round_trip

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_is_the_definition():
    model = PieceModel(PATH, 5)
    scores = {p: s for p, (s, _) in model.scores.items()}
    rng = random.Random(4)
    for _ in range(40):
        text = "".join(rng.choices(["a", "the", " ", "in", "é", "\n", "日", "t", " re"], k=rng.randint(1, 5)))[:10]
        want = sorted((-s for s, _ in brute.segmentations(model.normalize(text), scores, model.penalty)))[:5]
        got = model.encode(text)
        assert [-s for s, _ in got] == pytest.approx(want)
        assert len({tuple(ids.tolist()) for _, ids in got}) == len(got)
        for _, ids in got:
            assert model.decode(ids).decode() == text


def test_long_units_are_scored_as_short_ones():
    model = PieceModel(PATH, 5)
    rng = random.Random(7)
    for _ in range(60):
        text = model.normalize("".join(rng.choices("abtheréz日", k=rng.randint(1, 60))))
        score, cost, _, _ = model.first_two([text, "x"])
        g = model.lattice([text])
        best, behind, taken = (brute.np.full(len(text) + 1, x) for x in (float("-inf"), float("-inf"), -1))
        best[0] = behind[-1] = 0.0
        model._walk(g, best, taken, behind)
        assert best[-1] == score[0] == behind[0]
        two = model.search([text], 2)[0]
        assert two[0][0] == score[0] and (len(two) == 1 or two[0][0] - two[1][0] == cost[0])


def test_equal_characters_take_time_in_proportion():
    model = PieceModel(PATH, 4)
    for text in ("z" * 20_000, "a" * 20_000):
        began = time.time()
        got = model.encode(text)
        assert time.time() - began < 5
        assert len({tuple(ids.tolist()) for _, ids in got}) == 4 and [s for s, _ in got] == sorted((s for s, _ in got), reverse=True)
        assert all(model.decode(ids).decode() == text for _, ids in got)


def test_many_ties_are_the_definition():
    model = PieceModel(PATH, 6)
    scores = {p: s for p, (s, _) in model.scores.items()}
    for text in ("z" * 11, "a" * 11, "é" * 9, "ab" * 5, "日日日日"):
        want = sorted((-s for s, _ in brute.segmentations(model.normalize(text), scores, model.penalty)))[:6]
        assert [-s for s, _ in model.encode(text)] == pytest.approx(want)


def test_documents(spark):
    rows = [(1, "The cat sat."), (1, "The cat sat."), (None, "x"), (3, None), (4, ""), (5, " a  b\t\n" + "z" * 3000)]
    docs = spark.createDataFrame([(d, t, 9, b"") for d, t in rows], "doc_id long, text string, rank int, ids binary")
    got = decode(encode(docs, PATH, 3), PATH)
    best = {(r["doc_id"], bytes(r["decoded"]).decode()) for r in got.collect()}
    assert best == {(d, t or "") for d, t in rows}
    ranks = {r["doc_id"]: r["n"] for r in got.groupBy("doc_id").agg(F.max("rank").alias("n")).collect()}
    assert ranks[1] == 3 and ranks[4] == ranks[3] == 1
    want = [(r["doc_id"], r["rank"], r["score"], r["n_pieces"], r["ids_crc32"], hashlib.sha256(bytes(r["decoded"])).hexdigest()) for r in got.collect()]
    assert sorted(map(tuple, round_trip(docs, PATH, 3).collect()), key=str) == sorted(want, key=str)
    assert encode(docs.where(F.lit(False)), PATH).count() == 0


def test_generated_documents_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = decode(encode(docs, PATH), PATH)
    assert got.count() == 800
    assert got.join(docs, "doc_id").where(F.col("decoded") != F.encode("text", "utf-8")).count() == 0
    assert got.groupBy("doc_id").agg(F.countDistinct("ids_crc32").alias("n")).where("n < 4").count() == 0
