"""Exact dedup, packing, neighbours and the classifiers on small inputs."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from stratum.llm import exact_dedup, neighbours, packing, quality, toxicity
from tokenizers import Tokenizer

BPE = public_tokenizers.path("byte_bpe_50k.json")
FAST = {"ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def texts(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, digest string, group_size int")


def test_exact_dedup(spark):
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (None, "b"), (None, "c"), (7, "z" * 100_000), (8, "z" * 100_000), (9, "A")]
    got = {(r["doc_id"], r["text_sha256"]): (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(texts(spark, rows)).collect()}
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    for d, t in rows:
        ids = groups[t or ""]
        keep = max((i for i in ids if i is not None), default=None)
        assert got[d, hashlib.sha256((t or "").encode()).hexdigest()] == (keep, len(ids), d == keep)
    kept = exact_dedup.keep_one(texts(spark, rows))
    assert kept.columns == ["doc_id", "text", "digest", "group_size"]
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [2, 4, 5, None, 8, 9]))
    assert exact_dedup.exact_dedup(texts(spark, rows).where("false")).count() == 0


def test_one_of_repeated_rows_stays(spark):
    rows = [(1, "a"), (2, "a"), (2, "a"), (2, "b"), (3, "c"), (3, "c"), (3, "c"), (None, "d"), (None, "d"), (5, None), (5, "")]
    docs = texts(spark, rows)
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    want = [(2, "a"), (2, "b"), (3, "c"), (None, "d"), (5, "")]
    assert sorted(((r["doc_id"], r["text"] or "") for r in kept.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("few", [100_000, 0])
def test_texts_of_one_digest_are_told_apart(spark, monkeypatch, few):
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, "a"), (4, "a"), (5, "c"), (6, "b")]
    docs = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in rows], "doc_id long, text string, row int, digest int, _id int")
    hits = exact_dedup._digested(docs.select(F.col("text").alias("t"))).groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    assert exact_dedup.clashes(docs, hits, few=few).count() == 0
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.lit("00"))  # every digest is the same one
    assert exact_dedup.clashes(docs, hits.withColumn("digest", F.unhex(F.lit("00"))), few=few).count() == 1
    got = sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(docs).collect())
    assert got == [(1, 4, 4, False), (2, 6, 2, False), (3, 4, 4, False), (4, 4, 4, True), (4, 4, 4, True), (5, 5, 1, True), (6, 6, 2, True)]
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(4, "a"), (5, "c"), (6, "b")]


def test_stream_over_several_batches(spark, tmp_path):
    for i, rows in enumerate([[(1, "a"), (2, "b")], [(5, "a")], [(3, "a"), (9, "c")]]):
        exact_dedup.digest_records(texts(spark, rows)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("doc_id long, digest binary, source_file string").parquet(str(tmp_path / "in"))
        exact_dedup.fold_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(r["keep_id"], r["group_size"]) for r in exact_dedup.latest_state(spark, str(tmp_path / "out")).collect()}
    assert got == {(5, 3), (2, 1), (9, 1)}


def test_packing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", F.lit(0).alias("piece"))
    odd = spark.createDataFrame([(9001, None, 0), (9002, "", 0), (None, "日本 <|endoftext|> x", 0), (9003, "it's  é q", 0)], docs.schema)
    docs = docs.unionByName(odd)
    rows = packing.pack(docs, BPE, **FAST).collect()
    tok = Tokenizer.from_file(BPE)
    want = {}
    for r in docs.collect():
        ids = np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2], dtype="<u4")
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[r["doc_id"], k] = (a, b - a, zlib.crc32(ids[a:b].tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= 1.01 * sum(r["length"] for r in rows) / 1024 + 1
    assert packing.pack(docs.where("false"), BPE, **FAST).count() == 0


def test_packing_plan_uses_all():
    rng = np.random.default_rng(0)
    for size in (1, 7, 64):
        counts = {int(k): int(rng.integers(0, 30)) for k in range(1, size + 1)}
        plan = packing.plan_packing(counts, size)
        used = defaultdict(int)
        for lengths, n in plan:
            assert sum(lengths) <= size and n > 0
            for x in lengths:
                used[x] += n
        assert {k: v for k, v in counts.items() if v} == dict(used)


def brute_neighbours(ids, x, every, k):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        order = sorted((float(d[j]), int(ids[j])) for j in range(len(ids)) if j != i)
        out[int(ids[i])] = order[:k]
    return out


@pytest.mark.parametrize("folder,least", [("sf0.01", 4), ("sf0.1", 16)])
def test_neighbours_recall(spark, folder, least):
    """The settings of the query on the whole table."""
    vectors = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet")
    pdf = vectors.toPandas()
    ids, x = pdf["vec_id"].to_numpy(), np.array(pdf["embedding"].tolist(), dtype=np.float64)
    want = brute_neighbours(ids, x, 100, 10)
    assert len(want) > least
    got = defaultdict(list)
    for r in neighbours.search(vectors).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    hit = sum(len({v for _, v in got[q]} & {v for _, v in w}) for q, w in want.items())
    assert all(len(got[q]) == 10 for q in want)
    print(folder, "recall", hit / (10 * len(want)))
    assert hit >= 0.9 * 10 * len(want)


def test_neighbours_in_one_part_are_exact(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    pdf = vectors.toPandas()
    want = brute_neighbours(pdf["vec_id"].to_numpy(), np.array(pdf["embedding"].tolist(), dtype=np.float64), 100, 10)
    exact = defaultdict(list)
    for r in neighbours.search(vectors, settings=neighbours.Settings(least_parts=1, block=300)).orderBy("query_id", "rank").collect():
        exact[r["query_id"]].append((r["score"], r["vec_id"]))
    for q, w in want.items():
        assert [v for _, v in exact[q]] == [v for _, v in w]
        assert [d for d, _ in exact[q]] == pytest.approx([d for d, _ in w])


def test_neighbours_repeated_rows(spark):
    """Twelve copies of one row stand for one candidate, and leave room for ten."""
    rng = np.random.default_rng(3)
    rows = [(0, [0.0, 1.0])] * 3 + [(7, [0.1, 1.0])] * 12 + [(i, [0.1, 1.0]) for i in range(20, 26)] + [(i, rng.normal(size=2).tolist()) for i in range(30, 80)]
    rows += [(90, [9.0, 9.0]), (90, [0.0, 1.05]), (200, [3.0, 1.0]), (200, [0.1, 1.01]), (91, [1.0, 2.0, 3.0]), (300, [1.0, 2.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    first = {i: min(v for j, v in rows if j == i and len(v) == 2) for i in (0, 200)}
    for s in (neighbours.Settings(least_parts=1), neighbours.Settings(recall=1.0, block=16)):
        got = defaultdict(list)
        for r in neighbours.search(df, settings=s).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((r["vec_id"], r["score"]))
        assert got.pop(300) == [(91, 1.0)]
        assert {q: len(v) for q, v in got.items()} == {0: 10, 200: 10}
        if s.least_parts == 1:
            for q, found in got.items():
                near = defaultdict(lambda: float("inf"))
                for i, v in rows:
                    if i != q and len(v) == 2:
                        near[i] = min(near[i], float(np.linalg.norm(np.subtract(v, first[q]))))
                assert [i for i, _ in found] == [i for _, i in sorted((d, i) for i, d in near.items())[:10]]


def test_neighbours_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [2.0, 0.0]), (7, [1.0]), (None, [1.0, 1.0])]
    rows += [(i, [5.0, 5.0]) for i in range(10, 60)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, part int")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.search(df, every=100, k=4).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 6), (0, 3, 10), (0, 4, 11)]
    assert neighbours.search(df.where("false")).count() == 0


@pytest.mark.parametrize("module,label,modulus,remainder,call", [(toxicity, "toxic", 4, 2, "score_toxicity"), (quality, "quality", 5, 0, "score_quality")])
def test_classifiers(spark, module, label, modulus, remainder, call):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    settings = module.Settings(per_class=1000)
    got = getattr(module, call)(docs, labels, settings=settings)
    both = got.join(labels, "doc_id").where("held_out").select(label, "predicted").toPandas()
    assert (both[label] == both["predicted"]).mean() > (0.93 if label == "toxic" else 0.99)
    held = {r["doc_id"]: r["held_out"] for r in got.select("doc_id", "held_out").collect()}
    assert all(h == (zlib.crc32(str(d).encode()) % modulus == remainder) for d, h in held.items())


@pytest.mark.parametrize("call", [toxicity.score_toxicity, quality.score_quality])
def test_classifiers_odd_rows(spark, call):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "word", 0), (4, "w " * 20_000, 0), (4, "w " * 20_000, 0)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = call(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
    assert {(r["doc_id"], r["held_out"]) for r in rows if r["doc_id"] is None} == {(None, True)}
    assert call(docs.where("false"), labels).count() == 0
