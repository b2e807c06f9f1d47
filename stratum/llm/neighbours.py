"""Approximate nearest neighbours by learned partitions.

On a bounded sample: build the exact neighbour graph, cut it into balanced
parts (median splits, then label propagation under a capacity), and train a
small network to predict the part of a vector's neighbours.  The same network
then places every row of the table in its most probable part, and sends each
query to as many of its most probable parts as give the wanted recall on the
sample.  There, true distances in double precision rerank all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, ship


@dataclass(frozen=True)
class Settings:
    sample: int = 8192  # vectors that the graph and the network are fitted on, at most
    rows_a_part: int = 4096
    least_parts: int = 8  # so that small tables are learned too; one part for each two vectors of the sample at most
    most_parts: int = 256
    degree: int = 10
    capacity: float = 1.1
    hidden: int = 96
    epochs: int = 30
    rate: float = 0.005
    recall: float = 0.95  # on an eighth of the sample that isn't learnt from; sets the number of parts that a query visits
    block: int = 4096  # rows and queries that meet in one task
    seed: int = 5


@dataclass
class Router:
    mean: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0)
        return h @ self.w2 + self.b2


def neighbour_graph(x: np.ndarray, degree: int) -> np.ndarray:
    """Exact nearest neighbours within the sample, itself excluded."""
    degree = min(degree, len(x) - 1)
    squares = (x**2).sum(axis=1)
    out = np.empty((len(x), degree), dtype=np.int64)
    for at in range(0, len(x), 512):
        d = squares[at : at + 512, None] - 2 * x[at : at + 512] @ x.T + squares
        d[np.arange(len(d)), at + np.arange(len(d))] = np.inf
        out[at : at + 512] = np.argpartition(d, degree - 1, axis=1)[:, :degree]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, capacity: float, rng: np.random.Generator) -> np.ndarray:
    """A part for each node: few cut edges, no part above its capacity."""
    label = np.zeros(len(x), dtype=np.int64)
    todo = [(np.arange(len(x)), 0, parts)]
    while todo:
        rows, base, k = todo.pop()
        if k == 1 or len(rows) < 2:
            label[rows] = base
            continue
        own = x[rows] - x[rows].mean(axis=0)
        axis = rng.normal(size=x.shape[1])
        for _ in range(8):  # power iteration for the main direction
            axis = own.T @ (own @ axis)
            axis /= np.linalg.norm(axis) or 1
        order = rows[np.argsort(own @ axis, kind="stable")]
        half = len(order) * (k // 2) // k
        todo += [(order[:half], base, k // 2), (order[half:], base + k // 2, k - k // 2)]
    most = int(np.ceil(capacity * len(x) / parts))
    sizes = np.bincount(label, minlength=parts)
    for _ in range(10):
        votes = np.zeros((len(x), parts), dtype=np.int32)
        for j in range(graph.shape[1]):
            np.add.at(votes, (np.arange(len(x)), label[graph[:, j]]), 1)
            np.add.at(votes, (graph[:, j], label), 1)
        want = votes.argmax(axis=1)
        gain = votes[np.arange(len(x)), want] - votes[np.arange(len(x)), label]
        moved = 0
        for i in np.argsort(-gain, kind="stable").tolist():
            if gain[i] <= 0:
                break
            if sizes[want[i]] < most:
                sizes[label[i]] -= 1
                sizes[want[i]] += 1
                label[i] = want[i]
                moved += 1
        if moved < len(x) // 500:
            break
    return label


def fit(x: np.ndarray, parts: int, s: Settings) -> Router:
    """The router for a sample of distinct vectors."""
    rng = np.random.default_rng(s.seed)
    x = x.astype(np.float64)
    dim = x.shape[1]
    mean, scale = x.mean(axis=0), float(x.std()) or 1.0
    if parts == 1:
        return Router(mean, scale, np.zeros((dim, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    graph = neighbour_graph(x, s.degree)
    label = balanced_parts((x - mean) / scale, graph, parts, s.capacity, rng)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.arange(len(x)), label), 1.0)
    for j in range(graph.shape[1]):
        np.add.at(target, (np.arange(len(x)), label[graph[:, j]]), 1.0 / graph.shape[1])
    target /= target.sum(axis=1, keepdims=True)
    z = (x - mean) / scale
    p = [rng.normal(0, (2 / dim) ** 0.5, (dim, s.hidden)), np.zeros(s.hidden), rng.normal(0, (1 / s.hidden) ** 0.5, (s.hidden, parts)), np.zeros(parts)]
    m, v, step = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    mixed = rng.permutation(len(x))
    aside, learnt = mixed[: len(x) // 8], mixed[len(x) // 8 :]  # an eighth of the sample only measures
    for epoch in range(s.epochs):
        order = rng.permutation(learnt)
        for at in range(0, len(order), 128):
            own = order[at : at + 128]
            h = np.maximum(z[own] @ p[0] + p[1], 0)
            logits = h @ p[2] + p[3]
            prob = np.exp(logits - logits.max(axis=1, keepdims=True))
            d = (prob / prob.sum(axis=1, keepdims=True) - target[own]) / len(own)
            dh = (d @ p[2].T) * (h > 0)
            step += 1
            for k, g in enumerate((z[own].T @ dh, dh.sum(axis=0), h.T @ d, d.sum(axis=0))):
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                p[k] -= s.rate * (1 - epoch / s.epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    router = Router(mean, scale, *p, 1)
    score = router.scores(x)
    home = score.argmax(axis=1)
    rank = np.empty_like(score, dtype=np.int64)
    np.put_along_axis(rank, np.argsort(-score, axis=1, kind="stable"), np.arange(parts)[None, :], axis=1)
    visits = np.sort(np.take_along_axis(rank[aside], home[graph[aside]], axis=1).ravel())  # how far down each neighbour's part is
    router.probes = int(visits[min(len(visits) - 1, int(np.ceil(s.recall * len(visits))))]) + 1 if len(visits) else parts
    return router


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): no null, no null or non-finite component, not all zero."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    fine = F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    return vectors.where(fine & F.exists(v, lambda c: c != 0) & F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v"))


def as_matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def search(
    vectors: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", settings: Settings = Settings()
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for every row whose id is divisible by `every`.

    Null, zero, and non-finite vectors take no part, nor do rows without an id.
    Vectors of different lengths have no distance: each length is a table of its
    own.  Rows that repeat id and vector count once.  Where an id has several
    vectors its least one (component by component) is the query, and it is a
    candidate with the nearest of them.  Ties go to the smaller id.  Of equal
    vectors only the k + 1 smallest ids of each input batch can be results, so
    only these travel.  With fewer than k candidates all of them are returned;
    an empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = usable(vectors, id_col, vector_col)
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for size in rows.groupBy(F.size("v").alias("dim")).count().orderBy("dim").collect():
        out = out.unionByName(_search(rows.where(F.size("v") == size["dim"]), int(size["dim"]), int(size["count"]), every, k, settings))
    return out


def _search(rows: DataFrame, dim: int, n: int, every: int, k: int, s: Settings) -> DataFrame:
    sample = rows.groupBy("v").agg(F.lit(1).alias("one")).orderBy(F.xxhash64("v"), "v").limit(s.sample).select("v").toArrow()
    parts = max(1, min(s.most_parts, max(s.least_parts, n // s.rows_a_part), sample.num_rows // 2))
    router = fit(as_matrix(sample.column("v").combine_chunks(), dim), parts, s)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = as_matrix(batch.column("v"), dim)
            ids = batch.column("vec_id").to_numpy()
            # equal vectors next to each other, the smallest ids first; repeated rows once
            word = np.ascontiguousarray(x).view(np.uint64) * np.arange(1, 2 * dim, 2, dtype=np.uint64)
            key = np.bitwise_xor.reduce(word ^ (word >> np.uint64(29)), axis=1)
            order = np.lexsort((ids, key))
            alike = np.append(False, (x[order][1:] == x[order][:-1]).all(axis=1))
            again = alike & np.append(False, ids[order][1:] == ids[order][:-1])
            order, alike = order[~again], alike[~again]
            opens = np.flatnonzero(~alike)
            nth = np.arange(len(order)) - np.repeat(opens, np.diff(np.append(opens, len(order))))
            keep = (nth <= k) | (ids[order] % every == 0)
            order, nth = order[keep], nth[keep]
            home = router.scores(x[order]).argmax(axis=1).astype(np.int32)
            yield pa.record_batch(
                [batch.column("vec_id").take(pa.array(order)), batch.column("v").take(pa.array(order)), pa.array(home), pa.array(nth <= k)],
                names=["vec_id", "v", "part", "candidate"],
            )

    index = materialize(rows.mapInArrow(place, "vec_id long, v array<double>, part int, candidate boolean"), "vector-index")
    # one number for each part: of different ids, each in its first part, so that no id counts twice
    first = index.where("candidate").groupBy("vec_id").agg(F.min("part").alias("part"))
    counts = _by_part(first, parts)
    rows_in = _by_part(index.where("candidate"), parts)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = as_matrix(batch.column("v"), dim)
            order = np.argsort(-router.scores(x), axis=1, kind="stable") if parts > 1 else np.zeros((len(x), 1), dtype=np.int64)
            have = np.cumsum(counts[order], axis=1)
            need = np.minimum((have < k + 1).sum(axis=1) + 1, parts)  # far enough to have k candidates besides itself
            visits = np.maximum(need, min(router.probes, parts))
            row = np.repeat(np.arange(len(x)), visits)
            part = order[row, np.arange(len(row)) - np.repeat(np.cumsum(visits) - visits, visits)]
            yield pa.record_batch([batch.column("vec_id").take(pa.array(row)), batch.column("v").take(pa.array(row)), pa.array(part.astype(np.int32))], names=["query_id", "q", "part"])

    asked = index.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = materialize(asked.mapInArrow(route, "query_id long, q array<double>, part int"), "routed-queries")
    asked_of = _by_part(queries, parts)
    # blocks of rows meet blocks of queries; the number of blocks follows the counts
    row_blocks = F.array(*[F.lit(int(max(1, -(-c // s.block)))) for c in rows_in])
    query_blocks = F.array(*[F.lit(int(max(1, -(-c // s.block)))) for c in asked_of])
    left = index.where("candidate").select(
        "part", "vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.get(row_blocks, "part")).cast("int").alias("rb"), F.explode(F.sequence(F.lit(0), F.get(query_blocks, "part") - 1)).alias("qb")
    )
    right = queries.select(
        "part", "query_id", "q", F.pmod(F.xxhash64("query_id"), F.get(query_blocks, "part")).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.get(row_blocks, "part") - 1)).alias("rb")
    )

    def rerank(rows_: pa.Table, asks: pa.Table) -> pa.Table:
        out: list[np.ndarray] = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if rows_.num_rows and asks.num_rows:
            ids = rows_.column("vec_id").to_numpy()
            x = as_matrix(rows_.column("v").combine_chunks(), dim)
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            # a repeated row once; an id's several vectors stay, the nearest of them counts
            new = np.append(True, (ids[1:] != ids[:-1]) | (x[1:] != x[:-1]).any(axis=1))
            ids, x = ids[new], x[new]
            several = bool((ids[1:] == ids[:-1]).any())
            for query, q in zip(asks.column("query_id").to_numpy(), as_matrix(asks.column("q").combine_chunks(), dim), strict=True):
                d = x - q
                d = np.sqrt(np.einsum("ij,ij->i", d, d))
                d[ids == query] = np.inf
                own = ids
                if several:
                    opens = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
                    d, own = np.minimum.reduceat(d, opens), ids[opens]
                m = min(k, len(d) - 1)
                near = np.flatnonzero(d <= np.partition(d, m)[m])
                near = near[np.argsort(d[near], kind="stable")][: k + 1]
                near = near[own[near] != query][:k]
                out[0].append(np.full(len(near), query))
                out[1].append(own[near])
                out[2].append(d[near])
        return pa.table({"query_id": np.concatenate(out[0]), "vec_id": np.concatenate(out[1]), "score": np.concatenate(out[2])})

    found = left.groupBy("part", "rb", "qb").cogroup(right.groupBy("part", "rb", "qb")).applyInArrow(rerank, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _by_part(rows: DataFrame, parts: int) -> np.ndarray:
    """Rows in each part: one number for each reaches the driver."""
    out = np.zeros(parts, dtype=np.int64)
    for row in rows.groupBy("part").count().collect():
        out[row["part"]] = row["count"]
    return out
