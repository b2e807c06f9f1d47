"""Quality: a factorisation machine over hashed words, structure statistics and metadata.

score(x) = b + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]

The bracket is the sum-of-squares identity: all pairwise interactions in time
linear in the features that are there.  Metadata is the text's own size; labels,
language, source and id are no inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learning import held_out, labelled_sample, sigmoid
from .shared import ship
from .textblock import U64, Words, column_bytes, mix64, slices


@dataclass(frozen=True)
class Settings:
    bits: int = 15  # word buckets: 2 ** bits
    factors: int = 4
    per_class: int = 2000  # labelled texts of each class at most
    epochs: int = 12
    batch: int = 64
    rate: float = 0.1
    decay: float = 1e-4
    seed: int = 11


#: Structure and metadata features of a text; each becomes a feature with an index of its own after the words.
STATISTICS = (
    "constant", "capitals", "digits", "symbols", "marks", "bars", "line ends", "beyond ascii",
    "mean word length", "long words", "distinct words", "repeated lines", "log words", "log bytes", "words to a line", "empty",
)


@dataclass
class Features:
    index: np.ndarray
    value: np.ndarray
    at: np.ndarray  # first feature of each text, and the end


def _per_text(flag: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flag) + 1, dtype=np.int64)
    np.cumsum(flag, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def make_features(buf: np.ndarray, offsets: np.ndarray, s: Settings) -> Features:
    n = len(offsets) - 1
    words = Words(buf, offsets)
    low = Words(buf, offsets, lower=True)
    bucket = (low.hashes() >> U64(64 - s.bits)).astype(np.int64)
    doc = words.doc
    key, count = np.unique(doc << s.bits | bucket, return_counts=True)
    count_words = np.maximum(words.count, 1)
    nbytes = np.maximum(np.diff(offsets), 1)
    stats = np.zeros((n, len(STATISTICS)))
    stats[:, 0] = 1
    stats[:, 1] = _per_text((buf >= 65) & (buf <= 90), offsets) / nbytes
    stats[:, 2] = _per_text((buf >= 48) & (buf <= 57), offsets) / nbytes
    symbol = np.zeros(256, dtype=bool)
    symbol[list(b"#$%&*+/<=>@[\\]^_`{}~")] = True
    stats[:, 3] = _per_text(symbol[buf], offsets) / nbytes * 4
    mark = np.zeros(256, dtype=bool)
    mark[list(b"!?.,;:")] = True
    stats[:, 4] = _per_text(mark[buf], offsets) / nbytes * 4
    stats[:, 5] = _per_text(buf == 0x7C, offsets) / nbytes * 8
    lines = _per_text(buf == 0x0A, offsets) + 1
    stats[:, 6] = lines / nbytes * 8
    stats[:, 7] = _per_text(buf >= 0xC0, offsets) / nbytes * 2
    length = words.end - words.start
    stats[:, 8] = np.bincount(doc, length, n) / count_words / 10
    stats[:, 9] = np.bincount(doc, length > 15, n) / count_words
    stats[:, 10] = np.bincount(key >> s.bits, minlength=n) / count_words
    stats[:, 11] = _repeated_lines(low, n)
    stats[:, 12] = np.log1p(words.count) / 8
    stats[:, 13] = np.log1p(np.diff(offsets)) / 10
    stats[:, 14] = np.log1p(words.count / lines) / 5
    stats[:, 15] = words.count == 0
    owner = np.concatenate([key >> s.bits, np.repeat(np.arange(n), len(STATISTICS))])
    index = np.concatenate([key & ((1 << s.bits) - 1), np.tile((1 << s.bits) + np.arange(len(STATISTICS)), n)])
    norm = np.sqrt(np.bincount(key >> s.bits, count.astype(float) ** 2, n))
    value = np.concatenate([count / norm[key >> s.bits], stats.ravel()])
    order = np.argsort(owner, kind="stable")
    at = np.searchsorted(owner[order], np.arange(n + 1))
    return Features(index[order].astype(np.int32), value[order].astype(np.float32), at)


def join_features(parts: list[Features]) -> Features:
    """Features of texts that follow each other."""
    ends = np.cumsum([0, *(p.at[-1] for p in parts)])
    at = np.concatenate([[0], *(p.at[1:] + e for p, e in zip(parts, ends, strict=False))]).astype(np.int64)
    return Features(np.concatenate([p.index for p in parts]), np.concatenate([p.value for p in parts]), at)


def _repeated_lines(words: Words, n: int) -> np.ndarray:
    """Share of a text's lines that stood there before; a line is its words."""
    if not words.n:
        return np.zeros(n)
    ends = np.zeros(len(words.buf) + 1, dtype=np.int64)
    np.cumsum(words.buf == 0x0A, out=ends[1:])
    line = ends[words.start]
    doc = words.doc
    first = np.flatnonzero(np.append(True, (np.diff(line) > 0) | (np.diff(doc) > 0)))
    with np.errstate(over="ignore"):
        place = np.arange(words.n) - np.repeat(first, np.diff(np.append(first, words.n)))
        h = np.add.reduceat(mix64(words.hashes() + place.astype(U64) * U64(0x9E3779B97F4A7C15)), first)
    owner = doc[first]
    order = np.lexsort((h, owner))
    again = np.append(False, (h[order][1:] == h[order][:-1]) & (owner[order][1:] == owner[order][:-1]))
    return np.bincount(owner[order], again, n) / np.maximum(np.bincount(owner, minlength=n), 1)


def machine(f: Features, w: np.ndarray, v: np.ndarray, b: float) -> np.ndarray:
    """Raw output for every text; every text has features (its statistics)."""
    if len(f.at) < 2:
        return np.zeros(0)
    at = f.at[:-1]
    vx = v[f.index] * f.value[:, None]
    total, squares = np.add.reduceat(vx, at, axis=0), np.add.reduceat(vx**2, at, axis=0)
    return b + np.add.reduceat(w[f.index] * f.value, at) + 0.5 * (total**2 - squares).sum(axis=1)


def train(texts: pa.Array, y: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic loss, Adagrad.  Without both classes every score is that of the class there is."""
    size = (1 << s.bits) + len(STATISTICS)
    rng = np.random.default_rng(s.seed)
    w, v, b = np.zeros(size), rng.normal(0, 0.05, (size, s.factors)), 0.0
    if len(np.unique(y)) < 2:
        return w, np.zeros_like(v), 40.0 if len(y) and y[0] else -40.0
    parts = slices(iter([pa.record_batch([texts], names=["text"])]), limit=1 << 18)
    f = join_features([make_features(*column_bytes(part.column("text")), s) for part in parts])
    gw, gv, gb = np.full(size, 1e-6), np.full_like(v, 1e-6), 1e-6
    for epoch in range(s.epochs):
        rate = s.rate * (1 - epoch / s.epochs)
        order = rng.permutation(len(y))
        for start in range(0, len(order), s.batch):
            own = order[start : start + s.batch]
            sizes = f.at[own + 1] - f.at[own]
            at = np.cumsum(sizes) - sizes
            ids = np.repeat(f.at[own] - at, sizes) + np.arange(int(sizes.sum()))
            part = Features(f.index[ids], f.value[ids], np.append(at, int(sizes.sum())))
            d = np.repeat((sigmoid(machine(part, w, v, b)) - y[own]) / len(own), sizes)
            vx = v[part.index] * part.value[:, None]
            total = np.repeat(np.add.reduceat(vx, at, axis=0), sizes, axis=0)
            rows, inverse = np.unique(part.index, return_inverse=True)
            dw = np.bincount(inverse, d * part.value) + s.decay * w[rows]
            slope = (d * part.value)[:, None] * (total - vx)
            dv = np.stack([np.bincount(inverse, slope[:, k]) for k in range(s.factors)], axis=1) + s.decay * v[rows]
            gw[rows] += dw**2
            gv[rows] += dv**2
            w[rows] -= rate * dw / np.sqrt(gw[rows])
            v[rows] -= rate * dv / np.sqrt(gv[rows])
            db = float(d[at].sum())
            gb += db * db
            b -= rate * db / gb**0.5
    return w, v, b


def score_quality(
    docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0, threshold: float = 0.3, settings: Settings = Settings()
) -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    Learns from `labels` (doc_id, quality) outside of the held-out rows, from a
    sample bounded by settings.per_class.  Null and empty texts have only
    statistics.  A null doc_id stays null and is held out; repeated rows are
    scored alike; an empty table gives no rows; other columns are not read.
    """
    ship(docs.sparkSession)
    texts, y = labelled_sample(docs, labels, "quality", modulus, remainder, settings.per_class)
    w, v, b = train(texts, y, settings)
    w, v = w.astype(np.float32), v.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1 << 20):
            score = sigmoid(machine(make_features(*column_bytes(batch.column("text")), settings), w, v, b)).astype(np.float64)
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", modulus, remainder).alias("held_out"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int"
    )
