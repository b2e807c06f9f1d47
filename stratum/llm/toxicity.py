"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the mean of the vectors of its byte n-grams (word ends included), a
passage of `passage` words the mean of its words (repetitions count as empty), and a linear softmax on that
mean gives two classes.  Vectors and softmax are trained jointly in numpy.  A
text counts as its worst passage: labels are of whole texts, so in training the
passage that scores highest stands for its text, after a first epoch over
passages taken at random.  An unseen misspelling shares n-grams with the words
it comes from, and so their vectors.

Once trained, vectors and softmax fold into one number per n-gram bucket; that
table has a fixed size and goes to every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learning import held_out, labelled_sample, sigmoid
from .shared import ship, tidy
from .textblock import Words, column_bytes, slices


@dataclass(frozen=True)
class Settings:
    bits: int = 18  # n-gram buckets: 2 ** bits
    dim: int = 8
    sizes: tuple[int, ...] = (3, 4, 5)
    passage: int = 8  # words
    per_class: int = 1500  # labelled texts of each class at most
    epochs: int = 16
    batch: int = 64
    rate: float = 0.1
    seed: int = 7


@dataclass
class Bags:
    """n-grams of words, words of passages, passages of texts."""

    grams: np.ndarray  # bucket of each n-gram
    word_at: np.ndarray  # first n-gram of each word, and the end
    passage_at: np.ndarray  # first word of each passage, and the end
    text_at: np.ndarray  # first passage of each text, and the end
    word_share: np.ndarray  # what a word counts for in its passage


def make_bags(buf: np.ndarray, offsets: np.ndarray, s: Settings) -> Bags:
    # one space before each text and one behind the last, so that every word has both its ends
    n = len(offsets) - 1
    padded = np.full(len(buf) + n + 1, 0x20, dtype=np.uint8)
    moved = offsets + np.arange(n + 1)
    padded[np.arange(len(buf)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))] = buf
    words = Words(padded, moved, lower=True)
    b = np.where(words.mask, words.buf, 0x20).astype(np.uint32)
    lens = words.end - words.start + 2
    at = np.cumsum(lens) - lens
    place = np.arange(int(lens.sum())) - np.repeat(at, lens)
    left = np.repeat(lens, lens) - place  # bytes from here to the word's end, the space behind it included
    where = np.repeat(words.start - 1, lens) + place
    per_word = np.zeros(words.n, dtype=np.int64)
    owner = np.repeat(np.arange(words.n), lens)
    grams, owners = [], []
    with np.errstate(over="ignore"):
        h = np.full(len(b), 0x9747B28C, dtype=np.uint32)
        for size in range(1, max(s.sizes) + 1):
            h = h[: len(b) - size + 1] * np.uint32(0x01000193)
            h = h ^ (b[size - 1 :] * np.uint32(0x85EBCA6B))
            h = h ^ (h >> np.uint32(15))
            if size in s.sizes:
                ok = left >= size
                own = owner[ok]
                grams.append(((h[where[ok]] * np.uint32(0xC2B2AE35)) >> np.uint32(32 - s.bits)).astype(np.int32))
                owners.append(own)
                per_word += np.bincount(own, minlength=words.n)
        short = np.flatnonzero(per_word == 0)  # nothing fits: cannot be, a word has 3 bytes with its ends
    assert not len(short)
    word_at = np.zeros(words.n + 1, dtype=np.int64)
    np.cumsum(per_word, out=word_at[1:])
    flat = np.empty(int(word_at[-1]), dtype=np.int32)
    used = np.zeros(words.n, dtype=np.int64)
    for g, own in zip(grams, owners, strict=True):
        count = np.bincount(own, minlength=words.n)
        begin = np.cumsum(count) - count
        flat[word_at[own] + used[own] + np.arange(len(own)) - begin[own]] = g
        used += count
    passages = -(-words.count // s.passage)
    text_at = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(passages, out=text_at[1:])
    nth = np.arange(int(text_at[-1])) - np.repeat(text_at[:-1], passages)
    passage_at = np.append(np.repeat(words.first[:-1], passages) + nth * s.passage, words.n)
    # a passage is the sum of its different words over its full length: neither repetition nor a short end makes a word louder
    h = words.hashes()
    owner = np.repeat(np.arange(len(passage_at) - 1), np.diff(passage_at))
    again = np.zeros(words.n, dtype=bool)
    for d in range(1, min(s.passage, words.n)):
        again[d:] |= (h[d:] == h[:-d]) & (owner[d:] == owner[:-d])
    return Bags(flat, word_at, passage_at, text_at, np.where(again, 0, 1 / s.passage).astype(np.float32))


def join_bags(parts: Iterator[Bags], most: int) -> Bags:
    """Bags of texts that follow each other, of at most `most` n-grams; one part is held at a time."""
    grams = np.empty(most, dtype=np.int32)  # pages that aren't written take no memory
    ends = {"word_at": 0, "passage_at": 0, "text_at": 0}
    rest: dict[str, list[np.ndarray]] = {name: [np.zeros(1, dtype=np.int64)] for name in ends}
    shares = []
    used = 0
    for part in parts:
        grams[used : used + len(part.grams)] = part.grams
        used += len(part.grams)
        for name in ends:
            rest[name].append(getattr(part, name)[1:] + ends[name])
            ends[name] += int(getattr(part, name)[-1])
        shares.append(part.word_share)
    return Bags(grams[:used], *(np.concatenate(rest[name]) for name in ends), np.concatenate(shares))


def passage_scores(bags: Bags, weight: np.ndarray, bias: float, words: int = 1 << 17) -> np.ndarray:
    """Difference of the two logits for every passage, from the folded table; a block of words at a time."""
    if not len(bags.grams):
        return np.zeros(0)
    word = np.empty(len(bags.word_at) - 1)
    for at in range(0, len(word), words):
        ends = bags.word_at[at : at + words + 1]
        word[at : at + words] = np.add.reduceat(weight[bags.grams[ends[0] : ends[-1]]], ends[:-1] - ends[0]) / np.diff(ends)
    return np.add.reduceat(word * bags.word_share, bags.passage_at[:-1]) + bias


def text_scores(bags: Bags, weight: np.ndarray, bias: float) -> np.ndarray:
    """Score of each text's worst passage; a text without words has the bias alone."""
    out = np.full(len(bags.text_at) - 1, bias)
    full = np.diff(bags.text_at) > 0
    if full.any():
        out[full] = np.maximum.reduceat(passage_scores(bags, weight, bias), bags.text_at[:-1][full])
    return sigmoid(out)


def train(texts: pa.Array, y: np.ndarray, s: Settings) -> tuple[np.ndarray, float]:
    """Folded table and bias; without both classes nothing is learnt and every score is near 0."""
    if len(np.unique(y)) < 2:
        return np.zeros(1 << s.bits, dtype=np.float32), -40.0
    rng = np.random.default_rng(s.seed)
    parts = slices(iter([pa.record_batch([texts], names=["text"])]), limit=1 << 18)
    # a text of b bytes has (b + 1) / 2 words at most, each with its two ends
    most = 2 * len(s.sizes) * (texts.nbytes + 2 * len(texts))
    bags = join_bags((make_bags(*column_bytes(part.column("text")), s) for part in parts), most)
    table = rng.normal(0, 0.002, (1 << s.bits, s.dim)).astype(np.float32)  # what isn't learnt stays near 0
    soft = rng.normal(0, 0.5, (s.dim, 2)).astype(np.float32)
    bias = np.zeros(2, dtype=np.float32)
    g_table, g_soft, g_bias = np.full(len(table), 1e-6, np.float32), np.full_like(soft, 1e-6), np.full_like(bias, 1e-6)
    full = np.flatnonzero(np.diff(bags.text_at) > 0)
    for epoch in range(s.epochs):
        score = passage_scores(bags, table @ (soft[:, 1] - soft[:, 0]), float(bias[1] - bias[0])) if epoch else rng.random(len(bags.passage_at) - 1)
        top = np.maximum.reduceat(score, bags.text_at[:-1][full])
        owner = np.repeat(np.arange(len(full)), np.diff(bags.text_at)[full])
        best = np.full(len(full), -1)
        hit = np.flatnonzero(score == top[owner])
        best[owner[hit]] = hit
        # of clean texts also the passages that look worst of all, and as many at random
        clean = np.flatnonzero(y[full][owner] == 0)
        many = min(len(clean), int((y[full] == 0).sum()))
        worst = clean[np.argpartition(-score[clean], many - 1)[:many]]
        pick = np.concatenate([best, worst, rng.choice(clean, many)])
        label = np.concatenate([y[full], np.zeros(2 * many, dtype=np.int64)])
        order = rng.permutation(len(pick))
        rate = s.rate * (1 - epoch / s.epochs)
        for at in range(0, len(order), s.batch):
            own = order[at : at + s.batch]
            p, t = pick[own], label[own]
            w0, w1 = bags.passage_at[p], bags.passage_at[p + 1]
            g0, g1 = bags.word_at[w0], bags.word_at[w1]
            sizes = g1 - g0
            ids = np.repeat(g0 - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
            word = np.searchsorted(bags.word_at, ids, side="right") - 1
            share = bags.word_share[word] / (bags.word_at[word + 1] - bags.word_at[word])
            gram = bags.grams[ids]
            mean = np.add.reduceat(table[gram] * share[:, None], np.cumsum(sizes) - sizes, axis=0)
            logits = mean @ soft + bias
            prob = np.exp(logits - logits.max(axis=1, keepdims=True))
            prob /= prob.sum(axis=1, keepdims=True)
            prob[np.arange(len(t)), t] -= 1
            d_mean = prob @ soft.T
            d_soft, d_bias = mean.T @ prob / len(t), prob.mean(axis=0)
            rows, inverse = np.unique(gram, return_inverse=True)
            d_rows = np.stack([np.bincount(inverse, share * np.repeat(d_mean[:, k], sizes), len(rows)) for k in range(s.dim)], axis=1)
            g_table[rows] += (d_rows**2).mean(axis=1)
            table[rows] -= (rate * d_rows / np.sqrt(g_table[rows])[:, None]).astype(np.float32)
            g_soft += d_soft**2
            soft -= (rate * d_soft / np.sqrt(g_soft)).astype(np.float32)
            g_bias += d_bias**2
            bias -= (rate * d_bias / np.sqrt(g_bias)).astype(np.float32)
    return (table @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, modulus: int, remainder: int, settings: Settings) -> tuple[np.ndarray, float]:
    sample = labelled_sample(docs, labels, "toxic", modulus, remainder, settings.per_class)
    tidy(docs.sparkSession)  # training takes memory of its own
    learnt = train(*sample, settings)
    tidy(docs.sparkSession)
    return learnt


def clean_documents(
    docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2, threshold: float = 0.3, settings: Settings = Settings()
) -> DataFrame:
    """The rows of docs, with all their columns, that score_toxicity predicts 0 for; no shuffle."""
    ship(docs.sparkSession)
    weight, bias = fit(docs, labels, modulus, remainder, settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1 << 19):
            score = text_scores(make_bags(*column_bytes(batch.column("text")), settings), weight, bias)
            yield batch.filter(pa.array(score < threshold))

    return docs.mapInArrow(run, docs.schema)


def score_toxicity(
    docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2, threshold: float = 0.3, settings: Settings = Settings()
) -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    Learns from `labels` (doc_id, toxic) outside of the held-out rows, from a
    sample bounded by settings.per_class; the text is the only input of a
    score.  Null and empty texts are scored as texts without words.  A null
    doc_id stays null and is held out; repeated rows are scored alike; an empty
    table gives no rows; other columns are not read.
    """
    ship(docs.sparkSession)
    weight, bias = fit(docs, labels, modulus, remainder, settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1 << 19):
            score = text_scores(make_bags(*column_bytes(batch.column("text")), settings), weight, bias)
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", modulus, remainder).alias("held_out"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int"
    )
