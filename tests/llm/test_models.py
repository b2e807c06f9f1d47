"""The classifiers' arithmetic against plain sums, and packing against an exhaustive search and the tokenizer itself."""

import zlib
from functools import cache

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
from stratum.llm import packing, quality, toxicity
from stratum.llm.textblock import column_bytes
from tokenizers import Tokenizer

TEXTS = [
    "", " ", "a", "Hello WORLD hello", "one two three four five six seven eight nine ten one two", "x " * 40, "é日本 mixed\tTabs\n\nand lines\nand lines",
    "!!! ??? ||| 123 $%&", "word" * 200, "A B   c\x0bd", "one\ntwo\none\ntwo\n",
]


def plain_toxicity(text: str, weight: np.ndarray, bias: float, s: toxicity.Settings) -> float:
    def bucket(gram: bytes) -> int:
        h = 0x9747B28C
        for b in gram:
            h = (h * 0x01000193) & 0xFFFFFFFF
            h ^= (b * 0x85EBCA6B) & 0xFFFFFFFF
            h ^= h >> 15
        return ((h * 0xC2B2AE35) & 0xFFFFFFFF) >> (32 - s.bits)

    words = [w.encode() for w in brute.WORD.findall(brute._lower(text))]
    if not words:
        return 1 / (1 + np.exp(-bias))
    best = -np.inf
    for at in range(0, len(words), s.passage):
        total = bias
        for w in dict.fromkeys(words[at : at + s.passage]):
            own = b" " + w + b" "
            grams = [own[i : i + n] for n in s.sizes for i in range(len(own) - n + 1)]
            total += np.mean([weight[bucket(g)] for g in grams]) / s.passage
        best = max(best, total)
    return 1 / (1 + np.exp(-best))


def test_toxicity_is_its_averages():
    s = toxicity.Settings(bits=10)
    rng = np.random.default_rng(1)
    weight, bias = rng.normal(0, 3, 1 << s.bits).astype(np.float32), -0.7
    got = toxicity.text_scores(toxicity.make_bags(*column_bytes(pa.array(TEXTS)), s), weight, bias)
    np.testing.assert_allclose(got, [plain_toxicity(t, weight, bias, s) for t in TEXTS], rtol=1e-5)


def test_machine_is_the_sum_over_pairs():
    s = quality.Settings(bits=6, factors=3)
    rng = np.random.default_rng(2)
    size = (1 << s.bits) + len(quality.STATISTICS)
    w, v, b = rng.normal(size=size), rng.normal(size=(size, s.factors)), 0.3
    f = quality.make_features(*column_bytes(pa.array(TEXTS)), s)
    got = quality.machine(f, w, v, b)
    for i, value in enumerate(got):
        at = range(f.at[i], f.at[i + 1])
        want = b + sum(w[f.index[j]] * f.value[j] for j in at)
        want += sum(v[f.index[j]] @ v[f.index[k]] * f.value[j] * f.value[k] for j in at for k in at if j < k)
        assert abs(value - want) < 1e-6 * max(1, abs(want))


def test_machine_words():
    """Hashed words: one feature for each different bucket, together of length 1."""
    s = quality.Settings(bits=15)
    f = quality.make_features(*column_bytes(pa.array(TEXTS)), s)
    for i, t in enumerate(TEXTS):
        own = slice(f.at[i], f.at[i + 1])
        words = f.index[own] < 1 << s.bits
        different = {w for w in brute.WORD.findall(brute._lower(t))}
        assert words.sum() <= len(different) and abs((f.value[own][words] ** 2).sum() - bool(different)) < 1e-6
        assert (~words).sum() == len(quality.STATISTICS)


def fewest(lengths: tuple[int, ...], size: int) -> int:
    @cache
    def go(left: tuple[int, ...]) -> int:
        if not left:
            return 0
        best = len(left)
        first, rest = left[0], left[1:]

        def fill(room: int, at: int, kept: tuple[int, ...]) -> None:
            nonlocal best
            best = min(best, 1 + go(kept + rest[at:]))
            for i in range(at, len(rest)):
                if rest[i] <= room:
                    fill(room - rest[i], i + 1, kept + rest[at:i])

        fill(size - first, 0, ())
        return best

    return go(tuple(sorted(lengths, reverse=True)))


def test_packing_is_close_to_the_fewest():
    rng = np.random.default_rng(4)
    used = least = 0
    for _ in range(60):
        lengths = rng.integers(1, 13, rng.integers(1, 9)).tolist()
        counts = {x: lengths.count(x) for x in set(lengths)}
        n = sum(k for _, k in packing.plan_packing(counts, 12))
        best = fewest(tuple(lengths), 12)
        assert best <= n <= best + 1
        used, least = used + n, least + best
    assert used <= 1.03 * least


HARD = [
    "é café ẛ̣", "​‍﻿ zero widths", "👩‍👩‍👧‍👦 🏳️‍🌈 🇩🇪", "א בְ שלום مرحبا عِ", "नमस्ते ไทย 한국어 가", " nb em　id",
    "tabs\t\tand\r\nends\r\n\r\n  ", "  leading and   inner    runs", "don't can't I'LL we've 'tis", "1234567 12.5e-3 0xFF", "a" * 3000, "\U0001f600" * 50, "\x00\x01\x7f\x85  ",
    "ſtraße İstanbul ŉ ǆ ﬁ", "<|endoftext|> <s> </s>", "x̀́̂y", "日本語のテキスト。改行\nも", "--==__++//\\\\", "١٢٣ ⅷ ½ ²", "͸\U000e0001 unassigned",
]


def test_ids_are_the_tokenizers(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    hard = [(-1 - i, t) for i, t in enumerate([*HARD, " ".join(HARD), "".join(HARD)])]
    docs = docs.unionByName(spark.createDataFrame(hard, docs.schema))
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = {}
    rows = packing.cut_pieces(docs, 1 << 30, 2, path, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for r in rows.collect():
        got[r["doc_id"]] = (r["length"], r["ids_crc32"])
    tok = Tokenizer.from_file(path)
    for r in docs.toLocalIterator():
        ids = np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2], dtype="<u4")
        assert got[r["doc_id"]] == (len(ids), zlib.crc32(ids.tobytes())), r["doc_id"]
