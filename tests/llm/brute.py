"""Plain definitions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
INF = float("inf")


def suffix_dedup(docs, window):
    """docs: [(doc_id, text)] -> sorted rows (doc_id, n_bytes, n_removed, n_spans, sha)."""
    raw = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(b[i : i + window] for _, b in raw for i in range(len(b) - window + 1))
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def substring_dedup(docs, window):
    words = [(d, WORD.findall(t or "")) for d, t in docs]
    least = defaultdict(lambda: INF)
    for d, w in words:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            least[key] = min(least[key], INF if d is None else d)
    out = []
    for d, w in words:
        gone = bytearray(len(w))
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < (INF if d is None else d):
                gone[i : i + window] = b"\1" * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def _lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, size=5):
    w = WORD.findall(_lower(text))
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def jaccard_components(docs, percent=80):
    """docs with distinct ids -> {doc_id: (n_shingles, component_id)}."""
    sets = {d: shingles(t) for d, t in docs}
    where = defaultdict(set)
    for d, s in sets.items():
        for x in s:
            where[x].add(d)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d, s in sets.items():
        shared = Counter(e for x in s for e in where[x] if e < d)
        for e, both in shared.items():
            if 100 * both >= percent * (len(s) + len(sets[e]) - both):
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return {d: (len(s), find(d)) for d, s in sets.items()}


def suffix_tree_scores(docs, depth=2, least=16, slack=1.0, modulus=7, remainder=2):
    """{doc_id: (held_out, n_tokens, n_known, N, base, score)}."""
    import math
    import zlib

    import numpy as np

    end = ("end",)
    texts = {d: [*WORD.findall(_lower(t)), end] for d, t in docs}
    held = {d: zlib.crc32(str(d).encode()) % modulus == remainder for d in texts}
    train = [w for d, w in texts.items() if not held[d]]
    c = Counter(x for w in train for x in w)
    n, v = sum(c.values()), len(c)
    p0 = lambda x: (c[x] + 1) / (n + v + 1)
    grams = [None] + [Counter(tuple(w[i - k : i + 1]) for w in train for i in range(k, len(w))) for k in range(1, depth + 1)]
    total = {(x,): k for x, k in c.items()} | {g: k for level in grams[1:] for g, k in level.items()}
    follow = [None] + [defaultdict(dict) for _ in range(depth)]
    for k in range(1, depth + 1):
        for g, m in grams[k].items():
            follow[k][g[:-1]][g[-1]] = m
    kept: dict = {}

    def prob(context, x):
        if not context:
            return p0(x)
        parent = prob(context[1:], x)
        if not kept.get(context):
            return parent
        t = kept[context]
        return (follow[len(context)][context].get(x, 0) + t * parent) / (total[context] + t)

    for k in range(1, depth + 1):
        for context, nexts in follow[k].items():
            if all(total.get(context[:j], 0) >= least for j in range(1, k + 1)):
                g = 0.0
                for x, m in nexts.items():
                    parent = float(np.exp(np.float64(np.float16(math.log(prob(context[1:], x))))))
                    g += m * math.log(m / total[context] / parent)
                if g > slack * len(nexts):
                    kept[context] = len(nexts)
    out = {}
    for d, w in texts.items():
        score = sum(math.log10(prob(tuple(w[max(0, i - depth) : i]), x)) for i, x in enumerate(w))
        out[d] = (held[d], len(w), sum(c[x] > 0 for x in w), n, sum(math.log10(p0(x)) for x in w), score)
    return out




def segmentations(text, scores, penalty):
    """All segmentations of a short text as (score, pieces); characters without a piece stand alone."""
    if not text:
        return [(0.0, ())]
    out = []
    for k in range(1, len(text) + 1):
        head = text[:k]
        if head in scores:
            out += [(scores[head] + s, (head, *p)) for s, p in segmentations(text[k:], scores, penalty)]
        elif k == 1:
            out += [(penalty + s, (head, *p)) for s, p in segmentations(text[k:], scores, penalty)]
    return out
