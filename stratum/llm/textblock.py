"""Vectorised views of Arrow string columns.

Texts stay as one contiguous UTF-8 buffer; words, word hashes and n-gram
hashes are numpy arrays over it.  Separators are ASCII bytes only, so working
on bytes gives the same words as working on characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Word separators of the result contracts: space and \x09-\x0D (fixed values).
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_IS_SEP = np.zeros(256, dtype=bool)
_IS_SEP[list(SEPARATORS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

U64 = np.uint64
_WORD_BASE = 0x9E3779B97F4A7C15 | 1
_GRAM_BASE = 0xD1B54A32D192ED03 | 1


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, dtype=U64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)[:n]


_POW = powers(_WORD_BASE, 256)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(32))
        x = x * U64(0xD6E8FEB86659FD93)
        x = x ^ (x >> U64(32))
        x = x * U64(0xD6E8FEB86659FD93)
        return x ^ (x >> U64(32))


def column_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    if col.null_count:
        col = pc.fill_null(col, "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(off, dtype=np.int64 if large else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Cuts batches between rows so that a slice holds about `limit` bytes of text; one row is never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            base = ends[at] - sizes[at]
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


class Words:
    """Words of the texts of one slice.

    start, end: byte range of each word in `buf`; doc: row of each word;
    first: index of each row's first word, with one more entry at the end.
    """

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.buf = buf = _LOWER[buf] if lower and len(buf) else buf
        self.offsets = offsets
        n = len(buf)
        word = ~_IS_SEP[buf]
        opens = np.ones(n + 1, dtype=bool)
        np.logical_not(word, out=opens[1:])
        opens[offsets] = True  # a row's end also ends a word
        self.mask = word
        self.start = np.flatnonzero(word & opens[:-1])
        shut = np.ones(n, dtype=bool)
        if n:
            np.logical_not(word[1:], out=shut[:-1])
            edge = offsets[offsets > 0] - 1
            shut[edge] = True
        self.end = np.flatnonzero(word & shut) + 1
        self.first = np.searchsorted(self.start, offsets, side="left")
        self.count = np.diff(self.first)
        self.n = len(self.start)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word's bytes."""
        if not self.n:
            return np.zeros(0, U64)
        lens = self.end - self.start
        at = np.zeros(self.n, dtype=np.int64)
        np.cumsum(lens[:-1], out=at[1:])
        body = self.buf[self.mask].astype(U64)
        longest = int(lens.max())
        table = _POW if longest <= len(_POW) else powers(_WORD_BASE, longest)
        place = np.arange(len(body), dtype=np.int64) - np.repeat(at, lens)
        with np.errstate(over="ignore"):
            body += U64(1)
            body *= table[place]
            h = np.add.reduceat(body, at)
            return mix64(h ^ (lens.astype(U64) * U64(_GRAM_BASE)))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of h[i:i+k] for every i that has k values; ends of rows are not looked at."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        out = h[:n].copy()
        for j in range(1, k):
            out *= U64(_GRAM_BASE)
            out += h[j : j + n]
    return mix64(out)


def spans_join(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """Bytes of the given ranges, joined by one space."""
    if not len(starts):
        return b""
    lens = ends - starts
    total = int(lens.sum()) + len(starts) - 1
    out = np.full(total, 0x20, dtype=np.uint8)
    to = np.zeros(len(starts), dtype=np.int64)
    np.cumsum(lens[:-1] + 1, out=to[1:])
    place = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
    out[np.repeat(to, lens) + place] = buf[np.repeat(starts, lens) + place]
    return out.tobytes()


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of x[i:i+w] for every i that has w values, by doubling."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    cur, width = x, 1
    while width * 2 <= w:
        cur = np.minimum(cur[:-width], cur[width:])
        width *= 2
    if width < w:
        cur = np.minimum(cur[:n], cur[w - width : w - width + n])
    return cur[:n]
