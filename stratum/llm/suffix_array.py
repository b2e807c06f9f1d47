"""Suffix-array deduplication with the difference-cover algorithm.

Windows are dealt to partitions by anchor (see chunks.py), so that each
partition sorts its own suffixes: triples at the positions of the difference
cover {1, 2} modulo 3 are sorted and named, names are sorted by recursion, the
remaining suffixes follow from them, and the two orders are merged.  Adjacent
suffixes that agree in their first `window` bytes are repeats.  Everything is
array arithmetic on whole blocks; a block holds whole anchors and about
`block` bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .chunks import anchor_blocks, find_repeats
from .shared import ship
from .textblock import U64, column_bytes, slices


def difference_cover_order(s: np.ndarray) -> np.ndarray:
    """Suffix array of s (integers >= 1) by the difference cover {1, 2} modulo 3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), dtype=np.int64)
    top = int(s.max()) + 1
    padded = np.concatenate([s.astype(np.int64), np.zeros(3, dtype=np.int64)])
    # position n belongs to the cover if n % 3 == 1: then every suffix at 0 modulo 3 has its neighbour in it
    end = n + (n % 3 == 1)
    one, two = np.arange(1, end, 3), np.arange(2, end, 3)
    cover = np.concatenate([one, two])
    pair = padded[:-1] * top + padded[1:]
    if top > 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
    names = np.unique(pair[cover] * top + padded[cover + 2], return_inverse=True)
    rank = np.zeros(n + 3, dtype=np.int64)
    if len(names[0]) == len(cover):
        order = np.empty(len(cover), dtype=np.int64)
        order[names[1]] = np.arange(len(cover))
    else:
        order = difference_cover_order(names[1] + 1)
    rank[cover[order]] = np.arange(1, len(cover) + 1)
    sampled = cover[order]
    sampled = sampled[sampled < n]
    rest = np.arange(0, n, 3)
    wide = len(cover) + 2
    rest = rest[np.argsort(padded[rest] * wide + rank[rest + 1], kind="stable")]
    before = np.zeros(len(sampled), dtype=np.int64)  # how many of the rest come before each sampled suffix
    is_one = sampled % 3 == 1
    i = sampled[is_one]
    before[is_one] = np.searchsorted(padded[rest] * wide + rank[rest + 1], padded[i] * wide + rank[i + 1])
    i = sampled[~is_one]
    if int(pair.max()) > (1 << 62) // wide:
        pair = np.unique(pair, return_inverse=True)[1]
    before[~is_one] = np.searchsorted(pair[rest] * wide + rank[rest + 2], pair[i] * wide + rank[i + 2])
    out = np.empty(n, dtype=np.int64)
    place = before + np.arange(len(sampled))
    out[place] = sampled
    free = np.ones(n, dtype=bool)
    free[place] = False
    out[free] = rest
    return out


def repeated_windows(buf: np.ndarray, starts: np.ndarray, windows: np.ndarray, copies: np.ndarray, window: int) -> np.ndarray:
    """Whether each window stands more than once; windows follow each other chunk by chunk.

    buf holds the stretches, each ended by a 0 of its own (bytes are 2 above
    their value); a chunk's windows begin at starts .. starts + windows - 1.
    """
    order = difference_cover_order(buf)
    total = int(windows.sum())
    begin = np.cumsum(windows) - windows
    at = np.repeat(starts - begin, windows) + np.arange(total)
    number = np.full(len(buf), -1, dtype=np.int64)
    number[at] = np.arange(total)
    weight = np.repeat(copies, windows)
    order = order[number[order] >= 0]
    # adjacent prefixes, eight bytes at a time
    body = np.concatenate([buf.astype(np.uint16), np.zeros(8, np.uint16)])
    eight = np.zeros(len(buf), dtype=U64)
    for j in range(8):
        eight = (eight << U64(8)) | ((body[j : j + len(buf)] - 2) & 0xFF).astype(U64)
    a, b = order[:-1], order[1:]
    live = np.arange(len(a))
    for j in [*range(0, window - 7, 8), window - 8]:
        live = live[eight[a[live] + j] == eight[b[live] + j]]
    same = np.zeros(len(order), dtype=bool)
    same[live + 1] = True
    node = np.cumsum(~same) - 1
    times = np.bincount(node, weight[number[order]])
    out = np.zeros(total, dtype=bool)
    out[number[order]] = times[node] > 1
    return out


def suffix_dedup(docs: DataFrame, window: int = 200, gram: int = 32, block: int = 1 << 19) -> DataFrame:
    """Removes every byte that a `window`-byte string covers which starts elsewhere too.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the
    bytes that stay).  A null or empty text has nothing to remove.  Rows that
    repeat both id and text are documents of their own: each makes the other a
    repeat.  A null id stays null; an empty table gives no rows; other columns
    are not read.  A text of any length is cut into chunks and put together again
    in one task.
    """
    if not 8 <= gram <= window:
        raise ValueError("8 <= gram <= window is needed")
    ship(docs.sparkSession)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in anchor_blocks(batches, block):
            buf, offsets = column_bytes(table.column("stretch"))
            n = len(offsets) - 1
            symbols = np.ones(len(buf) + n, dtype=np.int64)
            symbols[np.arange(len(buf)) + np.repeat(np.arange(n), np.diff(offsets))] = buf.astype(np.int64) + 2
            windows = table.column("windows").to_numpy().astype(np.int64)
            flags = repeated_windows(symbols, offsets[:-1] + np.arange(n), windows, table.column("copies").to_numpy(), window)
            first = np.cumsum(windows) - windows
            some = np.flatnonzero(np.add.reduceat(flags, first) > 0)
            yield pa.record_batch(
                [
                    table.column("anchor").combine_chunks().take(pa.array(some)),
                    table.column("chunk").combine_chunks().take(pa.array(some)),
                    pa.array([np.packbits(flags[first[i] : first[i] + windows[i]]).tobytes() for i in some.tolist()], pa.binary()),
                ],
                names=["anchor", "chunk", "flags"],
            )

    rows, marks = find_repeats(docs, window, gram, False, False, decide, "anchor long, chunk long, flags binary")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1 << 20):
            buf, offsets = column_bytes(batch.column("text"))
            change = np.zeros(len(buf) + 1, dtype=np.int64)
            marks = batch.column("marks")
            lens = np.asarray(marks.fill_null([]).value_lengths()) if marks.null_count else np.asarray(marks.value_lengths())
            flat = marks.drop_null().flatten()
            row = np.repeat(np.arange(batch.num_rows), lens)
            start = offsets[row] + flat.field("start").to_numpy().astype(np.int64)
            bits, at = column_bytes(flat.field("flags"))
            bit = np.flatnonzero(np.unpackbits(bits))
            owner = np.searchsorted(at, bit >> 3, side="right") - 1
            where = start[owner] + bit - at[owner] * 8
            change += np.bincount(where, minlength=len(change))
            change -= np.bincount(where + window, minlength=len(change))
            gone = np.cumsum(change[:-1]) > 0
            opens = gone.copy()
            opens[1:] &= ~gone[:-1]
            inner = offsets[:-1][offsets[:-1] < len(buf)]
            opens[inner] = gone[inner]
            count = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offsets])
            kept = [buf[a:b][~gone[a:b]].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(offsets)),
                    pa.array(count(gone)),
                    pa.array(count(opens)),
                    pa.array([hashlib.sha256(x).hexdigest() for x in kept]),
                    pa.array(kept, pa.binary()),
                ],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return rows.join(marks, "rid", "left").mapInArrow(
        finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
