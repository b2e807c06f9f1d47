"""Substring deduplication with prefix-partitioned suffix trees.

Windows of `window` words are dealt to partitions by anchor (see chunks.py).
Within a partition, suffixes are split by prefixes of variable length: a prefix
that more than `subtree` suffixes have is lengthened until its groups fit, or
until it is as long as a window.  Each group is one subtree: its suffixes are
sorted, adjacent ones give the depths of the internal nodes, and a node of
depth `window` or more is a maximal repeat.  The least document id below such a
node tells which of its windows stand in an earlier document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import NO_ID, anchor_blocks, find_repeats
from .shared import ship
from .textblock import Words, column_bytes, slices, spans_join


def doubled_names(symbols: np.ndarray, reach: int) -> list[np.ndarray]:
    """names[j][i] numbers symbols[i : i + 2**j]; numbers are ordered as the strings are."""
    names = [np.unique(symbols, return_inverse=True)[1].astype(np.int64)]
    while 2 ** len(names) <= reach:
        last, step = names[-1], 2 ** (len(names) - 1)
        behind = np.full(len(last), -1, dtype=np.int64)
        behind[:-step] = last[step:]
        names.append(np.unique(last * (len(last) + 2) + behind + 1, return_inverse=True)[1].astype(np.int64))
    return names


def prefix_groups(names: list[np.ndarray], at: np.ndarray, limit: int, level: int = 3) -> Iterator[tuple[np.ndarray, int]]:
    """(suffixes, length of the prefix they share): prefixes of 8, 16, 32 .. symbols, as long as it takes to get at most `limit` suffixes.

    Suffixes that are alone with their prefix cannot repeat and are left out;
    small groups come together with their neighbours.
    """
    level = min(level, len(names) - 1)
    key = names[level][at]
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    opens = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(opens, len(at)))
    big = (size > limit) & (level + 1 < len(names))
    for o, n in zip(opens[big].tolist(), size[big].tolist(), strict=True):
        yield from prefix_groups(names, at[o : o + n], limit, level + 1)
    rest = np.repeat(~big & (size > 1), size)
    if rest.any():
        yield at[rest], 1 << level


def deep_nodes(names: list[np.ndarray], at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the suffixes of one subtree; (suffixes, number of the deep node above each, -1 without one)."""
    bits = [j for j in reversed(range(len(names))) if window >> j & 1]
    keys, offset = [], 0
    for j in bits:
        keys.append(names[j][at + offset])
        offset += 1 << j
    at = at[np.lexsort(keys[::-1])]
    # depth of the node between neighbours: the length of what they share, up to the window
    a, b = at[:-1], at[1:]
    depth = np.zeros(len(a), dtype=np.int64)
    live = np.ones(len(a), dtype=bool)
    for j in bits:
        step = np.zeros(len(a), dtype=bool)
        step[live] = names[j][a[live] + depth[live]] == names[j][b[live] + depth[live]]
        depth[step] += 1 << j
        live &= step
    deep = np.append(False, depth >= window)
    node = np.cumsum(~deep) - 1
    alone = np.bincount(node)[node] == 1
    return at, np.where(alone, -1, node)


def least_owner(symbols: np.ndarray, starts: np.ndarray, windows: np.ndarray, owner: np.ndarray, window: int, subtree: int) -> np.ndarray:
    """For each window, chunk by chunk, the least owner of an equal window (its own chunk's owner if there is no other)."""
    names = doubled_names(symbols, window)
    total = int(windows.sum())
    begin = np.cumsum(windows) - windows
    at = np.repeat(starts - begin, windows) + np.arange(total)
    number = np.full(len(symbols), -1, dtype=np.int64)
    number[at] = np.arange(total)
    out = np.repeat(owner, windows)
    for group, _ in prefix_groups(names, at, subtree):
        suffix, node = deep_nodes(names, group, window)
        inside = node >= 0
        if not inside.any():
            continue
        suffix, node = number[suffix[inside]], node[inside]
        opens = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        out[suffix] = np.repeat(np.minimum.reduceat(out[suffix], opens), np.diff(np.append(opens, len(node))))
    return out


def substring_dedup(
    docs: DataFrame, window: int = 50, gram: int = 8, block: int = 1 << 20, subtree: int = 1 << 16,
    carry: tuple[str, ...] = (), whole: bool = False,
) -> DataFrame:
    """Removes every word that a window of `window` words covers which also starts in a document with a smaller id.

    Returns doc_id, n_words, n_removed, kept_sha256 and kept (the words that
    stay, joined by one space).  Null, empty and short texts lose nothing.  A
    null id is larger than any other and stays null; rows that repeat an id are
    one document, so they take nothing from each other.  An empty table gives
    no rows; other columns are not read, but those in `carry`
    come along; with `whole`, texts that lose nothing stay as they are in `kept`.  A text
    of any length is cut into chunks and put together again in one task; windows
    that stand in several earlier documents go as those of one do.
    """
    if not 1 <= gram <= window:
        raise ValueError("1 <= gram <= window is needed")
    ship(docs.sparkSession)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in anchor_blocks(batches, block):
            words = Words(*column_bytes(table.column("stretch")))
            windows = table.column("windows").to_numpy().astype(np.int64)
            lo = table.column("lo").to_numpy()
            least = least_owner(words.hashes(), words.first[:-1], windows, lo, window, subtree)
            offsets = np.concatenate([[0], np.cumsum(windows)]).astype(np.int32)
            yield pa.record_batch(
                [
                    table.column("anchor").combine_chunks(),
                    table.column("chunk").combine_chunks(),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(least)),
                ],
                names=["anchor", "chunk", "least"],
            )

    rows, marks = find_repeats(docs, window, gram, True, True, decide, "anchor long, chunk long, least array<long>", carry)
    schema = T.StructType.fromDDL("doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    if carry:
        schema.add(rows.schema["rest"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1 << 20):
            words = Words(*column_bytes(batch.column("text")))
            change = np.zeros(words.n + 1, dtype=np.int64)
            marks = batch.column("marks")
            lens = np.asarray(marks.fill_null([]).value_lengths()) if marks.null_count else np.asarray(marks.value_lengths())
            flat = marks.drop_null().flatten()
            row = np.repeat(np.arange(batch.num_rows), lens)
            least = flat.field("least")
            per = np.asarray(least.value_lengths())
            values = least.flatten().to_numpy()
            begin = np.cumsum(per) - per
            where = np.repeat(words.first[row] + flat.field("start").to_numpy() - begin, per) + np.arange(len(values))
            own = np.asarray(batch.column("doc_id").fill_null(NO_ID).to_numpy())[row]
            where = where[values < np.repeat(own, per)].astype(np.int64)
            change += np.bincount(where, minlength=len(change))
            change -= np.bincount(where + window, minlength=len(change))
            stay = np.cumsum(change[:-1]) == 0
            kept, removed = [], []
            for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
                own_words = np.flatnonzero(stay[a:b]) + a
                kept.append(spans_join(words.buf, words.start[own_words], words.end[own_words]))
                removed.append(b - a - len(own_words))
            digests = [hashlib.sha256(x).hexdigest() for x in kept]
            if whole:
                spans = zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True)
                kept = [x if n else words.buf[a:b].tobytes() for x, n, (a, b) in zip(kept, removed, spans, strict=True)]
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    pa.array(words.count),
                    pa.array(removed, pa.int64()),
                    pa.array(digests),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                    *([batch.column("rest")] if carry else []),
                ],
                names=schema.names,
            )

    return rows.join(marks, "rid", "left").mapInArrow(finish, schema)


def keep_first_passages(docs: DataFrame, window: int = 50) -> DataFrame:
    """docs with the words that substring_dedup removes taken out of `text`; texts that lose nothing stay as they are, a null one is empty.

    n_chars, where docs has it, follows the text.  Columns of any other name are
    carried along; odd rows are as in substring_dedup.
    """
    got = substring_dedup(docs, window, carry=tuple(c for c in docs.columns if c not in ("doc_id", "text")), whole=True)
    columns = {"text": F.col("kept"), "doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType)}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("rest.n_chars"))
    return got.select(*(columns.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns))
