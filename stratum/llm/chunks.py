"""Repeats of at least W symbols: what the two substring operators share.

A window is W consecutive symbols (bytes or words) of one text.  The least of a
window's k-grams is its anchor: the rarest first, as a count sketch of a fixed
size over all texts knows them, then by hash.  Equal windows have equal anchors,
so a repeat can only be found among windows of one anchor, and neighbouring
windows mostly share theirs: a chunk is a run of consecutive windows with one
anchor, a few dozen windows in one stretch of text.  A line that very many
texts have isn't an anchor where anything rarer stands beside it, so windows
over such a line are dealt out by what is around it; only windows of nothing but
frequent grams meet there, and equal ones of those are one.

0. gram_levels: the sketch.
1. cut_chunks: every text gives its chunks as small rows without text.
2. repeated_chunks: anchors that occur once are done with.  Of equal chunks one
   stands for all (with its count), so a passage that a third of all texts share
   costs one chunk.
3. chunk_texts: only the stretches of the standing chunks travel, to the
   partition of their anchor, where an operator's own structure (suffix array,
   suffix tree) decides their windows.
4. mark: what was decided goes back to every place where the chunk stands, and
   then to its text.

Nothing here is sampled or cut off: anchors are a lossless way to deal windows
out to tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from .shared import materialize, partitions, scope
from .textblock import U64, Words, column_bytes, mix64, powers, sliding_min, slices

_BASE = 0xA0761D6478BD642F | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: A null id is larger than any other.
NO_ID = (1 << 63) - 1

CHUNKS = "rid long, doc_id long, start int, windows int, anchor long, chunk long, again boolean"


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(rid, doc_id, text, rest): rid tells rows apart; rows that repeat both id and text share it, and so their result.

    rest holds the columns to carry along.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rest = F.struct(*(F.col(f"`{c}`") for c in carry)) if carry else F.lit(None).cast("boolean")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), rest.alias("rest")).select(
        F.xxhash64("doc_id", "text").alias("rid"), "doc_id", "text", "rest"
    )


def span_hashes(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """64-bit hashes of h[start:end], by prefix sums modulo 2**64."""
    inverse = _INVERSE if base == _BASE else pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(h) + 1, dtype=U64)
        np.cumsum(h * powers(base, len(h)), out=sums[1:])
        return mix64((sums[ends] - sums[starts]) * powers(inverse, len(h) + 1)[starts])


def chunk_runs(h: np.ndarray, first: np.ndarray, window: int, gram: int, levels: np.ndarray) -> tuple[np.ndarray, ...]:
    """Chunks of one slice: (text, first symbol in the slice, windows, anchor, chunk hash, whether the anchor stands in it again).

    h: a hash for each symbol; first: index of each text's first symbol, with
    the end; levels: of the sketch of all grams.
    """
    empty = np.zeros(0, dtype=np.int64)
    if len(h) < window:
        return empty, empty, empty, empty, empty, empty.astype(bool)
    at = np.arange(len(h) - gram + 1)
    grams = span_hashes(h, at, at + gram)
    grams = sketch.level(levels, grams).astype(U64) << U64(56) | grams >> U64(8)
    least = sliding_min(grams, window - gram + 1)
    counts = np.diff(first) - window + 1
    rows = np.flatnonzero(counts > 0)
    counts = counts[rows]
    begin = np.cumsum(counts) - counts
    starts = np.repeat(first[rows] - begin, counts) + np.arange(int(counts.sum()))
    owner = np.repeat(rows, counts)
    anchor = least[starts]
    opens = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]))) if len(starts) else empty
    windows = np.diff(np.append(opens, len(starts)))
    s, a = starts[opens], anchor[opens]
    # a k-gram is the least of some window if it equals the greatest of the minima around it
    reach = window - gram + 1
    around = np.concatenate([np.zeros(reach - 1, dtype=U64), least, np.zeros(reach - 1, dtype=U64)])
    chosen = np.flatnonzero(grams == ~sliding_min(~around, reach)[: len(grams)])
    lo, hi = np.searchsorted(chosen, s), np.searchsorted(chosen, s + windows + window - gram)
    each = hi - lo
    inside = chosen[np.repeat(lo - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))]
    times = np.bincount(np.repeat(np.arange(len(s)), each), grams[inside] == np.repeat(a, each), len(s))
    return owner[opens], s, windows, a.astype(np.int64), span_hashes(h, s, s + windows + window - 1).astype(np.int64), times > 1


def symbols_of(batch: pa.RecordBatch, words: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, Words | None]:
    """(symbol hashes, first symbol of each text, bytes, words)."""
    buf, offsets = column_bytes(batch.column("text"))
    if words:
        w = Words(buf, offsets)
        return w.hashes(), w.first, buf, w
    return buf.astype(U64) + U64(1), offsets, buf, None


def gram_levels(docs: DataFrame, gram: int, words: bool) -> np.ndarray:
    """The levels of all texts' grams (those over two texts' border count too: an order needs no exact counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.cells()
        for batch in slices(batches, limit=1 << 20):
            h = symbols_of(batch, words)[0]
            at = np.arange(max(0, len(h) - gram + 1))
            sketch.add(counts, span_hashes(h, at, at + gram))
        yield pa.record_batch([*sketch.pieces(counts)], names=["slice", "counts"])

    return sketch.levels_of(docs.select("text").mapInArrow(run, "slice int, counts binary"))


def cut_chunks(docs: DataFrame, window: int, gram: int, words: bool, levels: np.ndarray) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        for batch in slices(batches, limit=1 << 20):
            h, first, _, _ = symbols_of(batch, words)
            row, start, windows, anchor, chunk, again = chunk_runs(h, first, window, gram, levels)
            take = pa.array(row)
            yield pa.record_batch(
                [
                    batch.column("rid").take(take),
                    batch.column("doc_id").take(take),
                    pa.array((start - first[row]).astype(np.int32)),
                    pa.array(windows.astype(np.int32)),
                    pa.array(anchor),
                    pa.array(chunk),
                    pa.array(again),
                ],
                names=["rid", "doc_id", "start", "windows", "anchor", "chunk", "again"],
            )

    return docs.mapInArrow(run, CHUNKS)


def repeated_chunks(chunks: DataFrame, across_documents: bool) -> DataFrame:
    """Chunks whose anchor occurs again, with `stands` (one of each set of equal chunks) and `copies` (how many these are).

    across_documents: an anchor counts only if texts of different ids have it.
    Equal chunks are gathered by partial aggregation before any join, and what
    an anchor has is summed the same way, so no task holds all of one.
    """
    per_chunk = chunks.groupBy("anchor", "chunk").agg(
        F.count(F.lit(1)).alias("copies"),
        F.min(F.struct("doc_id", "rid", "start")).alias("one"),
        F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("lo"),
        F.max(F.coalesce("doc_id", F.lit(NO_ID))).alias("hi"),
        F.max(F.col("windows")).alias("windows"),
        F.max("again").alias("again"),
    )
    per_anchor = per_chunk.groupBy("anchor").agg(F.min("lo").alias("least"), F.max("hi").alias("most"), F.sum("copies").alias("times"), F.max("again").alias("twice"))
    alive = per_anchor.where("least < most" if across_documents else "times > 1 or twice").select("anchor")
    return per_chunk.join(alive, "anchor").select("anchor", "chunk", "copies", "lo", "one", "windows")


def chunk_texts(docs: DataFrame, standing: DataFrame, window: int, words: bool) -> DataFrame:
    """The stretch of text of each standing chunk, dealt by anchor and sorted within each partition."""
    spark = docs.sparkSession
    wanted = standing.groupBy(F.col("one.rid").alias("rid")).agg(
        F.collect_list(F.struct("anchor", "chunk", F.col("one.start").alias("start"), "windows", "copies", "lo")).alias("parts")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in slices(batches, limit=1 << 20):
            # rows that repeat id and text stand next to each other after the join: one of them is enough
            rid = batch.column("rid").to_numpy()
            new = np.append(rid[0] != last, rid[1:] != rid[:-1])
            last = rid[-1]
            if not new.all():
                batch = batch.filter(pa.array(new))
            if not batch.num_rows:
                continue
            _, first, buf, w = symbols_of(batch, words) if words else (None, *column_bytes(batch.column("text"))[::-1], None)
            parts = batch.column("parts")
            row = np.repeat(np.arange(batch.num_rows), np.asarray(parts.value_lengths()))
            flat = parts.flatten()
            field = {f.name: flat.field(i) for i, f in enumerate(flat.type)}
            s = first[row] + field["start"].to_numpy().astype(np.int64)
            e = s + field["windows"].to_numpy() + window - 1
            texts = []
            raw = buf.tobytes()
            for a, b in zip((w.start[s] if words else s).tolist(), (w.end[e - 1] if words else e).tolist(), strict=True):
                texts.append(raw[a:b])
            yield pa.record_batch(
                [field["anchor"], field["chunk"], field["windows"], field["copies"], field["lo"], pa.array(texts, pa.binary())],
                names=["anchor", "chunk", "windows", "copies", "lo", "stretch"],
            )

    return (
        docs.join(wanted, "rid")
        .mapInArrow(run, "anchor long, chunk long, windows int, copies long, lo long, stretch binary")
        .repartition(partitions(spark), "anchor")
        .sortWithinPartitions("anchor", "chunk")
    )


def anchor_blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Whole anchors, as many together as have `limit` bytes of text; a chunk that came twice (from rows with one rid) once."""
    for table in _blocks(batches, limit):
        anchor, chunk = table.column("anchor").to_numpy(), table.column("chunk").to_numpy()
        again = np.append(False, (anchor[1:] == anchor[:-1]) & (chunk[1:] == chunk[:-1]))
        yield table.filter(pa.array(~again)) if again.any() else table


def _blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        table = pa.Table.from_batches([batch])
        anchor = table.column("anchor").to_numpy()
        lens = np.asarray(pc.binary_length(table.column("stretch")).to_numpy(), dtype=np.int64)
        sums = np.cumsum(lens)
        opens = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])) if len(anchor) else np.zeros(0, np.int64)
        at = 0
        for o in opens.tolist():
            if held and o == 0 and held[-1].column("anchor")[-1].as_py() == anchor[0]:
                continue
            inside = int(sums[o - 1] - (sums[at - 1] if at else 0)) if o > at else 0
            if size + inside >= limit:
                if o > at:
                    held.append(table.slice(at, o - at))
                if held:
                    yield pa.concat_tables(held)
                held, size, at = [], 0, o
        if at < len(anchor):
            held.append(table.slice(at))
            size += int(sums[-1] - (sums[at - 1] if at else 0))
    if held:
        yield pa.concat_tables(held)


def find_repeats(
    docs: DataFrame,
    window: int,
    gram: int,
    words: bool,
    across_documents: bool,
    decide: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str,
    carry: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame]:
    """(keyed documents, for each rid the decided chunks as an array `marks`).

    decide turns sorted chunk texts of one partition into rows of `schema`,
    which begins with anchor and chunk.
    """
    rows = keyed(docs, carry=carry)
    with scope(docs.sparkSession):
        levels = gram_levels(rows, gram, words)
        chunks = materialize(cut_chunks(rows.select("rid", "doc_id", "text"), window, gram, words, levels), "chunks", "lz4")
        standing = materialize(repeated_chunks(chunks, across_documents), "standing")
        decided = chunk_texts(rows, standing, window, words).mapInArrow(decide, schema)
        extra = [c for c in decided.columns if c not in ("anchor", "chunk")]
        marks = chunks.select("rid", "start", "anchor", "chunk").join(decided, ["anchor", "chunk"])
        # a set: rows that repeat id and text have the same marks, which stay one before and after the shuffle
        marks = materialize(marks.groupBy("rid").agg(F.collect_set(F.struct("start", *extra)).alias("marks")), "marks", keep=True)
    return rows, marks
