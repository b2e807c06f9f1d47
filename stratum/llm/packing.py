"""Best-fit packing of documents into token sequences by exact-complement hashing.

1. Documents become pieces (only those longer than a sequence are cut), in
   parallel; texts never leave their task.
2. The counts of pieces by length, at most `size` numbers however large the
   input is, are packed: for the longest open length the gap is looked up in
   hashed indexes of single, pair and triple length sums; combinations that
   fill it exactly are used as often as the counts allow, and what has no exact
   complement takes the longest piece that fits.
3. Each piece gets its rank within its length (range partitions, no global
   task) and finds its sequence and offset by arithmetic on the plan.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize, partitions, ship
from .textblock import U64, column_bytes, mix64, powers, slices

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Letters up to Latin Extended-B, general punctuation and currency signs, but no space beyond ASCII: the Unicode classes
#: of these have been stable for decades, so both tokenizer libraries split them alike.
_OTHER = re.compile("[^\x00-\x1b\x20-\x84\x86-\x9f\xa1-ɏ‐-‧‰-⁞₠-₿]|<\\|endoftext\\|>")
#: Bytes with which a character outside of that range can begin.
_ODD = np.zeros(256, dtype=bool)
_ODD[0x1C:0x20] = _ODD[0xC9:] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


_ENCODERS: dict[tuple, PieceEncoder] = {}


def encoder_of(*args: str | None) -> PieceEncoder:
    """One encoder for each Python worker: what it has learned serves its later tasks."""
    if args not in _ENCODERS:
        _ENCODERS[args] = PieceEncoder(*args)
    return _ENCODERS[args]


class PieceEncoder:
    """Token ids of whole texts.

    A byte-level BPE never merges across a space between two visible
    characters, so texts are cut there and each distinct cut is encoded once;
    texts with characters outside the stable range go through the tokenizer
    as a whole.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None, cache: int = 8_000_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer_path)
        self.encode = lambda s: self.whole.encode(s, add_special_tokens=False).ids
        self.part, self.widths = self.encode, None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.part = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self.widths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
            for token, rank in ranks.items():
                self.widths[rank] = len(token)
        self.cache = cache
        self._clear()

    def _clear(self) -> None:
        self.key = np.zeros(1 << 22, dtype=U64)  # direct-mapped: a later cut may push an earlier one out
        self.slot = np.zeros(1 << 22, dtype=np.int32)
        self.pool = np.zeros(0, dtype="<u4")
        self.at = np.zeros(1, dtype=np.int64)

    def _learn(self, keys: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Encodes the cuts raw[starts:ends], remembers their ids by key, and returns their places in the pool."""
        ids, sizes = [], np.zeros(len(keys), dtype=np.int64)
        inner = np.zeros(len(keys), dtype=bool)
        if self.widths is not None and len(keys):
            # cuts with a space before and none behind stay cuts when they follow each other: one call for all
            raw_bytes = np.frombuffer(raw, dtype=np.uint8)
            inner = (raw_bytes[starts] == 0x20) & ~_SPACE[raw_bytes[ends - 1]] & ~_SPACE[raw_bytes[np.minimum(starts + 1, len(raw) - 1)]]
        order = np.concatenate([np.flatnonzero(inner), np.flatnonzero(~inner)])
        n = int(inner.sum())
        if n:
            text = b"".join(raw[i:j] for i, j in zip(starts[inner].tolist(), ends[inner].tolist(), strict=True))
            got = np.asarray(self.part(text.decode("utf-8", "surrogatepass")), dtype="<u4")
            reach = np.cumsum(self.widths[got])
            upto = np.searchsorted(reach, np.cumsum(ends[inner] - starts[inner]), side="left") + 1
            sizes[:n] = np.diff(upto, prepend=0)
            ids.append(got)
        for k, (i, j) in enumerate(zip(starts[~inner].tolist(), ends[~inner].tolist(), strict=True)):
            own = self.part(raw[i:j].decode("utf-8", "surrogatepass"))
            sizes[n + k] = len(own)
            ids.append(np.asarray(own, dtype="<u4"))
        base = len(self.at) - 1
        self.pool = np.concatenate([self.pool, *ids])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])
        slots = np.empty(len(keys), dtype=np.int64)
        slots[order] = np.arange(base, base + len(keys))
        home = (keys & U64(len(self.key) - 1)).astype(np.int64)
        home_order = np.argsort(home, kind="stable")
        last = home_order[np.append(np.diff(home[home_order]) > 0, True)] if len(keys) else home_order
        self.key[home[last]], self.slot[home[last]] = keys[last], slots[last]
        return slots

    def encode_all(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text's ids)."""
        n = len(offsets) - 1
        raw = buf.tobytes()
        odd = _ODD[buf]
        if len(buf) > 1:
            odd[1:] |= (buf[:-1] == 0xC2) & ((buf[1:] == 0x85) | (buf[1:] == 0xA0)) | (buf[:-1] == 0x3C) & (buf[1:] == 0x7C)
        rows = np.unique(np.searchsorted(offsets, np.flatnonzero(odd), side="right") - 1).tolist()
        whole = {i: s for i in rows if _OTHER.search(s := raw[offsets[i] : offsets[i + 1]].decode("utf-8", "surrogatepass"))}
        if len(self.pool) > self.cache:
            self._clear()
        space = _SPACE[buf]
        cut = np.zeros(len(buf), dtype=bool)
        if len(buf) > 2:
            cut[1:-1] = (buf[1:-1] == 0x20) & ~space[:-2] & ~space[2:]
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        at = np.flatnonzero(cut)
        until = np.append(at, len(buf))[1:]
        first = np.searchsorted(at, offsets)
        if whole:
            keep = ~np.isin(np.repeat(np.arange(n), np.diff(first)), list(whole))
            at, until = at[keep], until[keep]
            first = np.concatenate([[0], np.cumsum(keep)])[first]
        which = np.zeros(len(at), dtype=np.int64)
        if len(at):
            lens = until - at
            begin = np.cumsum(lens) - lens
            place = np.arange(int(lens.sum())) - np.repeat(begin, lens)
            body = buf if not whole else buf[np.repeat(at, lens) + place]
            with np.errstate(over="ignore"):
                h = np.add.reduceat((body.astype(U64) + U64(1)) * powers(0x9E3779B97F4A7C15, int(lens.max()))[place], begin)
                h = mix64(h ^ lens.astype(U64) * U64(0xD1B54A32D192ED03))
            home = (h & U64(len(self.key) - 1)).astype(np.int64)
            which = self.slot[home].astype(np.int64)
            if len(new := np.flatnonzero(self.key[home] != h)):
                keys, index, inverse = np.unique(h[new], return_index=True, return_inverse=True)
                which[new] = self._learn(keys, raw, at[new[index]], until[new[index]])[inverse]
        sizes = self.at[which + 1] - self.at[which] if len(which) else which
        total = int(sizes.sum())
        begin = np.cumsum(sizes) - sizes
        ids = self.pool[np.repeat(self.at[which] - begin, sizes) + np.arange(total)] if total else np.zeros(0, dtype="<u4")
        ends = np.concatenate([[0], np.cumsum(sizes)])[first]
        if not whole:
            return ids, ends
        parts = [np.asarray(self.encode(whole[i]), dtype="<u4") if i in whole else ids[ends[i] : ends[i + 1]] for i in range(n)]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


def cut_pieces(docs: DataFrame, size: int, end_id: int, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path, ranks_path, pattern)
        for batch in slices(batches):
            ids, ends = encoder.encode_all(*column_bytes(batch.column("text")))
            out: list[list] = [[], [], [], [], []]
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                own = np.append(ids[ends[i] : ends[i + 1]], np.array([end_id], dtype="<u4")).astype("<u4")
                n = len(own)
                at = 0
                for piece in range(-(-n // size)):
                    to = at + (n % size or size) if piece == 0 else at + size
                    for column, value in zip(out, (doc_id, piece, at, to - at, zlib.crc32(own[at:to].tobytes())), strict=True):
                        column.append(value)
                    at = to
            yield pa.record_batch(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def plan_packing(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of one sequence, how many such sequences)] that uses every count.

    Works on lengths and counts alone: time and space depend on `size`, not on
    the number of pieces.
    """
    left = np.zeros(size + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] += n
    plan: list[tuple[tuple[int, ...], int]] = []

    def fits(lengths: tuple[int, ...]) -> int:
        """How many times the lengths are all there."""
        return min(int(left[x]) // lengths.count(x) for x in set(lengths))

    def use(lengths: tuple[int, ...]) -> int:
        n = fits(lengths)
        if n > 0:
            for x in lengths:
                left[x] -= n
            plan.append((lengths, n))
        return n

    def pairs(total: int) -> Iterator[tuple[int, int]]:
        """Index of pair sums: the lengths that are left and add up to total, the most uneven first."""
        a = np.arange(max(1, total - size), total // 2 + 1)
        for x in a[(left[a] > 0) & (left[total - a] > 0)].tolist():
            yield x, total - x

    for length in range(size, 0, -1):
        while left[length] > 0:
            gap = size - length
            if gap == 0:
                use((length,))
                continue
            if left[gap] > 0 and use((length, gap)):
                continue
            if any(use((length, *p)) for p in pairs(gap)):
                continue
            found = False
            for x in np.flatnonzero(left[1 : gap // 3 + 1] > 0).tolist() if gap >= 3 else []:
                if any(use((length, x + 1, *p)) for p in pairs(gap - x - 1)):
                    found = True
                    break
            if found:
                continue
            # no exact complement: best fit, one after another, as often as the counts allow
            chosen, room = [length], gap
            while room > 0:
                free = [x for x in np.flatnonzero(left[1 : room + 1] > 0).tolist()[::-1] if left[x + 1] > chosen.count(x + 1)]
                if not free:
                    break
                chosen.append(free[0] + 1)
                room -= free[0] + 1
            use(tuple(chosen))
    return plan


def slot_table(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[list[int], list[int], list[int]]]:
    """For each length: first ranks, sequence of that rank, offset; ranks of a run go to sequences that follow each other."""
    table: dict[int, tuple[list[int], list[int], list[int]]] = {}
    seen: dict[int, int] = {}
    base = 0
    for lengths, n in plan:
        offset = 0
        for x in lengths:
            ranks, bases, offsets = table.setdefault(x, ([], [], []))
            ranks.append(seen.get(x, 0))
            bases.append(base)
            offsets.append(offset)
            seen[x] = seen.get(x, 0) + n
            offset += x
        base += n
    return table


def place_pieces(pieces: DataFrame, size: int) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32)."""
    spark = pieces.sparkSession
    pieces = materialize(pieces, "cut-pieces")  # ranges are sampled first: the texts aren't encoded twice
    # a length that a third of all pieces have is spread over many ranges by the id; equal rows by their place in the table
    spread = pieces.withColumn("_place", F.monotonically_increasing_id())
    spread = spread.repartitionByRange(partitions(spark), "length", "doc_id", "piece", "ids_crc32", "_place").drop("_place")
    dealt = materialize(spread.withColumn("part", F.spark_partition_id()), "pieces")
    discard(pieces)
    counts: dict[int, int] = {}
    first: dict[tuple[int, int], int] = {}
    # ranges follow the length: at most (partitions + size) rows reach the driver
    for part, length, n in sorted(tuple(r) for r in dealt.groupBy("part", "length").count().collect()):
        first[part, length] = counts.get(length, 0)
        counts[length] = counts.get(length, 0) + n
    table = slot_table(plan_packing(counts, size))

    def run(key: tuple, group: pa.Table) -> pa.Table:
        part = key[0].as_py()
        group = group.sort_by([("length", "ascending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = group.column("length").to_numpy()
        ids, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for x in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == x)
            ranks, bases, offs = (np.asarray(y, dtype=np.int64) for y in table[x])
            rank = first[part, x] + np.arange(len(at))
            run_of = np.searchsorted(ranks, rank, side="right") - 1
            ids[at] = bases[run_of] + rank - ranks[run_of]
            offsets[at] = offs[run_of]
        return group.drop_columns(["part"]).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets))

    return dealt.groupBy("part").applyInArrow(run, PIECES + ", sequence_id long, offset long")


def pack(
    docs: DataFrame, tokenizer_path: str, size: int = 1024, end_id: int = 2, ranks_path: str | None = None, pattern: str | None = None
) -> DataFrame:
    """Packs (doc_id, text) into as few sequences of at most `size` ids as the method finds.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset: one
    row per piece.  A null or empty text is the end id alone.  A null doc_id
    stays null, repeated rows are packed each on their own, an empty table
    gives no rows, and other columns are not read.  A text of any length is
    encoded whole and cut into pieces, the first of which may be shorter; of
    pieces of one length any can stand for another, so ties change only numbers.
    """
    ship(docs.sparkSession)
    return place_pieces(cut_pieces(docs, size, end_id, tokenizer_path, ranks_path, pattern), size)
