"""Language-model scoring with a probabilistic suffix tree.

Symbols are words and one end for each text.  The root of the tree is the
smoothed unigram distribution.  A longer context s (up to `depth` words) stays
in the tree if it was seen `least` times and its next-symbol counts diverge from
its parent's distribution:

    G(s) = sum_n c(s, n) ln[ c(s, n) / c(s) / P(n | parent) ]  >  slack * T(s)

with T(s) the number of different next symbols (under the parent's distribution
G grows with T alone).  Distributions are smoothed towards the parent:
P(n | s) = (c(s, n) + T(s) P(n | parent)) / (c(s) + T(s)).  A token is scored at
the longest suffix of its history that is in the tree.  For the decision alone,
P(n | parent) travels as a half-precision logarithm; scores use it in full.

Texts are dealt to blocks of a few megabytes by a hash.  For each level, a block
sends the distinct contexts and pairs that it holds, with its training counts,
to the partitions of their contexts, and gets back the counts and the decision,
in the order in which it asked.  Only such packed requests are shuffled, never
a row for each token.  A context with more than one in `partitions` of all
tokens is spread over partitions by its next symbols; there can be no more than
`partitions` such contexts, so their sums go through the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learning import held_out
from .shared import materialize, partitions, ship, tidy
from .textblock import U64, Words, column_bytes, mix64

END = np.uint64(0x8E51ECB5A1C0FFEE)


@dataclass(frozen=True)
class Settings:
    depth: int = 2  # words; the README has figures of what a third and a fourth add and cost
    least: int = 16  # training occurrences of a context
    slack: float = 1.0
    block: int = 4 << 20  # bytes of text
    salts: int = 16  # of a heavy context
    merge: int = 1 << 17  # pairs that a partition sums at once


ASKS = "cp int, block int, keys binary, sizes binary, pairs binary, counts binary, parents binary"
ANSWERS = "cp int, block int, seen binary, kinds binary"


def squeeze(x: np.ndarray) -> bytes:
    return len(x).to_bytes(8, "little") + pa.compress(x.tobytes(), codec="zstd", asbytes=True) if len(x) else b""


def unsqueeze(b: bytes, dtype) -> np.ndarray:
    if not b:
        return np.zeros(0, dtype)
    n = int.from_bytes(b[:8], "little")
    return np.frombuffer(pa.decompress(b[8:], decompressed_size=n * np.dtype(dtype).itemsize, codec="zstd", asbytes=True), dtype=dtype)


@dataclass
class Level:
    """What a block asks at one level; entries are sorted by partition, context and pair."""

    cp: np.ndarray  # of each pair
    context: np.ndarray
    pair: np.ndarray
    count: np.ndarray  # training occurrences in this block
    parent: np.ndarray  # P(n | parent)
    total: np.ndarray  # c(s), known from the level before
    where: np.ndarray  # token positions that have this level
    entry: np.ndarray  # their pairs


class Block:
    """Tokens of a block's texts and what is known about them."""

    def __init__(self, table: pa.Table):
        order = np.lexsort((table.column("rid").to_numpy(), np.asarray(table.column("doc_id").fill_null(-1).to_numpy())))
        table = table.take(pa.array(order))
        self.table = table
        words = Words(*column_bytes(table.column("text")), lower=True)
        n = table.num_rows
        h = words.hashes()
        self.at = words.first + np.arange(n + 1)  # first token of each text, and the end
        self.tokens = np.full(words.n + n, END, dtype=U64)
        self.tokens[np.arange(words.n) + words.doc] = h
        self.owner = np.repeat(np.arange(n), np.diff(self.at))
        self.place = np.arange(len(self.tokens)) - self.at[:-1][self.owner]
        self.train = ~np.asarray(table.column("held_out").to_numpy(zero_copy_only=False), dtype=bool)[self.owner]

    def base_level(self, parts: int) -> Level:
        """Unigrams: every token is a pair of its own context."""
        keys, entry = np.unique(self.tokens, return_inverse=True)
        cp = (mix64(keys) % U64(parts)).astype(np.int64)
        return self._level(cp, keys, keys, np.arange(len(self.tokens)), entry, np.zeros(len(keys)), np.zeros(len(keys)))

    def _level(self, cp, context, pair, where, entry, parent, total) -> Level:
        order = np.lexsort((pair, context, cp))
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        entry = rank[entry]
        count = np.bincount(entry, self.train[where], len(order)).astype(np.int64)
        return Level(cp[order], context[order], pair[order], count, parent[order], total[order], where, entry)

    def next_level(self, k: int, least: int, heavy: float, parts: int, salts: int, times: np.ndarray, prob: np.ndarray) -> Level:
        """Contexts of k words; times: occurrences of the k words before each token's end; prob: P at the parent for each token."""
        where = np.flatnonzero(self.place >= k)
        total = times[where - 1]
        where, total = where[total >= least], total[total >= least]
        with np.errstate(over="ignore"):
            context = np.full(len(where), 0x1234567, dtype=U64)
            for j in range(k, 0, -1):
                context = mix64(context * U64(0x9E3779B97F4A7C15) + self.tokens[where - j])
            pair = mix64(context ^ mix64(self.tokens[where])) & U64(0xFFFFFFFFFFFF)
            joint = mix64(context + pair * U64(0xD1B54A32D192ED03))
        _, index, entry = np.unique(joint, return_index=True, return_inverse=True)
        context, pair, total = context[index], pair[index], total[index]
        salt = np.where(total >= heavy, (pair % U64(salts)).astype(np.int64) + 1, 0).astype(U64)
        cp = (mix64(context + salt) % U64(parts)).astype(np.int64)
        return self._level(cp, context, pair, where, entry, prob[where][index], total)


def ask(level: Level, block: int, base: bool) -> pa.Table:
    """One row for each partition asked."""
    rows: list[list] = [[] for _ in range(7)]
    opens = np.flatnonzero(np.append(True, level.cp[1:] != level.cp[:-1])) if len(level.cp) else np.zeros(0, np.int64)
    for o, e in zip(opens.tolist(), [*opens[1:].tolist(), len(level.cp)], strict=True) if len(opens) else []:
        c = level.context[o:e]
        first = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
        rows[0].append(int(level.cp[o]))
        rows[1].append(block)
        rows[2].append(c[first].tobytes())
        if base:
            rows[3].append(b"")
            rows[4].append(b"")
            rows[6].append(b"")
        else:
            rows[3].append(squeeze(np.concatenate([np.diff(np.append(first, e - o)), level.total[o:e][first].astype(np.int64)])))
            rows[4].append(np.ascontiguousarray(level.pair[o:e].view(np.uint16).reshape(-1, 4)[:, :3]).tobytes())
            rows[6].append(squeeze(np.log(level.parent[o:e]).astype(np.float16)))
        rows[5].append(squeeze(level.count[o:e].astype(np.uint32)))
    types = [pa.int32(), pa.int32(), *([pa.binary()] * 5)]
    return pa.table([pa.array(r, t) for r, t in zip(rows, types, strict=True)], names=["cp", "block", "keys", "sizes", "pairs", "counts", "parents"])


def answer_base(batches):
    """Sums the training counts of equal keys; kinds carries N and V parts in a row of block -1."""
    table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
    if table is None or not table.num_rows:
        return
    keys = [np.frombuffer(k.as_buffer(), dtype=U64) for k in table.column("keys")]
    lens = [len(k) for k in keys]
    distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.concatenate([unsqueeze(c.as_py(), np.uint32) for c in table.column("counts")])
    total = np.bincount(inverse, counts, len(distinct)).astype(np.int64)
    seen = total[inverse]
    ends = np.cumsum(lens)
    out = [squeeze(seen[e - n : e].astype(np.uint32)) for e, n in zip(ends.tolist(), lens, strict=True)]
    yield pa.record_batch(
        [
            pa.concat_arrays([table.column("cp").combine_chunks(), pa.array([-1], pa.int32())]),
            pa.concat_arrays([table.column("block").combine_chunks(), pa.array([-1], pa.int32())]),
            pa.array([*out, np.array([total.sum(), (total > 0).sum()], dtype=np.int64).tobytes()], pa.binary()),
            pa.array([*([b""] * len(out)), b""], pa.binary()),
        ],
        names=["cp", "block", "seen", "kinds"],
    )


def answer_level(heavy: float, slack: float, merge: int = Settings.merge) -> Callable:
    """Counts for every pair, and for every context T if it stays, 0 if it goes, -1 if the heavy sums decide.

    What was asked is held in the narrow types in which it came.  Counts, G and T
    are sums over pairs, so pairs are summed one hash range after another, and
    the wide arrays are those of some `merge` pairs, whatever their contexts are.
    """

    def run(batches):
        batches = list(batches)
        table = pa.Table.from_batches(batches) if batches else None
        if table is None or not table.num_rows:
            return
        context, total, size, pair = [], [], [], []
        for keys, sizes, pairs in zip(table.column("keys"), table.column("sizes"), table.column("pairs"), strict=True):
            c = np.frombuffer(keys.as_buffer(), dtype=U64)
            both = unsqueeze(sizes.as_py(), np.int64)
            context.append(c)
            size.append(both[: len(c)].astype(np.uint32))
            total.append(both[len(c) :])
            pair.append(np.frombuffer(pairs.as_buffer(), dtype=np.uint16).reshape(-1, 3))
        rows_c, rows_p = [len(x) for x in context], [len(x) for x in pair]
        names, number = np.unique(np.concatenate(context), return_inverse=True)
        number = number.astype(np.int32)
        c_total = np.zeros(len(names), dtype=np.int64)
        c_total[number] = np.concatenate(total)
        own, pair = np.repeat(number, np.concatenate(size)), np.concatenate(pair)
        counts = np.concatenate([unsqueeze(c.as_py(), np.uint32) for c in table.column("counts")])
        parent = np.concatenate([unsqueeze(c.as_py(), np.float16) for c in table.column("parents")])
        cp, block = table.column("cp").combine_chunks(), table.column("block").combine_chunks()
        del table, batches, context, total, size, keys, sizes, pairs, c, both

        ranges = min(-(-len(own) // merge), 1 << 16)
        part = (pair[:, 2].astype(np.uint32) * np.uint32(ranges) >> np.uint32(16)).astype(np.uint16)
        by_range = np.argsort(part, kind="stable")
        ends = np.cumsum(np.bincount(part, minlength=ranges)).tolist()
        seen = np.zeros(len(own), dtype=np.uint32)
        g, t = np.zeros(len(names)), np.zeros(len(names), dtype=np.int64)
        for o, e in zip([0, *ends[:-1]], ends, strict=True):
            if o == e:
                continue
            at = by_range[o:e]
            q = np.zeros((len(at), 4), dtype=np.uint16)
            q[:, :3] = pair[at]
            q = q.view(np.uint64).ravel()
            order = np.lexsort((q, own[at]))
            at, q = at[order], q[order]
            w = own[at]
            first = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (q[1:] != q[:-1])))
            summed = np.add.reduceat(counts[at].astype(np.int64), first)
            seen[at] = np.repeat(summed, np.diff(np.append(first, len(at))))
            first, c = first[summed > 0], summed[summed > 0]
            owner, p = w[first], np.exp(parent[at[first]].astype(np.float64))
            np.add.at(g, owner, c * np.log(c / c_total[owner] / p))
            np.add.at(t, owner, 1)

        kind = np.where(c_total >= heavy, -1, np.where((g > slack * t) & (t > 0), t, 0)).astype(np.int32)
        ends_p, ends_c = np.cumsum(rows_p), np.cumsum(rows_c)
        kinds = kind[number]
        is_heavy = np.flatnonzero(kind < 0)
        sums = np.zeros(len(is_heavy), dtype=[("c", "u8"), ("g", "f8"), ("t", "i8")])
        sums["c"], sums["g"], sums["t"] = names[is_heavy], g[is_heavy], t[is_heavy]
        yield pa.record_batch(
            [
                pa.concat_arrays([cp, pa.array([-1], pa.int32())]),
                pa.concat_arrays([block, pa.array([-1], pa.int32())]),
                pa.array([*(squeeze(seen[e - n : e]) for e, n in zip(ends_p.tolist(), rows_p, strict=True)), sums.tobytes()], pa.binary()),
                pa.array([*(squeeze(kinds[e - n : e]) for e, n in zip(ends_c.tolist(), rows_c, strict=True)), b""], pa.binary()),
            ],
            names=["cp", "block", "seen", "kinds"],
        )

    return run


def gather(answers: pa.Table, level: int) -> tuple[np.ndarray, np.ndarray]:
    """This block's answers of one level, in the order of its entries and contexts."""
    own = answers.filter(pa.compute.equal(answers.column("level"), level)).sort_by("cp")
    seen = [unsqueeze(x.as_py(), np.uint32) for x in own.column("seen")]
    kinds = [unsqueeze(x.as_py(), np.int32) for x in own.column("kinds")]
    join = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
    return join(seen), join(kinds)


@dataclass
class Known:
    """Sums that reach the driver: a few numbers and at most `partitions` heavy contexts for each level."""

    n: int
    v: int
    heavy: float
    kept: list[dict[int, int]]  # for each level: heavy context -> T


def replay(block: Block, answers: pa.Table, levels: int, s: Settings, parts: int, known: Known | None):
    """Goes through the answered levels; (asks of the next level or None, counts of tokens, P0, P)."""
    level = block.base_level(parts)
    if not levels:
        return level, None, None, None
    seen, _ = gather(answers, 0)
    count = seen[level.entry]
    base = (count + 1.0) / (known.n + known.v + 1.0)
    prob, state = base.copy(), base.copy()
    times = np.where(block.tokens == END, 0, count)
    for k in range(1, levels + 1):
        if k > s.depth:
            break
        level = block.next_level(k, s.least, known.heavy, parts, s.salts, times, state)
        if k == levels:
            return level, count, base, prob
        seen, kinds = gather(answers, k)
        opens = np.append(True, (level.context[1:] != level.context[:-1]) | (level.cp[1:] != level.cp[:-1])) if len(level.pair) else np.zeros(0, bool)
        which = np.cumsum(opens) - 1
        t = kinds[which] if len(which) else kinds[:0]
        late = np.flatnonzero(t < 0)
        if len(late):
            t = t.copy()
            t[late] = [known.kept[k].get(x, 0) for x in level.context[late].tolist()]
        # a context that went leaves its parent's state
        p = np.where(t > 0, (seen + t * level.parent) / (level.total + t), level.parent)
        state = state.copy()
        state[level.where] = p[level.entry]
        prob = state
        own = np.zeros(len(block.tokens), dtype=np.int64)
        own[level.where] = seen[level.entry]
        times = np.where(block.tokens == END, 0, own)
    return None, count, base, prob


def _asks_of(known: Known | None, level: int, s: Settings, parts: int) -> Callable:
    if known is None:
        return lambda key, table: ask(replay(Block(table), None, 0, s, parts, None)[0], key[0].as_py(), True)

    def run(key, table, got):
        if not table.num_rows:
            return ask(Level(*(np.zeros(0, np.int64),) * 8), 0, True)
        return ask(replay(Block(table), got, level, s, parts, known)[0], key[0].as_py(), False)

    return run


def _scores_of(known: Known, s: Settings, parts: int) -> Callable:
    def run(key, table, got):
        if not table.num_rows:
            return pa.table({c: pa.array([], t) for c, t in OUT})
        block = Block(table)
        _, count, base, prob = replay(block, got, s.depth + 1, s, parts, known)
        add = lambda x: np.add.reduceat(x, block.at[:-1])
        n = len(block.at) - 1
        return pa.table(
            [
                block.table.column("doc_id"),
                block.table.column("held_out"),
                pa.array(np.diff(block.at)),
                pa.array(add((count > 0).astype(np.int64))),
                pa.array(np.full(n, known.n, dtype=np.int64)),
                pa.array(add(np.log10(base))),
                pa.array(add(np.log10(prob))),
            ],
            names=[c for c, _ in OUT],
        )

    return run


def score_texts(docs: DataFrame, modulus: int = 7, remainder: int = 2, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document.

    Learns from the rows whose crc32(doc_id as text) modulo `modulus` isn't
    `remainder`; a null id is held out.  Null and empty texts are one end.
    Repeated rows count as often as they stand; an empty table gives no rows;
    other columns are not read.  A text of any length is scored whole, in one
    block; contexts that diverge just as much as `slack` asks don't stay.
    """
    spark = docs.sparkSession
    ship(spark)
    s = settings
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", modulus, remainder).alias("held_out"), text.alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    parts, blocks = partitions(spark), max(1, -(-int(size) // s.block))
    rows = rows.withColumn("rid", F.xxhash64("doc_id", "text")).withColumn("block", F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int"))
    known: Known | None = None
    answers: DataFrame | None = None

    for level in range(s.depth + 1):
        asks = rows.groupBy("block").applyInArrow(_asks_of(None, 0, s, parts), ASKS) if answers is None else rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
            _asks_of(known, level, s, parts), ASKS
        )
        reply = answer_base if level == 0 else answer_level(known.heavy, s.slack, s.merge)
        got = materialize(asks.repartition(parts, "cp").mapInArrow(reply, ANSWERS).withColumn("level", F.lit(level)), f"answers-{level}", "lz4")
        sums = [bytes(r["seen"]) for r in got.where("block = -1").select("seen").toLocalIterator()]
        if level == 0:
            total = np.sum([np.frombuffer(x, dtype=np.int64) for x in sums], axis=0) if sums else np.zeros(2, np.int64)
            known = Known(int(total[0]), int(total[1]), max(float(s.least), float(total[0]) / parts), [{}])
        else:
            part = np.concatenate([np.zeros(0, dtype=[("c", "u8"), ("g", "f8"), ("t", "i8")]), *(np.frombuffer(x, dtype=[("c", "u8"), ("g", "f8"), ("t", "i8")]) for x in sums)])
            names, number = np.unique(part["c"], return_inverse=True)
            g, t = np.bincount(number, part["g"], len(names)), np.bincount(number, part["t"], len(names))
            stay = (g > s.slack * t) & (t > 0)
            known = Known(known.n, known.v, known.heavy, [*known.kept, dict(zip(names[stay].tolist(), t[stay].astype(int).tolist(), strict=True))])
        got = got.where("block >= 0")
        answers = got if answers is None else answers.unionByName(got)
        tidy(spark)

    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _scores_of(known, s, parts), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


OUT = [
    ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
    ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()),
]
