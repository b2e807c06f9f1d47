"""SentencePiece encoding and decoding with N-best segmentations.

Over the piece lattice of a text, forward Viterbi scores give the best way from
the start to every place.  They are an exact heuristic for an A* search that
walks backward from the end: paths leave the queue in the order of their total
scores, so the first N that reach the start are the N best.  A place that has
left the queue N times is not expanded again: every further path through it is
no better than the N that were taken up before.

No piece of a usual model has a word mark behind another character, so every
path through the lattice passes the places before word marks.  Texts are cut
there: each different unit is searched once, and the N best of a text are put
together from its units by the same best-first search over what each deviation
costs.  Only the N - 1 units with the cheapest deviations can take part.

Lattices, Viterbi scores and the cost of a unit's second best way are array
arithmetic over all new units of a slice at once; the A* search walks through
the few units that deviate.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ship
from .textblock import U64, slices

MARK = "▁"
LOW = float("-inf")
#: Units up to this many characters are scored side by side, longer ones one by one.
SIDE_BY_SIDE = 64
#: Characters whose lattices are held at once; a longer unit is held alone.
CHARACTERS = 1 << 17
#: Bytes of looked-up units that a worker keeps (about); then it starts anew.
KNOWN_BYTES = 64 << 20


@dataclass
class Lattice:
    """Edges of the lattices of several units, by length and then by their start.

    A unit of m characters has m + 1 places; a piece below 0 is the character -1 - piece, spelt in byte pieces.
    """

    first: np.ndarray  # first place of each unit, and the end
    start: np.ndarray
    end: np.ndarray
    score: np.ndarray
    piece: np.ndarray


class Rows:
    """A flat array that grows at its end."""

    def __init__(self, dtype):
        self.held, self.n = np.zeros(1024, dtype=dtype), 0

    def add(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.held):
            self.held = np.concatenate([self.held[: self.n], np.zeros(self.n + len(x), dtype=self.held.dtype)])
        self.held[self.n : self.n + len(x)] = x
        self.n += len(x)


class Known:
    """The units looked up so far: score, cost of the second best way, and ids of each by number."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.score, self.cost, self.count, self.ids = Rows(np.float64), Rows(np.float64), Rows(np.int32), Rows(np.uint32)
        self.begin = Rows(np.int64)
        self.ways: dict[str, list[tuple[float, np.ndarray]]] = {}
        self.bytes = 0


class PieceModel:
    """Pieces and scores of a model file; characters that no piece covers become byte pieces with a penalty."""

    def __init__(self, path: str, n: int):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n = n
        self.scores: dict[str, tuple[float, int]] = {}
        self.bytes = [0] * 256
        surface: list[bytes] = []
        low = 0.0
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:-1], 16)] = i
                surface.append(bytes([int(piece[3:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                surface.append(b"")
            else:
                self.scores[piece] = (sp.get_score(i), i)
                low = min(low, sp.get_score(i))
                surface.append(piece.encode())
        self.penalty = low - 10.0
        self.whole = any(MARK in p.lstrip(MARK) for p in self.scores)
        self.units = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.normalize = sp.normalize
        self.prefixed = sp.normalize("a").startswith(MARK)  # the model puts a mark before every text
        self.widths = np.array([len(x) for x in surface], dtype=np.int64)
        self.flat = np.frombuffer(b"".join(surface), dtype=np.uint8)
        self.at = np.cumsum(self.widths) - self.widths
        self.rounds = [0x9E3779B97F4A7C15]  # multipliers of the hash table
        self._grow()
        self.known = Known()

    def _grow(self) -> None:
        """The tree of pieces: a table of open addressing from (node, character) to a node; node 0 is the root."""
        number: dict[tuple[int, int], int] = {}
        worth: list[tuple[float, int]] = [(np.nan, 0)]
        for piece, own in self.scores.items():
            node = 0
            for c in piece:
                key = (node, ord(c))
                node = number.get(key, 0)
                if not node:
                    node = number[key] = len(worth)
                    worth.append((np.nan, 0))
            worth[node] = own
        keys = np.array([a << 21 | c for a, c in number], dtype=np.int64)
        to = np.array(list(number.values()), dtype=np.int64)
        self.bits = max(8, len(keys).bit_length() + 3)
        self.keys, self.to = np.full(1 << self.bits, -1, dtype=np.int64), np.zeros(1 << self.bits, dtype=np.int64)
        while len(keys):
            slot = self._slot(keys)
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]  # of several the last one stays
            won = self.keys[slot] == keys
            self.to[slot[won]] = to[won]
            keys, to = keys[~won], to[~won]
            if len(keys):  # the others go to the next multiplier's slots
                self.rounds.append(self.rounds[-1] * 0x2545F4914F6CDD1D % (1 << 64))
        self.node_score = np.array([w[0] for w in worth])
        self.node_piece = np.array([w[1] for w in worth], dtype=np.int64)
        self.branches = np.zeros(len(worth), dtype=bool)
        self.branches[[a for a, _ in number]] = True

    def _slot(self, keys: np.ndarray, turn: int = -1) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(U64) * U64(self.rounds[turn])) >> U64(64 - self.bits)).astype(np.int64)

    def _step(self, keys: np.ndarray) -> np.ndarray:
        """The node behind each (node, character), 0 for none."""
        out = np.zeros(len(keys), dtype=np.int64)
        left = np.arange(len(keys))
        for turn in range(len(self.rounds)):
            slot = self._slot(keys[left], turn)
            there = self.keys[slot]
            hit = there == keys[left]
            out[left[hit]] = self.to[slot[hit]]
            left = left[~hit & (there >= 0)]  # an empty slot: the key would have found room there
            if not len(left):
                break
        return out

    def lattice(self, units: list[str]) -> Lattice:
        size = np.array([len(u) for u in units], dtype=np.int64)
        chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(size + 1)])
        place = np.arange(len(chars)) + np.repeat(np.arange(len(units)), size)  # of each character
        stop = np.repeat(np.cumsum(size), size)  # where its unit's characters end
        at, node, far = np.arange(len(chars)), np.zeros(len(chars), dtype=np.int64), 0
        starts, ends, scores, pieces = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)]
        while len(at):
            node = self._step(node << 21 | chars[at + far])
            score = self.node_score[node]
            piece = self.node_piece[node]
            if not far:  # a character that is no piece stands alone at a penalty
                alone = np.isnan(score)
                piece = np.where(alone, -1 - chars, piece)
                score = np.where(alone, self.penalty, score)
            own = np.flatnonzero(~np.isnan(score))
            starts.append(place[at[own]])
            ends.append(starts[-1] + far + 1)
            scores.append(score[own])
            pieces.append(piece[own])
            far += 1
            go = np.flatnonzero(self.branches[node] & (node > 0) & (at + far < stop[at]))
            at, node = at[go], node[go]
        return Lattice(first, *(np.concatenate(x) for x in (starts, ends, scores, pieces)))

    def first_two(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each unit its best score, what the second best way costs more, the number of ids; and all ids."""
        g = self.lattice(units)
        k = len(units)
        sizes = np.diff(g.first) - 1
        best = np.full(int(g.first[-1]), LOW)
        best[g.first[:-1]] = 0.0
        behind = np.full(len(best), LOW)
        behind[g.first[1:] - 1] = 0.0
        taken = np.full(len(best), -1, dtype=np.int64)
        if k == 1 and sizes[0] > SIDE_BY_SIDE:
            self._walk(g, best, taken, behind)
        elif len(g.start):
            self._sweep(g, best, taken, behind)
        through = best[g.start] + g.score + behind[g.end]  # the best way over each edge
        who, step, path = [], [], []
        live = np.flatnonzero(sizes > 0)
        at = g.first[1:][live] - 1
        while len(live):
            edge = taken[at]
            through[edge] = LOW
            who.append(live)
            step.append(np.full(len(live), len(step)))
            path.append(edge)
            at = g.start[edge]
            go = at > g.first[live]
            live, at = live[go], at[go]
        second = np.full(len(best), LOW)  # by place, then by unit
        np.maximum.at(second, g.end, through)
        second = np.maximum.reduceat(second, g.first[:-1])
        total = best[g.first[1:] - 1]
        none = np.zeros(0, np.int64)
        who, step, path = (np.concatenate([none, *x]) for x in (who, step, path))
        order = np.argsort(who * (len(best) + 1) - step)
        flat, each = self.spell(g.piece[path[order]])
        return total, total - second, np.bincount(who[order], each, k).astype(np.int32), flat

    def spell(self, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each piece has): characters below 0 become their byte pieces."""
        each = np.ones(len(piece), dtype=np.int64)
        if not len(piece) or piece.min() >= 0:
            return piece.astype(np.uint32), each
        odd = np.flatnonzero(piece < 0)
        spelt = [[self.bytes[b] for b in chr(-1 - c).encode("utf-8", "surrogatepass")] for c in piece[odd].tolist()]
        each[odd] = [len(x) for x in spelt]
        flat = np.repeat(piece, each)
        begin = np.cumsum(each) - each
        for i, ids in zip(begin[odd].tolist(), spelt, strict=True):
            flat[i : i + len(ids)] = ids
        return flat.astype(np.uint32), each

    def _sweep(self, g: Lattice, best: np.ndarray, taken: np.ndarray, behind: np.ndarray) -> None:
        """Viterbi forward and backward over all units at once.

        Edges of one length that end equally far from their units' starts touch
        every place once, so they are taken up together; of equal ways the one
        over the longest last edge counts.
        """
        length = g.end - g.start
        longest = int(length.max())
        unit = np.repeat(np.arange(len(g.first) - 1), np.diff(g.first))
        key = (g.end - g.first[unit[g.end]]) * (longest + 1) + longest - length
        order = np.argsort(key.astype(np.uint16) if int(key.max()) < 1 << 16 else key, kind="stable")
        cuts = np.flatnonzero(np.append(True, np.diff(key[order]) != 0)).tolist()
        groups = [order[a:b] for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True)]
        for e in groups:
            end = g.end[e]
            way = best[g.start[e]] + g.score[e]
            up = np.flatnonzero(way > best[end])
            best[end[up]] = way[up]
            taken[end[up]] = e[up]
        for e in groups[::-1]:
            start = g.start[e]
            behind[start] = np.maximum(behind[start], behind[g.end[e]] + g.score[e])

    def _walk(self, g: Lattice, best: np.ndarray, taken: np.ndarray, behind: np.ndarray) -> None:
        """The same for one long unit, edge by edge."""
        ahead, back, by = best.tolist(), behind.tolist(), taken.tolist()
        order = np.lexsort((g.start, g.end))
        start, end, score = g.start[order].tolist(), g.end[order].tolist(), g.score[order].tolist()
        for i, a, b, s in zip(order.tolist(), start, end, score, strict=True):
            if ahead[a] + s > ahead[b]:
                ahead[b], by[b] = ahead[a] + s, i
        for i in range(len(start) - 1, -1, -1):
            if back[end[i]] + score[i] > back[start[i]]:
                back[start[i]] = back[end[i]] + score[i]
        best[:], taken[:], behind[:] = ahead, by, back

    def search(self, units: list[str], n: int) -> list[list[tuple[float, np.ndarray]]]:
        """For each unit its n best segmentations (score, ids), best first.

        Of equal totals the one nearest to the start goes on first, so equal
        scores come in an order that depends on the unit alone.
        """
        g = self.lattice(units)
        order = np.lexsort((g.start, g.end))
        upto = np.searchsorted(g.end[order], np.arange(int(g.first[-1]) + 1)).tolist()
        start, score, piece = g.start[order].tolist(), g.score[order].tolist(), g.piece[order]
        best = [LOW] * int(g.first[-1])
        for a in g.first[:-1].tolist():
            best[a] = 0.0
        for a, b, s in zip(start, g.end[order].tolist(), score, strict=True):
            if best[a] + s > best[b]:
                best[b] = best[a] + s
        push, pop = heapq.heappush, heapq.heappop
        out = []
        for first, last in zip(g.first[:-1].tolist(), (g.first[1:] - 1).tolist(), strict=True):
            found: list[tuple[float, np.ndarray]] = []
            left = [0] * (last - first + 1)  # how often a place has left the queue
            # (minus total, place, order, score from here to the end, path from here)
            queue: list = [(-best[last], last, 0, 0.0, None)]
            turn = 0
            while queue:
                _, place, _, far, path = pop(queue)
                if left[place - first] == n:
                    continue
                left[place - first] += 1
                if place == first:
                    edges = []
                    while path is not None:
                        edges.append(path[0])
                        path = path[1]
                    found.append((far, self.spell(piece[edges] if edges else piece[:0])[0]))
                    if len(found) == n:
                        break
                    continue
                for e in range(upto[place], upto[place + 1]):
                    if left[start[e] - first] < n:
                        turn += 1
                        push(queue, (-best[start[e]] - far - score[e], start[e], turn, far + score[e], (e, path)))
            out.append(found)
        return out

    def _in_parts(self, units: list[str]) -> Iterator[list[str]]:
        """Some characters at a time; long units one by one."""
        units = sorted(units, key=len)
        at = 0
        while at < len(units):
            to, size = at, 0
            while to < len(units) and (to == at or (size + len(units[to]) <= CHARACTERS and len(units[to]) <= SIDE_BY_SIDE)):
                size += len(units[to])
                to += 1
            yield units[at:to]
            at = to

    def encode_all(self, texts: list[str]) -> Iterator[list[tuple[float, np.ndarray]]]:
        """For each whole text its n best segmentations (fewer, if there aren't n)."""
        if self.known.bytes > KNOWN_BYTES:
            self.known = Known()
        known = self.known
        every: list[str] = []
        upto = [0]
        for text in texts:
            normal = self.normalize(text)
            every += [normal] if self.whole and normal else self.units.findall(normal)
            upto.append(len(every))
        for part in self._in_parts([u for u in set(every) if u not in known.number]):
            score, cost, count, ids = self.first_two(part)
            known.number.update(zip(part, range(known.score.n, known.score.n + len(part)), strict=True))
            known.begin.add(known.ids.n + np.cumsum(count) - count)
            for rows, x in ((known.score, score), (known.cost, cost), (known.count, count), (known.ids, ids)):
                rows.add(x)
            known.bytes += 200 * len(part) + sum(map(len, part)) + 4 * len(ids)
        number = np.fromiter(map(known.number.__getitem__, every), dtype=np.int64, count=len(every))
        cost, score = known.cost.held[number], known.score.held[number]
        cheap = []
        for a, b in zip(upto[:-1], upto[1:], strict=True):
            own = np.argsort(cost[a:b], kind="stable")[: self.n - 1]
            cheap.append([a + k for k in own.tolist() if np.isfinite(cost[a + k])])
        for part in self._in_parts(list({every[k] for own in cheap for k in own} - known.ways.keys())):
            for unit, ways in zip(part, self.search(part, self.n), strict=True):
                known.ways[unit] = ways
                known.bytes += 300 + sum(150 + 4 * len(ids) for _, ids in ways)
        for a, b, own in zip(upto[:-1], upto[1:], cheap, strict=True):
            count = known.count.held[number[a:b]].astype(np.int64)
            begin = np.cumsum(count) - count
            first = known.ids.held[np.repeat(known.begin.held[number[a:b]] - begin, count) + np.arange(int(count.sum()))]
            yield self._together(float(score[a:b].sum()), first, [(k - a, int(begin[k - a]), int(begin[k - a] + count[k - a]), known.ways[every[k]]) for k in own])

    def encode(self, text: str) -> list[tuple[float, np.ndarray]]:
        return next(iter(self.encode_all([text])))

    def _together(self, total: float, first: np.ndarray, cheap: list[tuple[int, int, int, list]]) -> list[tuple[float, np.ndarray]]:
        """The n best of a text: first are the ids of the best, cheap has (unit, its range of ids, its ways).

        Equal scores come in the order in which the deviations are found.
        """
        out = [(total, first)]
        if not cheap:
            return out
        costs = [[ways[0][0] - score for score, _ in ways] for *_, ways in cheap]
        start = (0,) * len(cheap)
        queue, seen = [(0.0, start)], {start}
        while queue and len(out) <= self.n:
            cost, pick = heapq.heappop(queue)
            if pick != start:
                parts, upto = [], 0
                for _, a, b, ids in sorted((cheap[j][0], *cheap[j][1:3], cheap[j][3][i][1]) for j, i in enumerate(pick) if i):
                    parts += [first[upto:a], ids]
                    upto = b
                out.append((total - cost, np.concatenate([*parts, first[upto:]])))
            for j, i in enumerate(pick):
                if i + 1 < len(costs[j]):
                    more = (*pick[:j], i + 1, *pick[j + 1 :])
                    if more not in seen:
                        seen.add(more)
                        heapq.heappush(queue, (cost - costs[j][i] + costs[j][i + 1], more))
        return out[: self.n]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text that the ids stand for; word marks become spaces, the mark that the model puts before every text goes."""
        w = self.widths[ids]
        body = self.flat[np.repeat(self.at[ids] - (np.cumsum(w) - w), w) + np.arange(int(w.sum()))].tobytes()
        mark = MARK.encode()
        return (body[len(mark) :] if self.prefixed and body.startswith(mark) else body).replace(mark, b" ")


_MODELS: dict[tuple[str, int], PieceModel] = {}


def model_of(path: str, n: int) -> PieceModel:
    """One model for each Python worker."""
    if (path, n) not in _MODELS:
        _MODELS[path, n] = PieceModel(path, n)
    return _MODELS[path, n]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def _segmented(batches: Iterator[pa.RecordBatch], model: PieceModel) -> Iterator[tuple[list, list[int], list[float], list[np.ndarray]]]:
    """Columns doc_id, rank, score and ids, for some texts at a time."""
    for batch in slices(batches, limit=1 << 18):
        doc_ids, ranks, scores, every = [], [], [], []
        texts = [x or "" for x in batch.column("text").to_pylist()]
        for doc_id, ways in zip(batch.column("doc_id").to_pylist(), model.encode_all(texts), strict=True):
            for rank, (score, ids) in enumerate(ways, 1):
                doc_ids.append(doc_id)
                ranks.append(rank)
                scores.append(float(score))
                every.append(ids)
        yield doc_ids, ranks, scores, every


def encode(docs: DataFrame, model_path: str, n: int = 4) -> DataFrame:
    """doc_id, rank (from 1), score, ids: the n best segmentations of every whole text; texts without pieces have one, empty.

    A null text counts as empty.  A null doc_id stays null, repeated rows are
    encoded alike, an empty table gives no rows; other columns are not read.
    Equal scores are ranked by the search alone, so a text is always ranked the
    same way.  A text of any length is encoded whole, in memory that grows with
    its units; a unit without a word mark inside takes time in proportion to
    its length, whatever it repeats.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, ranks, scores, every in _segmented(batches, model_of(model_path, n)):
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in every])]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint32), *every]).astype(np.int32)
            yield pa.record_batch(
                [pa.array(doc_ids, pa.int64()), pa.array(ranks, pa.int32()), pa.array(scores, pa.float64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                names=["doc_id", "rank", "score", "ids"],
            )

    return _texts(docs).mapInArrow(run, "doc_id long, rank int, score double, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """encoded (doc_id, rank, score, ids) with n_pieces, ids_crc32 and the decoded text in place of the ids.

    Null ids count as none; a word mark U+2581 of the text itself decodes to a space.
    """
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(model_path, 1)
        for batch in batches:
            step = 64
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids = [np.asarray(x.values.to_numpy(), dtype=np.uint32) if x.is_valid else np.zeros(0, np.uint32) for x in part.column("ids")]
                yield pa.record_batch(
                    [
                        *(part.column(c) for c in ("doc_id", "rank", "score")),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                        pa.array([model.decode(x) for x in ids], pa.binary()),
                    ],
                    names=["doc_id", "rank", "score", "n_pieces", "ids_crc32", "decoded"],
                )

    return encoded.mapInArrow(run, "doc_id long, rank int, score double, n_pieces long, ids_crc32 long, decoded binary")


def round_trip(docs: DataFrame, model_path: str, n: int = 4) -> DataFrame:
    """doc_id, rank, score, n_pieces, ids_crc32, decoded_sha256: encode, decode and digest in one pass of one worker.

    The same as encode, decode and the SHA-256 of the decoded bytes, without the
    ids and texts of every way on the road.  Odd rows are as in encode.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(model_path, n)
        for doc_ids, ranks, scores, every in _segmented(batches, model):
            yield pa.record_batch(
                [
                    pa.array(doc_ids, pa.int64()),
                    pa.array(ranks, pa.int32()),
                    pa.array(scores, pa.float64()),
                    pa.array([len(x) for x in every], pa.int64()),
                    pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in every], pa.int64()),
                    pa.array([hashlib.sha256(model.decode(x)).hexdigest() for x in every]),
                ],
                names=["doc_id", "rank", "score", "n_pieces", "ids_crc32", "decoded_sha256"],
            )

    return _texts(docs).mapInArrow(run, "doc_id long, rank int, score double, n_pieces long, ids_crc32 long, decoded_sha256 string")
