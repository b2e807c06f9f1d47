"""N-gram Jaccard join: a grouped prefix join over sets of word shingles.

* Sets are compared in one global order: shingles that many documents have come
  last (frequencies come from a count sketch of a fixed size over all
  documents), ties by hash.  Any order gives the same links; this one keeps
  common passages out of the prefixes.
* Two sets of similarity t share a shingle in their prefixes, the first
  n - ceil(t n) + 1 shingles.  Documents with the same size and prefix are one
  group; groups, not documents, go into the posting lists, filtered by size and
  position.
* Lists of up to `small` groups give all their pairs.  A longer list gives each
  group its first fitting group only; later, when most of the
  list is known to be one component, just the pairs between different
  components.  So copies by the thousand cost a star, and no link between
  components is missed.
* Group pairs are expanded to members and verified on whole sets: one star of
  sets for each left member, split where a star is large.

Equal sets are one member throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sketch
from .chunks import keyed
from .components import components
from .shared import discard, materialize, partitions, scope, ship, tidy
from .textblock import U64, Words, column_bytes, gram_hashes, mix64, slices


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the sorted distinct shingles of each text; texts of fewer words have their whole sequence as one."""
    words = Words(buf, offsets, lower=True)
    n = len(offsets) - 1
    h = words.hashes()
    grams = gram_hashes(h, size)
    full = np.maximum(words.count - size + 1, 0)
    begin = np.cumsum(full) - full
    at = np.repeat(words.first[:-1] - begin, full) + np.arange(int(full.sum()))
    owner = np.repeat(np.arange(n), full)
    value = grams[at] if len(at) else np.zeros(0, U64)
    short = np.flatnonzero((words.count > 0) & (words.count < size))
    extra = np.zeros(len(short), U64)
    with np.errstate(over="ignore"):
        for j, i in enumerate(short.tolist()):
            x = U64(words.count[i])
            for w in h[words.first[i] : words.first[i + 1]]:
                x = x * U64(0x9E3779B97F4A7C15) + w
            extra[j] = x
    owner, value = np.concatenate([owner, short]), np.concatenate([value, mix64(extra)])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.append(True, (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])) if len(owner) else np.zeros(0, bool)
    owner, value = owner[new], value[new]
    return value, np.searchsorted(owner, np.arange(n + 1))


def _sums(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, U64), np.cumsum(x, dtype=U64)])
        return total[at[1:]] - total[at[:-1]]


def set_keys(value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set."""
    with np.errstate(over="ignore"):
        return mix64(_sums(mix64(value ^ U64(0x5851F42D4C957F2D)), at) + np.diff(at).astype(U64) * U64(0x9E3779B97F4A7C15)).astype(np.int64)


def survey(rows: DataFrame, size: int) -> DataFrame:
    """One pass over the texts: for each row its set's size and key; for each task its part of the count sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.cells()
        for batch in slices(batches, limit=1 << 19):
            value, at = shingle_sets(*column_bytes(batch.column("text")), size)
            sketch.add(counts, value)
            n = batch.num_rows
            yield pa.record_batch(
                [batch.column("rid"), batch.column("doc_id"), pa.array(np.diff(at)), pa.array(set_keys(value, at)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                names=["rid", "doc_id", "n", "unit", "slice", "counts"],
            )
        used, parts = sketch.pieces(counts)
        yield pa.record_batch([*(pa.nulls(len(used), pa.int64()) for _ in range(4)), used, parts], names=["rid", "doc_id", "n", "unit", "slice", "counts"])

    return rows.mapInArrow(run, "rid long, doc_id long, n long, unit long, slice int, counts binary")


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -(-percent * n // 100) + 1


def postings(rows: DataFrame, size: int, percent: int, levels: np.ndarray, tokens: bool) -> DataFrame:
    """With tokens (token, gid, n, place) for each shingle of each group's prefix, else (unit, gid, n, rid, last) of each row with words.

    last is the place of the prefix's last shingle in the global order.
    """
    shared = rows.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        done: set[int] = set()  # groups whose postings this task has given
        for batch in slices(batches, limit=1 << 19):
            value, at = shingle_sets(*column_bytes(batch.column("text")), size)
            n = np.diff(at)
            doc = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((value, sketch.level(levels, value), doc))
            value = value[order]
            place = np.arange(len(value)) - np.repeat(at[:-1], n)
            length = np.where(n > 0, prefix_length(n, percent), 0)
            keep = place < length[doc]
            with np.errstate(over="ignore"):
                picked = np.where(keep, mix64(value + (place.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15)), U64(0))
                gid = mix64(_sums(picked, at) + n.astype(U64) * U64(0xD6E8FEB86659FD93)).astype(np.int64)
            if not tokens:
                full = np.flatnonzero(n > 0)
                unit = set_keys(value, at)  # a sum: the order within a text doesn't matter
                end = value[(at[:-1] + length - 1)[full]]
                last = (sketch.level(levels, end).astype(np.int64) << 48) | (end >> U64(16)).astype(np.int64)
                yield pa.record_batch(
                    [pa.array(unit[full]), pa.array(gid[full]), pa.array(n[full].astype(np.int32)), batch.column("rid").take(pa.array(full)), pa.array(last)],
                    names=["unit", "gid", "n", "rid", "last"],
                )
                continue
            fresh = np.zeros(len(n), dtype=bool)
            for i, g in enumerate(gid.tolist()):
                if n[i] and g not in done:
                    fresh[i] = True
                    if len(done) < 1 << 20:
                        done.add(g)
            keep &= fresh[doc]
            yield pa.record_batch(
                [pa.array(value[keep].astype(np.int64)), pa.array(gid[doc[keep]]), pa.array(n[doc[keep]].astype(np.int32)), pa.array(place[keep].astype(np.int32))],
                names=["token", "gid", "n", "place"],
            )

    return rows.mapInArrow(run, "token long, gid long, n int, place int" if tokens else "unit long, gid long, n int, rid long, last long")


def fits(na: np.ndarray, ia: np.ndarray, nb: np.ndarray, ib: np.ndarray, percent: int) -> np.ndarray:
    """Size and position filter: whether sets of na and nb shingles that first meet at places ia and ib can be similar."""
    least = -(-percent * (na + nb) // (100 + percent))
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (np.minimum(na - ia, nb - ib) >= least)


def list_pairs(lists: DataFrame, percent: int, small: int, block: int = 1 << 16) -> DataFrame:
    """Pairs of groups (a, b) from sorted posting lists, `shared` 1 in short lists, and 2 more where they fit; rows with a token are members of long lists.

    Rows with an a alone count in how many lists with others a group is (in one partition).

    Lists stream through: of a list of more than `block` members that goes on,
    its first member and the last one are kept, never the whole list.
    """
    block = max(block, small)  # so that a list that was streamed is a long one

    def give(matched, token, gid, n, place, longer):
        opens = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        size = np.diff(np.append(opens, len(token)))
        if longer is not None and len(size):
            size = size.copy()
            size[0] += longer
        run = np.repeat(np.arange(len(opens)), np.diff(np.append(opens, len(token))))
        long = size[run] > small
        a, b, whole = [], [], []
        for d in range(1, small):
            # long lists: neighbours too, for one token in eight, so that there are other partners than the first
            i = np.flatnonzero((token[d:] == token[:-d]) & (~long[d:] | ((d == 1) & (token[d:] & 7 == 0))))
            a.append(i)
            b.append(i + d)
            whole.append(~long[i + d])
        # in a long list: the first member that is not too short
        for r in np.flatnonzero(size > small).tolist():
            o, e = opens[r], opens[r + 1] if r + 1 < len(opens) else len(token)
            own = np.arange(o, e)
            first = o + np.searchsorted(n[o:e], -(-percent * n[o:e] // 100))
            a.append(first[first < own])
            b.append(own[first < own])
            whole.append(np.zeros(len(a[-1]), dtype=bool))
        a, b, whole = np.concatenate(a), np.concatenate(b), np.concatenate(whole)
        # a pair of a short list counts what it shares even where it doesn't fit, but must fit somewhere
        fit = fits(n[a], place[a], n[b], place[b], percent)
        ok = np.where(whole, 100 * n[a] >= percent * n[b], fit) & (gid[a] != gid[b])
        matched.append(gid[size[run] > 1])
        return gid[a[ok]], gid[b[ok]], whole[ok] + 2 * fit[ok], long

    def out(pair_a, pair_b, whole, token, gid, n, place):
        k, m = len(pair_a), len(token)
        ints = lambda x: pa.concat_arrays([pa.nulls(k, pa.int32()), pa.array(x.astype(np.int32))])
        return pa.record_batch(
            [
                pa.concat_arrays([pa.array(pair_a), pa.nulls(m, pa.int64())]),
                pa.concat_arrays([pa.array(pair_b), pa.nulls(m, pa.int64())]),
                pa.concat_arrays([pa.array(whole.astype(np.int32)), pa.nulls(m, pa.int32())]),
                pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(token)]),
                pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(gid)]),
                ints(n),
                ints(place),
            ],
            names=["a", "b", "shared", "token", "gid", "n", "place"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # the list that the last batch ended in
        streamed: int | None = None  # its members that have been given already
        matched: list[np.ndarray] = []  # groups of lists that aren't theirs alone: no more than the partition's rows

        def close(cols, longer):
            x, y, whole, long = give(matched, *cols, longer)
            skip = 0 if longer is None else 2  # first and last member of what was given before
            long = long.copy()
            long[:skip] = False
            return out(x, y, whole, *(c[long] for c in cols))

        for batch in batches:
            cols = [batch.column(c).to_numpy().astype(np.int64) for c in ("token", "gid", "n", "place")]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            # the same group twice in a list, from two tasks
            same = np.append(False, (cols[0][1:] == cols[0][:-1]) & (cols[1][1:] == cols[1][:-1]))
            if streamed is not None:
                same[:2] = False
            if same.any():
                cols = [c[~same] for c in cols]
            cut = int(np.searchsorted(cols[0], cols[0][-1])) if len(cols[0]) else 0
            if cut:
                yield close([c[:cut] for c in cols], streamed)
                streamed = None
            held = [c[cut:] for c in cols]
            if len(held[0]) > block:
                yield close(held, streamed)
                streamed = (streamed or 0) + len(held[0])
                held = [c[[0, -1]] for c in held]
        if held is not None and len(held[0]):
            yield close(held, streamed)
        if matched:
            who, times = np.unique(np.concatenate(matched), return_counts=True)
            none = np.zeros(0, np.int64)
            counted = out(who, who, times, none, none, none, none)
            yield counted.set_column(1, "b", pa.nulls(len(who), pa.int64()))

    return lists.mapInArrow(run, "a long, b long, shared int, token long, gid long, n int, place int")


def enough(shared: Column, x: str, y: str, percent: int) -> Column:
    """Whether two groups (structs n, last) can be similar if their prefixes share no more than that.

    What is common beyond is in the rest of the set whose prefix ends first in
    the global order.
    """
    na, nb = F.col(f"{x}.n"), F.col(f"{y}.n")
    least = F.ceil(percent * (na + nb) / (100 + percent))
    rest = F.ceil(percent * F.when(F.col(f"{x}.last") <= F.col(f"{y}.last"), na).otherwise(nb) / 100) - 1
    return shared + rest >= least


def verify(rows: DataFrame, units: DataFrame, pairs: DataFrame, size: int, percent: int, star: int = 256) -> DataFrame:
    """The pairs of units (a, b) whose whole sets are similar.

    Sets of one a's partners meet a's set in stars of about `star` sets; a star
    is read as a stream, with a's set in memory and no other.  A unit that is
    the partner of very many others has its goals in several rows, each with
    about `star` of them.
    """
    spark = rows.sparkSession
    pairs = pairs.select("a", "b").distinct()
    arms = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / star).cast("int").alias("arms"))
    spread = pairs.join(arms, "a").select("b", "a", F.pmod(F.xxhash64("b"), F.col("arms")).cast("int").alias("arm"))
    often = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / star).cast("int").alias("often")).where("often > 1")
    goals = spread.join(often, "b", "left").select(
        F.col("b").alias("unit"), F.col("a").alias("centre"), "arm", F.lit(1).alias("role"), F.coalesce(F.pmod(F.xxhash64("a"), F.col("often")).cast("int"), F.lit(0)).alias("part")
    ).unionByName(
        arms.select(F.col("a").alias("unit"), F.col("a").alias("centre"), F.explode(F.sequence(F.lit(0), F.col("arms") - 1)).alias("arm"), F.lit(0).alias("role"))
        .withColumn("part", F.floor(F.col("arm") / star).cast("int"))
    )
    goals = goals.join(units.select("unit", "rid"), "unit").groupBy("rid", "unit", "part").agg(F.collect_list(F.struct("centre", "arm", "role")).alias("goals"))

    def make_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, given = None, set()
        for batch in slices(batches, limit=1 << 19):
            # rows that repeat id and text stand next to each other after the join: one of them is enough
            fresh = []
            for rid, part in zip(batch.column("rid").to_pylist(), batch.column("part").to_pylist(), strict=True):
                if rid != last:
                    last, given = rid, set()
                fresh.append(part not in given)
                given.add(part)
            batch = batch.filter(pa.array(fresh))
            if not batch.num_rows:
                continue
            value, at = shingle_sets(*column_bytes(batch.column("text")), size)
            goals = batch.column("goals")
            row = np.repeat(np.arange(batch.num_rows), np.asarray(goals.value_lengths()))
            flat = goals.flatten()
            blobs = [value[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            step = max(1, (1 << 22) // max(1, max(map(len, blobs), default=1)))
            for i in range(0, len(row), step):
                own = row[i : i + step]
                part = flat.slice(i, step)
                yield pa.record_batch(
                    [part.field("centre"), part.field("arm"), part.field("role"), batch.column("unit").take(pa.array(own)), pa.array([blobs[r] for r in own.tolist()], pa.binary())],
                    names=["centre", "arm", "role", "unit", "shingles"],
                )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, own = None, np.zeros(0, U64)
        for batch in batches:
            a, b = [], []
            for centre, arm, role, unit, blob in zip(
                *(batch.column(c).to_pylist() for c in ("centre", "arm", "role", "unit")), batch.column("shingles"), strict=True
            ):
                s = np.frombuffer(blob.as_buffer(), dtype=U64)
                if role == 0:
                    here, own = (centre, arm), s.copy()
                elif here == (centre, arm):
                    i = np.searchsorted(own, s)
                    both = int((own[np.minimum(i, len(own) - 1)] == s).sum())
                    if 100 * both >= percent * (len(own) + len(s) - both):
                        a.append(centre)
                        b.append(unit)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    stars = (
        rows.join(goals, "rid")
        .mapInArrow(make_sets, "centre long, arm int, role int, unit long, shingles binary")
        .repartition(partitions(spark), "centre", "arm")
        .sortWithinPartitions("centre", "arm", "role")
    )
    return stars.mapInArrow(compare, "a long, b long").distinct()


ABOUT = ("unit", "gid", "n", "listed", "matched", "last")


def open_keys(members: DataFrame, key: str) -> DataFrame:
    """(key, main, pairs) of the keys whose units are in several components: the largest one, and how many pairs have an end outside of it."""
    sizes = members.groupBy(key, "root").count()
    most = sizes.groupBy(key).agg(
        F.max_by("root", F.struct("count", "root")).alias("main"), F.count(F.lit(1)).alias("roots"), F.sum("count").alias("all"), F.max("count").alias("most")
    )
    return most.where("roots > 1").select(key, "main", "all", ((F.col("all") - F.col("most")) * F.col("all")).cast("double").alias("pairs"))


def can_be_similar(percent: int, alike: bool) -> Column:
    """Size and place filter for members x and y (structs ABOUT), at place_x and place_y of the lists in which they meet.

    alike: the units' prefixes are the same; else no more can be shared than the
    less matched one has, and a pair is met where it first shares a token, so
    nothing is lost where both come from the same token before.
    """
    na, ia, nb, ib = F.col("x.n"), F.col("place_x"), F.col("y.n"), F.col("place_y")
    similar = (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (F.least(na - ia, nb - ib) * (100 + percent) >= percent * (na + nb))
    if not alike:
        similar &= F.coalesce(F.col("before_x") != F.col("before_y"), F.lit(True))
        similar &= (F.col("x.gid") != F.col("y.gid")) & enough(F.least("x.matched", "y.matched"), "x", "y", percent)
    return similar


def sides(members: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The members of each key as x and as y."""
    one = lambda s: members.select(key, F.struct(*ABOUT).alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("root", "place", "before")))
    return one("x"), one("y")


def across(members: DataFrame, key: str, percent: int, alike: bool) -> DataFrame:
    """Pairs (x, y) of units with one `key` whose components differ; the left one's group comes first in (n, gid).

    members: key, root, place, before (the group's last long-listed token ahead
    of this one) and ABOUT.  The largest component of each key is set aside:
    every pair between components has a member outside of it.
    """
    open_members = members.join(open_keys(members, key), key)
    left, right = sides(open_members.where("root <> main"), key)[0], sides(open_members, key)[1]
    first = F.struct("x.n", "x.gid", "x.unit") <= F.struct("y.n", "y.gid", "y.unit")
    return (
        left.join(right, (left[key] == right[key]) & (F.col("root_x") != F.col("root_y")) & can_be_similar(percent, alike))
        .select(F.when(first, F.col("x")).otherwise(F.col("y")).alias("x"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("y"))
        .distinct()
    )


def partners(members: DataFrame, key: str, percent: int, alike: bool, turn: int) -> DataFrame:
    """(a, b, central, pairs): every member outside of its key's main component with three others that it can be similar to.

    These are the most central member of the main component (of whose prefix
    the largest part stands in lists: a set that differs little from the others
    of its kind), a drawn one, and the most central of those outside.  `pairs`
    is, for the drawn ones, the number of members that each stands for: their
    sum says about how many pairs there are.
    """
    open_members = members.join(open_keys(members, key), key)
    drawn = F.xxhash64("unit", F.lit(turn))
    central = F.col("matched") / F.col("n")
    outside = F.col("root") != F.col("main")
    y = F.struct(F.struct(*ABOUT).alias("y"), F.col("root").alias("root_y"), F.col("place").alias("place_y"), F.col("before").alias("before_y"), central.alias("central"))
    by = F.struct(central, drawn)
    hubs = open_members.groupBy(key).agg(
        F.max_by(y, F.when(~outside, by)).alias("inner"), F.max_by(y, F.when(~outside, drawn)).alias("any"), F.max_by(y, F.when(outside, by)).alias("outer"), F.first("all").alias("all")
    )
    left = sides(open_members.where(outside), key)[0]
    met = left.join(hubs, key).select("x", "root_x", "place_x", "before_x", "all", F.posexplode(F.array("inner", "any", "outer")).alias("kind", "h")).select("*", "h.*")
    met = met.where(F.col("root_x") != F.col("root_y")).where(can_be_similar(percent, alike))
    return met.select(F.col("x.unit").alias("a"), F.col("y.unit").alias("b"), "central", F.when(F.col("kind") == 1, F.col("all")).cast("double").alias("pairs"))


def group_partners(open_pairs: DataFrame, known: DataFrame, turn: int) -> DataFrame:
    """(a, b, central, pairs) for each pair of groups: the members of each with a unit of the other's largest component, or else of another one."""
    both = open_pairs.select("a", "b").unionByName(open_pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    most = known.groupBy("gid", "root").agg(F.count(F.lit(1)).alias("many"), F.max_by("unit", F.xxhash64("unit", F.lit(turn))).alias("unit"))
    hub = F.struct("unit", "root")
    order = F.struct("many", "root")
    hubs = most.groupBy(F.col("gid").alias("b")).agg(F.max_by(hub, order).alias("inner"), F.min_by(hub, order).alias("outer"))
    own = known.select(F.col("gid").alias("a"), F.col("unit").alias("x"), F.col("root").alias("root_x"))
    met = both.join(hubs, "b").join(own, "a").select("x", "root_x", F.explode(F.array("inner", "outer")).alias("h"))
    return met.where("root_x <> h.root").select(F.col("x").alias("a"), F.col("h.unit").alias("b"), F.lit(0.0).alias("central"), F.lit(None).cast("double").alias("pairs"))


def contract(known: DataFrame, links: DataFrame) -> DataFrame:
    """known with the components that links (a, b) join under one root."""
    tidy(known.sparkSession)
    end = lambda c: known.select(F.col("unit").alias(c), F.col("root").alias(f"root_{c}"))
    edges = links.join(end("a"), "a").join(end("b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct()
    roots = components(edges).select(F.col("node").alias("root"), F.col("root").alias("top"))
    got = known.join(roots, "root", "left").withColumn("root", F.coalesce("top", "root")).select(*known.columns)
    return materialize(got, "known")


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80, small: int = 8, block: int = 1 << 16, spare: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id for every document; links are 100 * |x & y| >= percent * |x | y|.

    Words are lower-cased (A-Z).  Texts of fewer than `size` words have their
    whole sequence as one shingle; null and empty texts have none, link with
    nothing, and are components of their own.  component_id is the least doc_id
    of the component; a null doc_id takes part but is never that least id, and
    a component of null ids alone has a null component_id.  Rows that repeat an
    id are told apart by their sets.  An empty table gives no rows; other
    columns are not read.
    """
    return row_components(docs, size, percent, small, block, spare).drop("rid")


def row_components(docs: DataFrame, size: int, percent: int, small: int = 8, block: int = 1 << 16, spare: int = 4) -> DataFrame:
    """jaccard_components with the rid of each row, as keyed gives it.

    Pairs between components are verified at once if there are no more than
    about `spare` for each unit.  Else every unit meets two partners of other
    components, and what turns out similar is one component from then on; this
    goes on until the pairs are few or a turn takes away less than an eighth of
    them: then most of what is left isn't similar.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = keyed(docs)
    with scope(spark):
        seen = materialize(survey(rows, size), "shingle-survey")
        levels = sketch.levels_of(seen)
        own = materialize(seen.where("slice is null").select("rid", "doc_id", "n", "unit"), "shingle-units", keep=True)
        discard(seen)
        known = _unit_roots(rows, levels, size, percent, small, block, spare)
        roots = materialize(known.select("unit", "root").where("unit <> root"), "unit-roots", keep=True)
    labelled = own.join(roots, "unit", "left").select("rid", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "unit").alias("root"))
    empty = labelled.where("n_shingles = 0").select("rid", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    full = labelled.where("n_shingles > 0")
    least = full.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return empty.unionByName(full.join(least, "root").select("rid", "doc_id", "n_shingles", "component_id"))


def _unit_roots(rows: DataFrame, levels: np.ndarray, size: int, percent: int, small: int, block: int, spare: int) -> DataFrame:
    """(unit, root, ..) of every different set with words."""
    spark = rows.sparkSession
    lists = postings(rows, size, percent, levels, True).repartition(partitions(spark), "token").sortWithinPartitions("token", "n", "gid")
    found = materialize(list_pairs(lists, percent, small, block), "group-pairs")
    tidy(spark)
    group_of = postings(rows, size, percent, levels, False)
    units = materialize(group_of.groupBy("unit").agg(F.min("gid").alias("gid"), F.min("n").alias("n"), F.min("rid").alias("rid"), F.min("last").alias("last")), "units")
    listed = found.where("token is not null").groupBy("gid").agg(F.count(F.lit(1)).alias("listed"))
    matched = found.where("a is not null and b is null").groupBy(F.col("a").alias("gid")).agg(F.sum("shared").alias("matched"))
    groups = units.groupBy("gid").agg(F.min("unit").alias("head"), F.min("n").alias("n"), F.min("last").alias("last"))
    groups = materialize(groups.join(listed, "gid", "left").join(matched, "gid", "left").fillna(0, ["listed", "matched"]), "groups")
    about = F.struct("gid", "head", "n", "last", "listed", "matched")
    left, right = groups.select(F.col("gid").alias("a"), about.alias("x")), groups.select(F.col("gid").alias("b"), about.alias("y"))
    shared = found.where("b is not null").groupBy("a", "b").agg(F.sum(F.col("shared") % 2).alias("shared"), F.max("shared").alias("fit"))
    # tokens in long lists aren't counted for each pair: no more than the less listed one has
    possible = enough(F.least(F.col("shared") + F.least("x.listed", "y.listed"), F.least("x.matched", "y.matched")), "x", "y", percent)
    group_pairs = shared.where("fit >= 2").join(left, "a").join(right, "b").where(possible)
    group_pairs = materialize(group_pairs.select("a", "b", "shared", F.col("x.head").alias("x"), F.col("y.head").alias("y")), "possible-pairs")
    tidy(spark)

    # first: each group with the two groups it shares most with, each member with its group's head
    w = Window.partitionBy("b").orderBy(F.desc("shared"), F.xxhash64("a", "b"), "a")
    best = group_pairs.withColumn("_rn", F.row_number().over(w)).where("_rn <= 2").select(F.col("x").alias("a"), F.col("y").alias("b"))
    inside = units.join(groups.select("gid", "head"), "gid").where("unit <> head").select(F.col("head").alias("a"), F.col("unit").alias("b"))
    links = materialize(verify(rows, units, best.unionByName(inside), size, percent), "links")
    alone = units.join(groups.select("gid", "listed", "matched"), "gid").select(*ABOUT, F.col("unit").alias("root"))
    known = contract(alone, links)
    discard(links)
    tidy(spark)

    # then: what is left between different components
    ahead = F.lag("token").over(Window.partitionBy("gid").orderBy("place"))
    in_lists = materialize(found.where("token is not null").select("token", "gid", "place").distinct().withColumn("before", ahead), "list-members")
    some = spare * units.count()
    turn, before = 0, float("inf")
    while True:
        inside = known.withColumns({"place": F.lit(0), "before": F.lit(None).cast("long")})
        members = in_lists.join(known, "gid")
        # pairs of (group, component): groups that are one component don't expand
        roots = known.groupBy("gid", "root").agg(F.count(F.lit(1)).alias("many"))
        end = lambda c, roots=roots: roots.select(F.col("gid").alias(c), F.col("root").alias(f"r{c}"), F.col("many").alias(f"many_{c}"))
        open_pairs = group_pairs.select("a", "b").join(end("a"), "a").join(end("b"), "b").where("ra <> rb")
        drawn = group_partners(open_pairs, known, turn).unionByName(partners(inside, "gid", percent, True, turn)).unionByName(partners(members, "token", percent, False, turn))
        drawn = materialize(drawn, "drawn-pairs")
        tidy(spark)
        now = _many(open_pairs.selectExpr("cast(many_a * many_b as double) pairs"), drawn)
        if now <= some or now > 0.875 * before:
            break
        turn, before = turn + 1, now
        # each with two of them: the most central one and any
        two = drawn.groupBy("a").agg(F.max_by("b", F.struct("central", "b")).alias("b"), F.max_by("b", F.xxhash64("b", F.lit(turn))).alias("c"))
        # the one that many meet is the centre of a star
        two = two.select(F.col("b").alias("a"), F.col("a").alias("b")).unionByName(two.select(F.col("c").alias("a"), F.col("a").alias("b")))
        links = materialize(verify(rows, units, two, size, percent), "links")
        last, known = known, contract(known, links)
        for done in (drawn, links, last):
            discard(done)
        tidy(spark)
    end = lambda c, x: known.select(F.col("gid").alias(c), F.col("root").alias(f"r{c}"), F.col("unit").alias(x))
    between = open_pairs.join(end("a", "x"), ["a", "ra"]).join(end("b", "y"), ["b", "rb"]).select("x", "y")
    in_group = across(inside, "gid", percent, True).select(F.col("x.unit").alias("x"), F.col("y.unit").alias("y"))
    in_list = across(members, "token", percent, False).withColumns({"a": F.col("x.gid"), "b": F.col("y.gid")})
    in_list = in_list.join(shared.drop("fit"), ["a", "b"], "left").fillna(0, ["shared"]).where(possible)
    in_list = in_list.select(F.col("x.unit").alias("x"), F.col("y.unit").alias("y"))
    rest = between.unionByName(in_group).unionByName(in_list).select(F.col("x").alias("a"), F.col("y").alias("b"))
    rest = materialize(rest.distinct(), "second-pairs")
    tidy(spark)
    links = materialize(verify(rows, units, rest, size, percent), "links")
    return contract(known, links)


def _many(*parts: DataFrame) -> float:
    """The sum of all `pairs`."""
    every = parts[0].select("pairs")
    for part in parts[1:]:
        every = every.unionByName(part.select("pairs"))
    return every.agg(F.sum("pairs")).first()[0] or 0.0


def keep_representatives(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, that have the least id of their component, or no id.

    Rows are told apart by id and text; odd rows are as in jaccard_components,
    and columns of any other name are carried along.
    """
    with scope(docs.sparkSession):
        found = row_components(docs, size, percent)
        dropped = found.where("doc_id <> component_id").select(F.struct("doc_id", "rid").alias("near_copy")).distinct()
        dropped = materialize(dropped, "near-copies", keep=True)
    own = docs["doc_id"].cast("long")
    rid = F.xxhash64(own, F.coalesce(docs["text"], F.lit("")))
    return docs.join(dropped, (own == dropped["near_copy"]["doc_id"]) & (rid == dropped["near_copy"]["rid"]), "left_anti")
