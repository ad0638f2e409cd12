"""Pairs of texts whose shingle sets can be similar enough, none left out: a prefix-filter join, rarest shingles first.

All sets are put in one order, and the first n - ceil(t n) + 1 shingles are a set's prefix. Two sets of n and m shingles
and of Jaccard similarity t or more have o = ceil(t / (1 + t) (n + m)) in common. At most n - o of the first set are not in
the second, so of the one whose prefix ends first nearly all of the prefix stands in the other prefix too: a pair that
shares fewer prefix shingles is ruled out. More so, the k-th shingle in common stands among the first n - o + k of the one
and m - o + k of the other, so only what lies within these is counted, and k of it must be shared. Any order finds the same
similar pairs; the one here puts the shingles that a sample shows to be frequent last, so that few texts meet on them.
Texts that are linked already need not meet again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .storage import materialize

#: One text of so many is looked at to tell frequent shingles, so that those of some dozens of texts are known at any size. This
#: decides the order of shingles and so the cost, never the result.
SAMPLE_PART = 8

#: Shingles put last: at most so many of those that so many texts of the sample hold. Their number shapes the cost only.
FREQUENT, FREQUENT_FROM = 300_000, 4

#: Rows of one side that meet in one group; more are dealt over several.
GROUP = 4096

#: Estimated rows of a shingle for each star; a more frequent one makes several.
STAR = 65_536


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The distinct shingle keys of each text, sorted: runs of ``size`` words, or all words if there are fewer; none without words."""
    for scan in W.scans(column, W.INK):
        running = W.Running(scan.keys())
        windows = running.windows(size)
        for a, b in zip(scan.bounds.tolist(), scan.bounds[1:].tolist(), strict=False):
            own = windows[a : b - size + 1] if b - a >= size else running.hashes(np.arange(a, min(a + 1, b)), b - a)
            yield np.unique(own).view(np.int64)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that what is made of the texts of one doesn't fill a task."""
    for batch in batches:
        for k in range(0, len(batch), rows):
            yield batch.slice(k, rows)


def lists(rows: list[np.ndarray]) -> pa.ListArray:
    """Arrays of longs as a column."""
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *rows])))


def _unseen(digests: pa.Array, seen: set[bytes]) -> np.ndarray:
    """The rows whose digest this task hasn't met; so a text copied everywhere is worked on once in each task."""
    keep = []
    for k, digest in enumerate(digests.to_pylist()):
        if digest not in seen:
            seen.add(digest)
            keep.append(k)
    return np.array(keep, np.int64)


def _frequent(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles that are frequent in a sample of (digest, text), sorted; their ranks from 1, the most frequent last; stars for each.

    A text that several tasks hold counts in each, which at most puts its shingles later than they need be.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in slices(batches):
            rows = batch.take(pa.array(_unseen(batch.column(0), seen)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *shingle_sets(rows.column(1), size)]))], names=["key"])

    counts = texts.where(F.pmod(F.xxhash64("digest"), F.lit(SAMPLE_PART)) == 0).mapInArrow(run, "key long").groupBy("key").count().where(F.col("count") >= FREQUENT_FROM)
    top = counts.orderBy(F.desc("count"), "key").limit(FREQUENT).toArrow()
    found, often = top["key"].to_numpy(), top["count"].to_numpy()
    order = np.argsort(found)
    return found[order], np.arange(len(found), 0, -1)[order], -(-often * SAMPLE_PART // STAR)[order]


def prefixes(texts: DataFrame, nodes: DataFrame, size: int, at_least: float) -> DataFrame:
    """(node, n, keys, stars) of (digest, text) and (node, digest): the set's size, its prefix, and stars of each key, null where all have one."""
    found = _frequent(texts, size)
    shared = texts.sparkSession.sparkContext.broadcast(found)  # at most FREQUENT rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (hot, ranks, stars), seen = shared.value, set()
        for batch in slices(batches):
            rows = batch.take(pa.array(_unseen(batch.column(0), seen)))
            sizes, chosen, many = [], [], []
            for keys in shingle_sets(rows.column(1), size):
                rank, star = np.zeros(len(keys), np.int64), np.ones(len(keys), np.int64)
                if len(hot) and len(keys):
                    at = np.minimum(np.searchsorted(hot, keys), len(hot) - 1)
                    rank, star = np.where(hot[at] == keys, ranks[at], 0), np.where(hot[at] == keys, stars[at], 1)
                length = len(keys) - math.ceil(at_least * len(keys) - 1e-9) + 1 if len(keys) else 0
                order = np.lexsort((keys, rank))[:length]
                sizes.append(len(keys))
                chosen.append(keys[order])
                many.append(star[order] if (star[order] > 1).any() else None)
            stars_of = pa.array([m if m is None else m.tolist() for m in many], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(sizes, pa.int32()), lists(chosen), stars_of], names=["digest", "n", "keys", "stars"])

    made = texts.mapInArrow(run, "digest binary, n int, `keys` array<long>, stars array<long>").where("n > 0").dropDuplicates(["digest"])
    return made.join(nodes, "digest").select("node", "n", "keys", "stars")


#: Of the prefix shingles that a similar pair is sure to share, one in so many is counted. A larger number lets texts meet
#: within shorter prefixes, but asks less of them; it shapes the cost only.
COUNTED = 4


def _need(n: np.ndarray, m: np.ndarray, i: np.ndarray, j: np.ndarray, at_least: float) -> np.ndarray:
    """Shingles that sets of n and m shingles share at least, within the stretches that are counted, if they are similar
    enough; 0: they can't be, or places i and j of a shingle in their orders aren't both within."""
    common = np.ceil(at_least / (1 + at_least) * (n + m) - 1e-6)
    prefix = lambda x: x - np.ceil(at_least * x - 1e-9) + 1
    least = np.maximum(1, np.minimum(prefix(n) - (n - common), prefix(m) - (m - common)))
    k = np.ceil(least / COUNTED)
    fits = (np.minimum(n, m) >= common) & (i < n - common + k) & (j < m - common + k)
    return np.where(fits, k, 0).astype(np.int32)


def stars(prefixes_: DataFrame, at_least: float) -> DataFrame:
    """What meets on a shingle, as a table: pairs (a, b, need, two) where key is null, else members (key, a, n, pos) of larger groups.

    The node that has the fewest rarer shingles than the group's, so the source of copies rather than one of them, meets all
    others, so a group costs its size; ``two``: the pair is the whole group. Groups
    of three or more hand their members on; so do the stars of a frequent shingle, whatever their size. Rows stream by in
    order: a task holds a batch and the head of a group, however large the group is.
    """
    rows = prefixes_.select("node", "n", "stars", F.posexplode("keys").alias("pos", "key"))
    of = F.get("stars", F.col("pos"))
    star = F.when(of > 1, F.pmod(F.xxhash64("node"), of)).otherwise(-1).cast("int")  # -1: the only one
    ordered = rows.select("key", star.alias("star"), "node", "n", "pos").repartition("key", "star").sortWithinPartitions("key", "star", "pos", "node")

    def emit(columns: list[np.ndarray], seen: bool, goes_on: bool = False) -> Iterator[pa.RecordBatch]:
        """From rows of whole groups; of the first one only a head that was ``seen`` before and what follows; the last may go on."""
        key, star, node, n, pos = columns
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (star[1:] != star[:-1])]))
        sizes = np.diff(np.append(starts, len(key)))
        hub = np.repeat(starts, sizes)
        need = _need(n[hub], n, pos[hub], pos, at_least)
        pair = (node != node[hub]) & (need > 0)
        large = (sizes > 2) | (star[starts] >= 0)
        large[0] |= seen
        large[-1] |= goes_on
        member = np.repeat(large, sizes)
        two = ~member[pair]
        member[0] &= not seen
        none = lambda k, kind: pa.nulls(k, kind)
        names = ["key", "a", "b", "n", "pos", "need", "two"]
        if pair.any():
            k = int(pair.sum())
            yield pa.RecordBatch.from_arrays([none(k, pa.int64()), pa.array(np.minimum(node[hub], node)[pair]), pa.array(np.maximum(node[hub], node)[pair]), none(k, pa.int32()), none(k, pa.int32()), pa.array(need[pair]), pa.array(two)], names=names)
        if member.any():
            k = int(member.sum())
            yield pa.RecordBatch.from_arrays([pa.array(key[member]), pa.array(node[member]), none(k, pa.int64()), pa.array(n[member]), pa.array(pos[member]), none(k, pa.int32()), none(k, pa.bool_())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = None, False  # the last group so far: all of up to two rows, or the head of a larger one that is seen
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            now = new if held is None else [np.concatenate(c) for c in zip(held, new, strict=True)]
            last = int(np.flatnonzero((now[0] == now[0][-1]) & (now[1] == now[1][-1]))[0])
            alone = last == 0
            if len(now[0]) - last <= 2 and not (alone and seen):
                if last:
                    yield from emit([c[:last] for c in now], seen)
                held, seen = [c[last:] for c in now], False
            else:
                yield from emit(now, seen, True)
                held, seen = [c[last : last + 1] for c in now], True
        if held is not None and not seen:
            yield from emit(held, False)

    return materialize(ordered.mapInArrow(run, "key long, a long, b long, n int, pos int, need int, two boolean"), "met")


def counted(met: DataFrame) -> DataFrame:
    """(a, b, shared, need, two) of the pairs that ``stars`` made, as a table: how often they met, and in groups of two."""
    pairs = met.where("key is null").groupBy("a", "b").agg(F.count("*").alias("shared"), F.max("need").alias("need"), F.count_if("two").alias("two"))
    return materialize(pairs, "counted")


def _meet(rows: DataFrame, at_least: float) -> DataFrame:
    """Pairs (a, b, need) of differing labels in each group of ``rows`` (key, kind, i, j, node, label, n, own, pos).

    Kind 0: rows of the key's main label (own -1) against others; kind 1: other rows of block i against those of block j.
    """

    def pairs(kind: int, i: int, j: int, node: np.ndarray, label: np.ndarray, n: np.ndarray, own: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
        left, right = (own >= 0, own < 0) if kind == 0 else (own == i, own == j)
        x, y = np.flatnonzero(left), np.flatnonzero(right)
        step = max(1, (1 << 18) // max(1, len(y)))
        for k in range(0, len(x), step):
            p = x[k : k + step, None]
            need = _need(n[p], n[y], pos[p], pos[y], at_least)
            fits = (label[p] != label[y]) & (need > 0)
            if kind and i == j:
                fits &= node[p] < node[y]
            u, v = np.nonzero(fits)
            if len(u):
                a, b = node[p[u, 0]], node[y[v]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(need[u, v])], names=["a", "b", "need"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # of one group, which has a bounded number of rows
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held:
                new = [np.concatenate([a, b]) for a, b in zip(held, new, strict=True)]
            ends = np.flatnonzero(np.any([c[1:] != c[:-1] for c in new[:4]], axis=0)) + 1
            for s, e in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=False):
                yield from pairs(*(int(c[s]) for c in new[1:4]), *(c[s:e] for c in new[4:]))
            held = [c[ends[-1] if len(ends) else 0 :] for c in new]
        if held:
            yield from pairs(*(int(c[0]) for c in held[1:4]), *held[4:])

    ordered = rows.select("key", "kind", "i", "j", "node", "label", "n", "own", "pos").repartition("key", "kind", "i", "j").sortWithinPartitions("key", "kind", "i", "j")
    return ordered.mapInArrow(run, "a long, b long, need int")


def unlinked_pairs(members: DataFrame, labels: DataFrame, counts: DataFrame, at_least: float) -> DataFrame:
    """Distinct pairs (a, b), a < b, of ``members`` (key, a, n, pos) without a common label that ``at_least`` does not rule out.

    ``labels`` (node, label) names the groups known so far; a node it lacks is its own. ``counts`` are those of ``counted``:
    what a pair shares in groups of two is added to what it shares here. A shingle whose texts are one
    group costs a count. Otherwise the rows of its largest group and all its other rows are dealt into blocks of about
    GROUP, and any two blocks meet that may hold a pair of different groups; no task holds more than two blocks.
    """
    named = members.select("key", F.col("a").alias("node"), "n", "pos").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = materialize(named, "members")
    sizes = named.groupBy("key", "label").agg(F.count("*").alias("rows")).groupBy("key")
    mixed = sizes.agg(F.count("*").alias("labels"), F.max_by("label", F.struct("rows", "label")).alias("most"), F.max("rows").alias("m"), F.sum("rows").alias("all")).where("labels > 1")
    blocks = lambda n: F.ceil(n / GROUP).cast("int")
    met = named.join(mixed.select("key", "most", blocks(F.col("m")).alias("mains"), blocks(F.col("all") - F.col("m")).alias("others")), "key")
    main = F.col("label") == F.col("most")
    block = F.pmod(F.xxhash64("node"), F.when(main, F.col("mains")).otherwise(F.col("others"))).cast("int")
    at = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    met = met.withColumn("block", block)
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    visits = F.when(main, F.transform(every("others"), lambda j: at(0, F.col("block"), j))).otherwise(
        F.concat(F.transform(every("mains"), lambda i: at(0, i, F.col("block"))), F.transform(every("others"), lambda j: at(1, F.least("block", j), F.greatest("block", j))))
    )
    dealt = met.select("key", "node", "label", "n", "pos", F.when(main, -1).otherwise(F.col("block")).alias("own"), F.explode(visits).alias("g")).select("*", "g.kind", "g.i", "g.j")
    shared = _meet(dealt, at_least).groupBy("a", "b").agg(F.count("*").alias("here"), F.max("need").alias("need"))
    pairs = shared.join(counts.where("two > 0").select("a", "b", "two"), ["a", "b"], "left")
    return pairs.where(F.col("here") + F.coalesce("two", F.lit(0)) >= F.col("need")).select("a", "b")
