"""Nearest neighbours by multiprobe p-stable hashing.

Each table hashes a vector to a cell: several Gaussian (2-stable) projections, shifted and cut into widths. A query visits
its own cell and perturbed ones in the order of their estimated success: the squared distances from its projections to
the walls that must be crossed, least first. What all tables' cells hold is reranked by the exact measure.

The measure is the inner product. Vectors are put in bands of like norms; within one they are scaled by its largest norm
and get one more component that makes them unit vectors, queries are unit vectors with a zero there: then the nearest by
distance have the largest product. A band of few vectors is a cell of its own.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize


@dataclass(frozen=True)
class Plan:
    """Tables, projections a table, cell width, cells visited a table; ``block``: vectors that meet in a block, about, and
    those above which a cell is split; bands of at most so many vectors, and less than a twentieth of all, are cells;
    ``blocks``: least number of blocks, so that small tables are spread too."""

    tables: int = 4
    projections: int = 8
    width: float = 3.0
    probes: int = 48
    block: int = 8192
    blocks: int = 64
    seed: int = 5


#: Queries, and vectors, that are compared at a time.
STEP = 256

#: Rows that a task gathers before it hands its queries' nearest on.
WAITING = 400_000

#: Cells that are split, at most: where more exceed a block, blocks grow instead.
SPLIT = 50_000


class Hashes:
    def __init__(self, plan: Plan, dimension: int):
        rng = np.random.default_rng(plan.seed)
        self.plan = plan
        self.planes = rng.normal(size=(plan.tables, dimension + 1, plan.projections))
        self.shift = rng.uniform(0, 1, size=(plan.tables, 1, plan.projections))
        self.multipliers = rng.integers(1, 2**62, plan.projections, dtype=np.int64) | 1
        #: All ways of staying, stepping down or stepping up in each projection.
        self.steps = np.array(list(itertools.product((0, -1, 1), repeat=plan.projections)), np.int64)
        self.costs = np.concatenate([self.steps < 0, self.steps > 0], 1).astype(np.float64)

    def places(self, vectors: np.ndarray) -> np.ndarray:
        """Projections in units of a cell: tables x vectors x projections."""
        return np.einsum("nd,tdp->tnp", vectors, self.planes) / self.plan.width + self.shift

    def name(self, cells: np.ndarray) -> np.ndarray:
        """A number for a cell; cells that meet in one are one cell."""
        with np.errstate(over="ignore"):
            n = (cells * self.multipliers).sum(-1)
            return n ^ (n >> 29)

    def visits(self, places: np.ndarray, probes: int) -> np.ndarray:
        """For each query the names of the cells to visit, by estimated success."""
        return np.concatenate([self._visits(places[k : k + STEP], probes) for k in range(0, len(places), STEP)] or [np.zeros((0, 1), np.int64)])

    def _visits(self, places: np.ndarray, probes: int) -> np.ndarray:
        own = np.floor(places).astype(np.int64)
        down = (places - own) ** 2
        cost = np.concatenate([down, (1 - (places - own)) ** 2], 1) @ self.costs.T
        n = min(probes, cost.shape[1])
        best = np.argpartition(cost, n - 1, axis=1)[:, :n]
        best = np.take_along_axis(best, np.argsort(np.take_along_axis(cost, best, 1), 1, kind="stable"), 1)
        return self.name(own[:, None] + self.steps[best])


def _prepared(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, d, norm, x, y, v) of the vectors that take part, as a table: their dimension, norm, and a hash of 128 bits.

    Those are not null, not zero, and without null or non-finite components; so is their id not null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, ids = batch.column(1), batch.column(0)
            sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # nulls become NaN, -0.0 becomes 0.0
            row = np.repeat(np.arange(len(sizes)), sizes)
            most = np.zeros(len(sizes))
            np.maximum.at(most, row, np.where(np.isfinite(flat), np.abs(flat), np.inf))
            good = (most > 0) & np.isfinite(most) & ~np.asarray(ids.is_null())
            flat, sizes, most = flat[good[row]], sizes[good], most[good]
            ends = np.cumsum(np.concatenate([[0], sizes]))
            row = np.repeat(np.arange(len(sizes)), sizes)
            norm = np.minimum(most * np.sqrt(np.bincount(row, (flat / most[row]) ** 2, len(sizes))), 1e308)
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(flat[a:b].tobytes()) for a, b in itertools.pairwise(ends.tolist())), np.int64).reshape(-1, 2)
            own = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(good)), pa.array(sizes), pa.array(norm), pa.array(digests[:, 0]), pa.array(digests[:, 1]), own], names=["id", "d", "norm", "x", "y", "v"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return materialize(rows.mapInArrow(run, "id long, d long, norm double, x long, y long, v array<double>"), "prepared")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1)


class _Best:
    """Each query's nearest so far; ties go to the smaller id."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.floor = np.full(len(queries), -np.inf)
        self.rows: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def offer(self, q: np.ndarray, vectors: np.ndarray, ids: np.ndarray) -> None:
        """All of ``vectors`` to the queries numbered ``q``; what k others of them surely surpass isn't kept."""
        scores = self.queries[q] @ vectors.T
        floor = self.floor[q]
        if len(ids) > self.k:
            floor = np.maximum(floor, np.partition(scores, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
        a, b = np.nonzero(scores >= floor[:, None] - 1e-9 * np.maximum(1, np.abs(floor))[:, None])
        exact = (self.queries[q[a]] * vectors[b]).sum(1)
        self.rows.append((q[a], ids[b], exact))
        self.waiting += len(a)
        if self.waiting > 200_000:
            self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        if not self.rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        q, ids, scores = (np.concatenate(x) for x in zip(*self.rows, strict=True))
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        first = np.searchsorted(q, q)
        keep = np.arange(len(q)) - first < self.k
        q, ids, scores = q[keep], ids[keep], scores[keep]
        full = np.arange(len(q)) - np.searchsorted(q, q) == self.k - 1
        self.floor[q[full]] = scores[full]
        self.rows, self.waiting = [(q, ids, scores)], 0
        return q, ids, scores


@dataclass(frozen=True)
class Band:
    """Vectors whose norms lie within a factor of the square root of two; ``probes``: cells visited a table, 0: all are one cell."""

    number: int
    scale: float
    probes: int


def bands(counts: dict[int, int], longest: float, plan: Plan) -> list[Band]:
    """Bands, the longest vectors first. Shorter ones are less likely to hold a nearest, so probes halve from band to band."""
    out, probes, n = [], plan.probes, sum(counts.values())
    for number, count in sorted(counts.items()):
        whole = count <= plan.block and count * 20 < n
        out.append(Band(number, longest * 2 ** (-number / 2), 0 if whole else probes))
        probes = probes if whole else max(4, probes // 2)
    return out


#: The last band holds all that is shorter still.
LAST_BAND = 600


def _band(norm: Column, longest: float) -> Column:
    return F.least(F.greatest(F.floor(2 * (F.log2(F.lit(longest)) - F.log2(norm))), F.lit(0)), F.lit(LAST_BAND)).cast("int")


class Cells:
    """Where vectors are kept and where queries look: cells by table and band."""

    def __init__(self, plan: Plan, dimension: int, all_: list[Band]):
        self.plan, self.hashes, self.bands = plan, Hashes(plan, dimension), {b.number: b for b in all_}

    def _name(self, cells: np.ndarray, table: int, band: Band) -> np.ndarray:
        with np.errstate(over="ignore"):
            return cells + np.int64(0x9E3779B97F4A7C1) * (table + 1) + np.int64(0x2545F4914F6CDD1) * (band.number + 1)

    def kept(self, vectors: np.ndarray, numbers: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, cells): the cell of each vector in each table, by the bands' ``numbers``."""
        for number in np.unique(numbers).tolist():
            rows, band = np.flatnonzero(numbers == number), self.bands[number]
            if not band.probes:
                yield rows, self._name(np.zeros(len(rows), np.int64), 0, band)
                continue
            x = vectors[rows] / band.scale
            lifted = np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1, keepdims=True)))], 1)
            for table, places in enumerate(self.hashes.places(lifted)):
                yield rows, self._name(self.hashes.name(np.floor(places).astype(np.int64)), table, band)

    def visited(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, cells): what each query looks at."""
        unit = vectors / np.abs(vectors).max(1, keepdims=True)
        lifted = np.concatenate([unit / np.sqrt((unit * unit).sum(1, keepdims=True)), np.zeros((len(vectors), 1))], 1)
        places, rows, cells, every = self.hashes.places(lifted), [], [], np.arange(len(vectors))
        for band in self.bands.values():
            if not band.probes:
                rows.append(every)
                cells.append(self._name(np.zeros(len(vectors), np.int64), 0, band))
                continue
            for table, own in enumerate(places):
                names = self.hashes.visits(own, band.probes)
                rows.append(np.repeat(every, names.shape[1]))
                cells.append(self._name(names, table, band).ravel())
        return np.concatenate(rows), np.concatenate(cells)


class Everywhere:
    """One cell for all: what an exact scan of blocks looks at."""

    def kept(self, vectors: np.ndarray, numbers: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        yield np.arange(len(vectors)), np.zeros(len(vectors), np.int64)

    def visited(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.arange(len(vectors)), np.zeros(len(vectors), np.int64)


def _block(cells: np.ndarray, part: np.ndarray, blocks: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (cells ^ (part + 1) * np.int64(0x5851F42D4C957F2)) * np.int64(0x27BB2EE687B0B0F)
    return ((h >> np.int64(33)) & np.int64(0x3FFFFFFF)) % blocks


_DDL = "block long, kind int, id long, cells array<long>, v array<double>"


def _meet(vectors: DataFrame, queries: DataFrame, cells: Cells | Everywhere, blocks: int, crowded: tuple[np.ndarray, np.ndarray], k: int) -> DataFrame:
    """(query_id, vec_id, score): of each block's vectors the ``k`` nearest of each query that looks at their cells.

    ``vectors``: (id, v, band); ``queries``: (id, v); ``crowded``: cells that are split, sorted, and their parts. A query
    goes to the blocks of the cells that it visits, once to each, and to all parts of a split cell.
    """

    def parts(names: np.ndarray) -> np.ndarray:
        if not len(crowded[0]):
            return np.ones(len(names), np.int64)
        at = np.minimum(np.searchsorted(crowded[0], names), len(crowded[0]) - 1)
        return np.where(crowded[0][at] == names, crowded[1][at], 1)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            ids = np.asarray(batch.column(0))
            spread = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
            for rows, names in cells.kept(_matrix(batch.column(1)), np.asarray(batch.column(2))):
                own = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32)), pa.array(names))
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(_block(names, spread[rows] % parts(names), blocks)), pa.array(np.zeros(len(rows), np.int32)), batch.column(0).take(take), own, batch.column(1).take(take)], names=["block", "kind", "id", "cells", "v"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), STEP):
                some = batch.slice(at, STEP)
                rows, names = cells.visited(_matrix(some.column(1)))
                many = parts(names)
                part = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                rows, names = np.repeat(rows, many), np.repeat(names, many)
                block = _block(names, part, blocks)
                order = np.lexsort((names, rows, block))
                rows, names, block = rows[order], names[order], block[order]
                first = np.concatenate([[True], (rows[1:] != rows[:-1]) | (block[1:] != block[:-1])])
                new = first | np.concatenate([[True], names[1:] != names[:-1]])
                rows, names, block, first = rows[new], names[new], block[new], np.flatnonzero(first[new])
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(rows)).astype(np.int32)), pa.array(names))
                take = pa.array(rows[first])
                yield pa.RecordBatch.from_arrays([pa.array(block[first]), pa.array(np.ones(len(first), np.int32)), some.column(0).take(take), lists, some.column(1).take(take)], names=["block", "kind", "id", "cells", "v"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held_parts, held = None, [], None
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            key = np.asarray(batch.column(0)) * 2 + np.asarray(batch.column(1))
            for a, b in itertools.pairwise([0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]):
                if a == b:
                    continue
                part, at = batch.slice(a, b - a), int(key[a])
                if at // 2 != current:
                    current, held_parts, held = at // 2, [], None
                if at % 2 == 0:
                    held_parts.append((np.asarray(part.column(2)), np.asarray(part.column(3).flatten()), _matrix(part.column(4))))
                elif held_parts:
                    if held is None:
                        ids, names, kept = (np.concatenate(x) for x in zip(*held_parts, strict=True))
                        order = np.argsort(names, kind="stable")
                        held, held_parts = (ids[order], names[order], kept[order]), held_parts[:1]
                    waiting += answer(part, *held)
                    if sum(map(len, waiting)) > WAITING:
                        waiting = [best_of(waiting)]
                        if len(waiting[0]) > WAITING // 2:
                            yield waiting.pop()
        if waiting:
            yield best_of(waiting)

    def best_of(found: list[pa.RecordBatch]) -> pa.RecordBatch:
        """Each query's nearest over the blocks that one task has seen."""
        q, ids, scores = (np.concatenate([np.asarray(b.column(c)) for b in found]) for c in range(3))
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        new = np.concatenate([[True], (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])]) if len(q) else np.zeros(0, bool)
        q, ids, scores = q[new], ids[new], scores[new]
        few = np.arange(len(q)) - np.searchsorted(q, q) < k
        return pa.RecordBatch.from_arrays([pa.array(q[few]), pa.array(ids[few]), pa.array(scores[few])], names=["query_id", "vec_id", "score"])

    def answer(part: pa.RecordBatch, ids: np.ndarray, names: np.ndarray, vectors_: np.ndarray) -> Iterator[pa.RecordBatch]:
        query_ids = np.asarray(part.column(2))
        best = _Best(_matrix(part.column(4)), k)
        lists = part.column(3)
        visited, who = np.asarray(lists.flatten()), np.repeat(np.arange(len(part)), np.asarray(lists.value_lengths()))
        order = np.argsort(visited, kind="stable")
        visited, who = visited[order], who[order]
        for a, b in itertools.pairwise([*np.flatnonzero(np.diff(visited, prepend=visited[:1] - 1)).tolist(), len(visited)]):
            lo, hi = np.searchsorted(names, visited[a], "left"), np.searchsorted(names, visited[a], "right")
            for s, t in itertools.product(range(lo, hi, STEP), range(a, b, STEP)):
                best.offer(who[t : min(b, t + STEP)], vectors_[s : min(hi, s + STEP)], ids[s : min(hi, s + STEP)])
        q, found, scores = best.settle()
        yield pa.RecordBatch.from_arrays([pa.array(query_ids[q]), pa.array(found), pa.array(scores)], names=["query_id", "vec_id", "score"])

    meeting = vectors.mapInArrow(index, _DDL).unionByName(queries.mapInArrow(visit, _DDL))
    return meeting.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(search, "query_id long, vec_id long, score double")


def _crowded(vectors: DataFrame, cells: Cells, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells of more than ``most`` vectors and into how many parts they are split; gathers at most SPLIT of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, names in cells.kept(_matrix(batch.column(1)), np.asarray(batch.column(2))) if len(batch) else ():
                yield pa.RecordBatch.from_arrays([pa.array(names)], names=["cell"])

    counts = vectors.mapInArrow(run, "cell long").groupBy("cell").count().where(F.col("count") > most).collect()
    rows = sorted((r.cell, -(-r["count"] // most)) for r in counts)
    return np.array([c for c, _ in rows], np.int64), np.array([n for _, n in rows], np.int64)


def _distinct(prepared: DataFrame, keep: int | None) -> tuple[DataFrame, DataFrame]:
    """A row (id, norm, v) for each distinct vector, and (rep, id, x, y) of the rows that have it: ``rep`` is the vector's number.

    Numbers follow the least ids of the vectors, so that of two the one with the smaller id has the smaller number. Rows are
    told apart by place, so an id may have several vectors and a row may repeat. ``keep``: so many rows of a vector are enough.
    """
    own = prepared.groupBy("x", "y").agg(F.min("id").alias("least"), F.any_value("norm").alias("norm"), F.any_value("v").alias("v"))
    ordered = materialize(own, "distinct").repartitionByRange("least", "x", "y").sortWithinPartitions("least", "x", "y")
    vectors = materialize(ordered.withColumn("id", F.monotonically_increasing_id()), "vectors")
    rows = prepared.select("x", "y", "id")
    if keep is not None:
        rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("x", "y").orderBy("id"))).where(F.col("n") <= keep)
    members = materialize(rows.join(vectors.select("x", "y", F.col("id").alias("rep")), ["x", "y"]).select("rep", "id", "x", "y"), "members")
    return vectors.select("id", "norm", "v"), members


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, plan: Plan | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row of ``queries`` its ``k`` nearest of ``rows`` other than itself, a row of its id and vector: query_id, rank, vec_id, score.

    Score: the inner product of the original vectors in double precision; ties go to the smaller id; all candidates, if
    there are fewer than ``k``. Vectors that are null, zero, hold null or non-finite components or have another dimension
    than most take no part; nor do null ids. Rows count as they stand, where an id repeats with the same vector or others too,
    and so do queries. An empty table on either
    side gives an empty one; other columns play no part.

    Equal vectors are one candidate, whose least ids stand for it, and one query, so a vector that a third of all rows
    share costs as much as any other. Vectors move once for each table and queries once to each block that holds a cell
    they visit: shuffled rows grow with vectors and visits. A cell above a block's size is split. A query for which the
    cells held too few is answered by an exact scan of all blocks.
    """
    plan = plan or Plan()
    spark, schema = rows.sparkSession, "query_id long, rank int, vec_id long, score double"
    prepared = _prepared(rows, id_col, vector_col)
    sizes = prepared.groupBy("d").agg(F.count("*").alias("n")).sort(F.desc("n"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    vectors, members = _distinct(prepared.where(F.col("d") == sizes.d), k + 1)
    asked, askers = _distinct(_prepared(queries, id_col, vector_col).where(F.col("d") == sizes.d), None)
    asked = asked.select("id", "v")

    longest = vectors.agg(F.max("norm")).first()[0]
    vectors = vectors.select("id", "v", _band(F.col("norm"), longest).alias("band"))
    counts = {r.band: r["count"] for r in vectors.groupBy("band").count().collect()}
    n, cells = sum(counts.values()), Cells(plan, sizes.d, bands(counts, longest, plan))
    most = max(plan.block, -(-n * plan.tables // SPLIT))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def answered(found: DataFrame) -> DataFrame:
        """The k + 1 nearest rows of each distinct query, for it may be among them itself."""
        top = found.withColumn("n", F.dense_rank().over(best)).where(F.col("n") <= k + 1).select("query_id", "vec_id", "score").distinct()  # tables may find the same
        spelt = top.join(members.select(F.col("rep").alias("vec_id"), "id"), "vec_id").select("query_id", F.col("id").alias("vec_id"), "score", F.col("vec_id").alias("rep"))
        return materialize(spelt.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1), "nearest")

    found = answered(_meet(vectors, asked, cells, max(plan.blocks, -(-n * plan.tables // most)), _crowded(vectors, cells, most), k + 1))
    enough = found.groupBy("query_id").count().where(F.col("count") >= min(k + 1, members.count())).select(F.col("query_id").alias("id"))
    lacking = materialize(asked.join(enough, "id", "left_anti"), "lacking")
    if not lacking.isEmpty():
        blocks = max(1, -(-n // plan.block))
        again = answered(_meet(vectors, lacking, Everywhere(), blocks, (np.zeros(1, np.int64), np.array([blocks], np.int64)), k + 1))
        found = found.join(again.select("query_id").distinct(), "query_id", "left_anti").unionByName(again)
    lists = found.groupBy(F.col("query_id").alias("rep")).agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score", F.col("rep").alias("node")))).alias("all"))
    numbers = members.select("x", "y", F.col("rep").alias("node")).distinct()
    asking = askers.join(numbers, ["x", "y"], "left").join(lists, "rep")
    itself = F.array_position(F.transform("all", lambda x: (x["vec_id"] == F.col("id")) & F.coalesce(x["node"] == F.col("node"), F.lit(False))), True)
    own = asking.select(F.col("id").alias("query_id"), "all", itself.alias("itself")).select("query_id", F.slice(F.filter("all", lambda x, i: i + 1 != F.col("itself")), 1, k).alias("all"))
    return own.select("query_id", F.posexplode("all").alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
