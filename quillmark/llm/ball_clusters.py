"""Exact Lloyd rounds by ball k-means, over vectors with integer components.

A cluster is a ball: its centroid and a radius that holds its members. Another centroid matters to a ball only if half
the way to it is within the radius. Within a ball, members closer to their centroid than half the way to its nearest
neighbour are its stable core and stay unmeasured; the others lie in annuli, bounded by half the ways to the first, second,
.. neighbour, and are compared with just so many neighbours. What is left out can't be nearer, and can't tie either.

Centroids and radii, k rows, are all that the driver holds; members are a table in the shared folder for each round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize

#: Largest size of an integer component: distances stay within a long for up to 128 components. Larger ones are an error.
LARGEST = 1 << 27

#: Sums of squares up to this are exact in double precision.
_EXACT = float(1 << 53)


@dataclass(frozen=True)
class Balls:
    """Centroids (k x d), the squared ways between them, and for each the others in the order of their distance that
    half the way to which is within its radius."""

    centroids: np.ndarray
    between: np.ndarray
    neighbours: list[np.ndarray]

    @staticmethod
    def of(centroids: np.ndarray, radii: np.ndarray | None = None) -> Balls:
        """``radii``: bounds of the members' distances; without them every ball reaches every other."""
        between = distances(centroids, centroids)
        reach = np.full(len(centroids), np.inf) if radii is None else (2 * radii * (1 + 1e-9) + 1e-6) ** 2
        order = [np.argsort(row, kind="stable") for row in between]
        return Balls(centroids, between, [o[(o != i) & (between[i][o] <= reach[i])] for i, o in enumerate(order)])


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors; in double precision where their size allows it."""
    largest = max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0))
    if 4.0 * x.shape[1] * float(largest) ** 2 < _EXACT:
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([np.square(x - c).sum(1) for c in centroids], 1) if len(centroids) else np.zeros((len(x), 0), np.int64)


def assigned(x: np.ndarray, labels: np.ndarray | None, balls: Balls) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, the smaller number where two are, and the squared distance to it."""
    c = balls.centroids
    if labels is None:
        all_ = distances(x, c)
        best = all_.argmin(1)
        return best, all_[np.arange(len(x)), best]
    out, far = labels.copy(), np.zeros(len(x), np.int64)
    for i in np.unique(labels).tolist():
        rows = np.flatnonzero(labels == i)
        own = distances(x[rows], c[i : i + 1])[:, 0]
        far[rows], near = own, balls.neighbours[i]
        within = np.searchsorted(balls.between[i][near], 4 * own, "right")  # zero: the stable core
        for n in np.unique(within[within > 0]).tolist():
            ring = within == n
            names = np.sort(np.append(near[:n], i))  # ascending, so that argmin takes the smaller number
            d = distances(x[rows[ring]], c[names])
            best = d.argmin(1)
            out[rows[ring]], far[rows[ring]] = names[best], d[np.arange(len(d)), best]
    return out, far


def integer_vectors(rows: DataFrame, dimension: int, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """(id, x array<int>) of vectors with exactly so many components, none null or non-finite: floor(scale * component)."""
    v = F.col(vector_col)
    wrong = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    whole = F.transform(v, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))
    big = F.exists(whole, lambda c: F.abs(c) > LARGEST)
    kept = rows.where((F.size(v) == dimension) & ~wrong).select(F.col(id_col).alias("id"), whole.alias("x"), big.alias("big"))
    return kept.select("id", F.when(F.col("big"), F.raise_error(F.lit(f"a component is beyond {LARGEST} after scaling"))).otherwise(F.col("x")).cast("array<int>").alias("x"))


def _matrix(column: pa.ListArray, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dimension)


def _round(members: DataFrame, balls: Balls, labelled: bool, keep: bool) -> DataFrame:
    """(id, x, cluster, distance); without x unless ``keep``."""
    kind, d = members.schema["id"].dataType.simpleString(), balls.centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column("cluster").to_numpy().astype(np.int64) if labelled else None
            cluster, far = assigned(_matrix(batch.column("x"), d), labels, balls)
            found = {"cluster": pa.array(cluster.astype(np.int32)), "distance": pa.array(far)}
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), **({"x": batch.column("x")} if keep else {}), **found})

    return members.mapInArrow(run, f"id {kind}, {'x array<int>, ' if keep else ''}cluster int, distance long")


def _totals(members: DataFrame, dimension: int) -> list:
    """A row for each cluster that has members: their number, the largest and the summed distance, sums by component."""
    sums: list[Column] = [F.sum(F.col("x")[i].cast("long")).alias(f"s{i}") for i in range(dimension)]
    return members.groupBy("cluster").agg(F.count("*").alias("n"), F.max("distance").alias("farthest"), *sums).collect()


def ball_kmeans(rows: DataFrame, k: int = 40, rounds: int = 5, dimension: int = 64, scale: float = 256.0, salt: str = "2:", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part.

    Vectors of other sizes, null ones and those with null or non-finite components take no part. Centroids start as the
    ``k`` vectors whose salted ids have the smallest SHA-256, or all, if there are fewer; of equal ids the smaller vector
    comes first, a null id counts as an empty text. A round assigns all vectors and puts every non-empty centroid at the
    floor of its vectors' means; rounds after one that moved nothing would change nothing and are left out. Repeated rows
    count as often as they stand; an empty table gives an empty one; other columns are left out. Nothing is grouped by
    vector, and sums are made within tasks first, so equal vectors cost what others do.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    members = materialize(integer_vectors(rows, dimension, scale, id_col, vector_col), "integer-vectors")
    key = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    starts = [r.x for r in members.select(key.alias("h"), "x").sort("h", "x").limit(k).collect()]
    if not starts:
        return rows.sparkSession.createDataFrame([], f"`{id_col}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids, radii, labelled = np.array(starts, np.int64), None, False
    for _ in range(rounds):
        before, members = members, materialize(_round(members, Balls.of(centroids, radii), labelled, True), "ball-members")
        discard(before)
        moved, radii, labelled = centroids.copy(), np.zeros(len(centroids)), True
        for t in _totals(members, dimension):
            moved[t.cluster] = [t[f"s{i}"] // t.n for i in range(dimension)]
            radii[t.cluster] = np.sqrt(float(t.farthest))
        steps = np.sqrt(np.square((moved - centroids).astype(np.float64)).sum(1))
        radii, centroids = radii + steps, moved
        if not steps.any():
            break
    last = materialize(_round(members, Balls.of(centroids, radii), labelled, False), "ball-labels")
    discard(members)
    inertia = last.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # k rows at most
    total = sum(r.cluster_inertia for r in inertia)
    told = [(r.cluster, r.cluster_inertia, total, hashlib.sha256(",".join(map(str, centroids[r.cluster].tolist())).encode()).hexdigest()) for r in inertia]
    clusters = rows.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return last.join(F.broadcast(clusters), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
