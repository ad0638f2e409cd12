import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from quillmark.llm import ball_clusters as B

SCHEMA = "vec_id long, embedding array<float>, id string, x int, cluster string, distance string"


def brute(rows, k, rounds, dimension, scale=256):
    kept = [(i, tuple(math.floor(scale * float(np.float32(c))) for c in v)) for i, v in rows if v is not None and len(v) == dimension and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        own = [(nearest(v)[1], v) for _, v in kept]
        for n in range(len(centroids)):
            mine = [v for m, v in own if m == n]
            if mine:
                centroids[n] = tuple(sum(column) // len(mine) for column in zip(*mine, strict=True))
    found = [(i, *reversed(nearest(v))) for i, v in kept]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    total = sum(r[2] for r in found)
    return sorted(((i, n, d, sum(r[2] for r in found if r[1] == n), total, digest[n]) for i, n, d in found), key=repr)


def run(spark, rows, **named):
    made = B.ball_kmeans(spark.createDataFrame([(i, v, "s", 1, "c", "d") for i, v in rows], SCHEMA), **named)
    assert made.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in made.collect()), key=repr)


@pytest.mark.parametrize("spread", [0.02, 0.5])
def test_equals_plain_rounds(spark, spread):
    rng = random.Random(3)
    centres = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(5)]
    rows = [(k, [c + rng.gauss(0, spread) for c in rng.choice(centres)]) for k in range(400)]
    rows += [(1000 + k, [0.25] * 6) for k in range(150)]  # ties and a vector that a third of all rows share
    rows += [(7, None), (8, []), (9, [1.0] * 5), (10, [None] + [1.0] * 5), (11, [math.nan] + [1.0] * 5), (12, [math.inf] + [1.0] * 5), (None, [0.5] * 6), (3, [0.5] * 6), (3, [0.5] * 6)]
    assert run(spark, rows, k=9, rounds=5, dimension=6) == brute(rows, 9, 5, 6)


def test_few_vectors_and_empty_tables(spark):
    rows = [(1, [0.1, 0.2]), (2, [-0.1, 0.2]), (2, [-0.1, 0.2])]
    assert run(spark, rows, k=40, rounds=5, dimension=2) == brute(rows, 40, 5, 2)
    assert run(spark, [], k=4, dimension=2) == []
    assert run(spark, [(1, None)], k=4, dimension=2) == []


def test_large_components(spark):
    rng = random.Random(5)
    rows = [(k, [float(np.float32(rng.uniform(-400_000, 400_000))) for _ in range(3)]) for k in range(60)]
    assert run(spark, rows, k=5, rounds=3, dimension=3) == brute(rows, 5, 3, 3)
    with pytest.raises(PySparkException, match="beyond"):
        run(spark, [(1, [1e30, 0.0, 0.0])], k=1, dimension=3)


def test_cores_and_annuli_leave_no_nearer_centroid_out():
    rng = np.random.default_rng(1)
    x, c = rng.integers(-300, 300, (3000, 4)), rng.integers(-300, 300, (25, 4))
    c[7] = c[3]
    full, far = B.assigned(x, None, B.Balls.of(c))
    labels = rng.integers(0, 25, len(x))
    own = np.array([((v - c[i]) ** 2).sum() for v, i in zip(x, labels, strict=True)])
    radii = np.array([np.sqrt(own[labels == i].max(initial=0)) for i in range(25)])
    got, way = B.assigned(x, labels, B.Balls.of(c, radii))
    assert (got == full).all() and (way == far).all()
    tight = B.Balls.of(c, np.full(25, 40.0))
    assert sum(map(len, tight.neighbours)) < 25 * 24  # a small ball has few neighbours
    near = np.flatnonzero(far <= 1600)
    got, way = B.assigned(x[near], full[near], tight)
    assert (got == full[near]).all() and (way == far[near]).all()
