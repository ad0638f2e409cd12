import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from quillmark.llm import vector_search as V
from quillmark.llm.vector_search import Hashes, Plan, nearest

SCHEMA = "vec_id long, embedding array<float>, rank string, score int"


def brute(rows, queries, k):
    """(query, rank) to (vector, score), from the definition."""
    usable = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in usable:
        if i in queries:
            near = sorted(((-float((v * w).sum()), j) for j, w in usable if j != i))[:k]
            out |= {(i, r): (j, -s) for r, (s, j) in enumerate(near, 1)}
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=8) * rng.uniform(0.2, 3)).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(30)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 8), (2003, [1.0, None] + [0.0] * 6), (2004, [math.nan] + [1.0] * 7), (2005, [math.inf] + [1.0] * 7), (None, [1.0] * 8), (2006, [1.0] * 5)]
    return rows


@pytest.mark.parametrize("block", [8192, 16])
def test_all_cells_give_the_exact_answer(spark, rows, block):
    table = spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], SCHEMA)
    plan = Plan(tables=3, projections=3, width=2.0, probes=20, block=block)
    wanted = brute([r for r in rows if r[0] != 2006], {i for i, _ in rows if i is not None and i % 20 == 0}, 20)
    got = nearest(table, table.where("vec_id % 20 = 0"), 20, Plan(tables=1, projections=1, width=1e6, probes=3, block=block)).collect()
    assert {(r.query_id, r.rank): (r.vec_id, r.score) for r in got} == wanted
    some = {(r.query_id, r.vec_id) for r in nearest(table, table.where("vec_id % 20 = 0"), 20, plan).collect()}
    assert len(some & {(q, j) for (q, _), (j, _) in wanted.items()}) > 0.6 * len(wanted)


def test_visits_are_in_order_of_distance():
    h = Hashes(Plan(tables=1, projections=4, probes=20), 5)
    rng = np.random.default_rng(4)
    places = rng.uniform(-3, 3, size=(6, 4))
    for p, names in zip(places, h.visits(places, 20), strict=True):
        own = np.floor(p)
        cost = [sum(((p - own) ** 2)[s < 0]) + sum(((1 - p + own) ** 2)[s > 0]) for s in h.steps]
        wanted = [h.name((own + h.steps[k]).astype(np.int64)) for k in np.argsort(cost, kind="stable")[:20]]
        assert names.tolist() == [int(x) for x in wanted]


def test_recall_on_the_tables(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = nearest(table, table.where("vec_id % 20 = 0")).select("query_id", "vec_id").collect()
    wanted = brute([(r.vec_id, r.embedding) for r in table.collect()], set(range(0, 2000, 20)), 20)
    found = {tuple(r) for r in got}
    assert sum((q, j) in found for (q, _), (j, _) in wanted.items()) >= 0.9 * len(wanted)


def test_edges(spark, rows):
    table = spark.createDataFrame([(i, v, "", 1) for i, v in rows], SCHEMA)
    assert nearest(table.limit(0), table.limit(0)).collect() == []
    few = spark.createDataFrame([(0, [1.0, 0.0], "", 1), (20, [0.5, 0.5], "", 1), (20, [0.5, 0.5], "", 1)], SCHEMA)
    assert sorted(map(tuple, nearest(few, few.where(F.col("vec_id") % 20 == 0)).collect())) == [(0, 1, 20, 0.5), (0, 2, 20, 0.5), *[(20, 1, 0, 0.5)] * 2, *[(20, 2, 20, 0.5)] * 2]  # the repeated row is a query and a candidate of its own


def recall(got, rows, queries, k=20):
    wanted = brute(rows, queries, k)
    found = {(r.query_id, r.vec_id) for r in got}
    assert len(got) == len(wanted)
    return sum((q, j) in found for (q, _), (j, _) in wanted.items()) / len(wanted)


@pytest.mark.parametrize("norms", ["lognormal", "one very long", "two scales"])
def test_recall_on_uneven_norms(spark, norms):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 32))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    x *= {"lognormal": rng.lognormal(size=(3000, 1)), "one very long": np.where(np.arange(3000) == 77, 100.0, 1.0)[:, None], "two scales": np.where(np.arange(3000) % 2, 1e-3, 1.0)[:, None]}[norms]
    rows = [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())]
    table = spark.createDataFrame([(i, v, "", 1) for i, v in rows], SCHEMA)
    plan = Plan(block=100)  # so that bands are hashed here too
    assert recall(nearest(table, table.where("vec_id % 20 = 0"), plan=plan).collect(), rows, set(range(0, 3000, 20))) >= 0.9


def test_too_few_in_the_cells_is_answered_exactly(spark):
    rng = np.random.default_rng(7)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(200, 8)).astype(np.float32).tolist())]
    table = spark.createDataFrame([(i, v, "", 1) for i, v in rows], SCHEMA)
    got = nearest(table, table.where("vec_id % 20 = 0"), plan=Plan(tables=1, projections=8, width=0.3, probes=2, block=50)).collect()
    assert recall(got, rows, set(range(0, 200, 20))) == 1


def test_a_vector_that_many_rows_share(spark):
    rng = np.random.default_rng(8)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(300, 8)).astype(np.float32).tolist())]
    rows += [(1000 + i, rows[3][1]) for i in range(200)]
    table = spark.createDataFrame([(i, v, "", 1) for i, v in rows], SCHEMA)
    got = nearest(table, table.where("vec_id % 20 = 0"), plan=Plan(tables=1, projections=1, width=1e6, probes=3, block=64)).collect()
    assert {(r.query_id, r.rank): (r.vec_id, r.score) for r in got} == brute(rows, {i for i, _ in rows if i % 20 == 0}, 20)


def test_shuffled_rows_grow_with_vectors_and_visits(spark):
    plan, made = Plan(tables=2, projections=6, width=1.0, probes=8, block=32), []
    for n in (1000, 4000):
        rng = np.random.default_rng(9)
        cells = V.Cells(plan, 16, [V.Band(0, 8.0, plan.probes)])
        x = rng.normal(size=(n, 16))
        kept = sum(len(rows) for rows, _ in cells.kept(x, np.zeros(n, np.int32)))
        rows, names = cells.visited(x[::20])
        blocks = -(-n * plan.tables // plan.block)
        visits = len({(r, b) for r, b in zip(rows.tolist(), V._block(names, np.zeros(len(names), np.int64), blocks).tolist(), strict=True)})
        assert kept == n * plan.tables and visits <= n // 20 * plan.tables * plan.probes
        made.append((kept + visits) / n)
    assert made[1] < 1.2 * made[0]


def test_extreme_norms(spark):
    rows = [(0, [1e30, 0.0]), (20, [1e-30, 1e-30]), (1, [1.0, 1.0])]
    table = spark.createDataFrame([(i, v, "", 1) for i, v in rows], SCHEMA)
    got = {(r.query_id, r.rank): r.vec_id for r in nearest(table, table.where("vec_id % 20 = 0")).collect()}
    assert got == {(0, 1): 1, (0, 2): 20, (20, 1): 0, (20, 2): 1}


def test_rows_count_as_they_stand(spark):
    """Repeated ids and rows: only the query's own row is left out."""
    rows = [(20, [1.0, 0.0]), (1, [0.9, 0.1]), (1, [0.5, 0.5]), (3, [0.8, 0.3]), (3, [0.8, 0.3]), (40, [0.2, 1.0]), (40, [0.2, 1.0]), (40, [1.0, 0.2]), (7, [0.9, 0.1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, V.nearest(table, table.where("vec_id % 20 = 0"), k=20).collect()))
    want = []
    for at, (q, v) in enumerate(rows):
        if q % 20 == 0:
            near = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for k, (i, w) in enumerate(rows) if k != at)
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(near)]
    assert [x[:3] for x in got] == [x[:3] for x in sorted(want)] and len(got) == 4 * 8
