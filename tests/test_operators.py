import random

from pyspark.sql import functions as F
from quillmark.functions.arrays import running
from quillmark.operators import intervals, matching
from quillmark.operators import tables as T


def test_running_sums(spark):
    rows = [([random.randrange(9) for _ in range(n)],) for n in (0, 1, 2, 63, 64, 65, 200, 5000)]
    for r in spark.createDataFrame(rows, "a array<int>").select("a", running(F.col("a")).alias("r")).collect():
        assert r.r == [sum(r.a[:k]) for k in range(len(r.a))]


def test_a_quotation_runs_across_a_frequent_phrase(spark):
    common = "of the old and new".split()
    corpus = [(k, common) for k in range(20)] + [(100, ["alpha", "beta", "gamma", "delta", *common, "eta", "theta", "iota", "kappa"])]
    stream = spark.createDataFrame([(i, w, w) for i, w in corpus], "id long, loose array<string>, strict array<string>")
    texts = spark.createDataFrame([(1, ["x", *corpus[-1][1], "y"], ["x", *corpus[-1][1], "y"]), (2, common, common)], "id long, loose array<string>, strict array<string>")
    got = matching.runs(matching.seeds(texts, stream, most=10)).collect()
    assert [(r.text, r.id, r.i, r.j, r.n) for r in got] == [(1, 100, 1, 0, 13)]


def test_rate_limit_of_a_busy_key(spark):
    rng = random.Random(4)
    rows = [(1, at, k) for k, at in enumerate(sorted(rng.randrange(3000) for _ in range(5000)))] + [(2, 5, 9000)]
    got = sorted(intervals.rate_limited(spark.createDataFrame(rows, "key long, at long, request long"), 3, 60).collect(), key=lambda r: (r.key, r.at, r.request))
    let = []
    for r in got[:-1]:
        assert r.allowed == (len([t for t in let if t > r.at - 60]) < 3)
        let += [r.at] if r.allowed else []
    assert got[-1].allowed and len(got) == 5001


def test_tables_are_made_once_for_a_source(spark, tmp_path):
    source, made = f"file://{tmp_path}/source", []
    spark.range(3).write.parquet(source)

    def make():
        made.append(1)
        return spark.read.parquet(source).selectExpr("id + 1 as id")

    for _ in range(2):
        assert sorted(r.id for r in T.stored(spark, source, "plus-one", make).collect()) == [1, 2, 3]
    assert len(made) == 1
