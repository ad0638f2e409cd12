import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F
from quillmark.llm import near_copies as N
from quillmark.llm import near_dups as D
from quillmark.llm import prefix_join as P
from quillmark.llm.near_dups import shingles

SCHEMA = "doc_id long, text string, label string, node int"


def brute_kept(rows, similarity=0.8):
    """Ids left when links are all pairs of distinct texts whose shingle sets are similar enough."""
    texts = sorted({t or "" for _, t in rows})
    sets = [set(shingles(t, 5)) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and both >= similarity * (len(sets[i]) + len(sets[j]) - both):
            parent[root(i)] = root(j)
    groups = {}
    for i, t in rows:
        groups.setdefault(root(texts.index(t or "")), []).append(i)
    return sorted(min(ids, key=lambda i: (i is None, i)) for ids in groups.values())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(13)
    word = lambda: "".join(rng.choice(["an", "the", "tion", "re", "hed", "ing", "or"]) for _ in range(rng.randrange(1, 5)))
    rows = [(0, None), (1, ""), (2, "one"), (3, "ONE"), (4, "one two"), (5, "x " * 50000)]
    for _ in range(60):
        base = [word() for _ in range(rng.randrange(60, 300))]
        for _ in range(rng.randrange(1, 5)):
            copy = base[:]
            for k in rng.sample(range(len(copy)), rng.randrange(0, max(1, len(copy) // 40))):
                copy[k] = word()
            rows.append((len(rows), " ".join(copy)))
    return rows + [(len(rows), rows[20][1]), (7, rows[7][1])]


@pytest.mark.parametrize("bucket", [64, 8, 1])
def test_equals_brute_force(spark, rows, monkeypatch, bucket):
    monkeypatch.setattr(D, "BUCKET", bucket)
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA)
    kept = N.drop_near_copies(docs)
    assert kept.schema == docs.schema
    assert sorted(r.doc_id for r in kept.collect()) == brute_kept(rows)


@pytest.mark.parametrize(("frequent", "group", "star", "batch", "counted"), [(2, 2, 4, 3, 4), (2, 3, 65536, 1, 1), (4, 4096, 65536, 10000, 1000)])
def test_any_setting_finds_the_same(spark, rows, monkeypatch, frequent, group, star, batch, counted):
    monkeypatch.setattr(P, "COUNTED", counted)
    monkeypatch.setattr(P, "FREQUENT_FROM", frequent)
    monkeypatch.setattr(P, "GROUP", group)
    monkeypatch.setattr(P, "STAR", star)
    monkeypatch.setattr(N, "_light_pairs", lambda nodes: nodes.where("false").selectExpr("node as a", "node as b"))  # the exact path alone
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA)
        assert sorted(r.doc_id for r in N.drop_near_copies(docs).collect()) == brute_kept(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c", 5, 7, "x", "y"), (2, "a b c", 6, 8, "z", "w"), (2, "other", 6, 8, "z", "w")], "__id long, text string, digest int, node int, row string, `k.id` string")
    kept = N.drop_near_copies(docs, id_col="__id")
    assert kept.schema == docs.schema and sorted(tuple(r) for r in kept.collect()) == [(1, "a b c", 5, 7, "x", "y"), (2, "other", 6, 8, "z", "w")]
    named = docs.withColumn("__id", F.lit("id"))
    assert N.drop_near_copies(named, id_col="__id").count() == 2


def test_nothing_clean_is_dropped(spark):
    docs = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(50)), "", 1) for k in range(80)] + [(None, "same words here", "", 1), (200, "same words here", "", 2)], SCHEMA)
    assert sorted(r.doc_id for r in N.drop_near_copies(docs).collect()) == [*range(80), 200]


def test_empty(spark):
    assert N.drop_near_copies(spark.createDataFrame([], SCHEMA)).collect() == []


def test_links_that_no_fingerprint_candidate_brings(spark):
    rng = random.Random(29)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(8))
    rows = []
    for words, more in [(200, 20), (200, 40), (60, 12), (12, 2)] * 30:
        base = [word() for _ in range(words)]
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(base + [word() for _ in range(more)]))]
    docs = spark.createDataFrame([(i, t, "", 1) for i, t in rows], SCHEMA)
    assert sorted(r.doc_id for r in N.drop_near_copies(docs).collect()) == brute_kept(rows)


def test_links_of_crowded_buckets_and_frequent_shingles(spark, monkeypatch):
    rng = random.Random(31)
    long = ["boilerplate", "paragraph", "template"]  # few long words: all fingerprints are equal, one crowded bucket
    rows = []
    for _ in range(40):
        base = [w for _ in range(40) for w in (rng.choice(["an", "the", "re", "or", "ing", "hed"]), rng.choice(long))]
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(base + ["an"]))]
    monkeypatch.setattr(D, "BUCKET", 8)
    monkeypatch.setattr(P, "FREQUENT_FROM", 2)
    monkeypatch.setattr(P, "GROUP", 2)
    docs = spark.createDataFrame([(i, t, "", 1) for i, t in rows], SCHEMA)
    assert sorted(r.doc_id for r in N.drop_near_copies(docs).collect()) == brute_kept(rows)


def test_scanning_takes_little_memory_however_many_texts_a_batch_has():
    import tracemalloc

    import pyarrow as pa
    from quillmark.llm.near_copies import word_fingerprints

    column = pa.array([" ".join(f"word{k * j % 9973}" for j in range(400)) for k in range(1500)], pa.string())
    tracemalloc.start()
    found = len(word_fingerprints(column))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == len(column)
    assert peak < 16 << 20
