"""Spans of whatever length and frequency are proved again."""

import random

import duckdb
import pytest
from oracle import same
from quillmark.operators import validation as P
from quillmark.plans import QUERIES

LONG = 5000


def words_of(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdefgh", k=6)) for _ in range(n)]


def stands(needle, *hays):
    """Word by word: each of a needle's words stands in either of two streams, without a gap."""
    n = len(needle)
    return n > 0 and any(all(needle[x] in (h[k + x] for h in hays) for x in range(n)) for k in range(len(hays[0]) - n + 1))


def test_a_span_of_thousands_of_words_is_proved(spark):
    w = words_of(LONG + 20)
    asked = {1: w[7 : LONG + 7], 2: [*w[7 : LONG + 7], "forged"], 3: [*w[7:LONG], "forged", *w[LONG + 1 : LONG + 7]], 4: w}
    records = spark.createDataFrame([(9, ". ".join(w))], "id long, text string")
    found = spark.createDataFrame([(q, 9, ", ".join(x)) for q, x in asked.items()], "q long, rec long, quoted string")
    assert {r.q: r.ok for r in P.exact_again(found, records).collect()} == {1: True, 2: False, 3: False, 4: True}
    other = ["x" + x for x in w]
    mixed = {q: [other[w.index(x)] if x != "forged" and k % 3 == 0 else x for k, x in enumerate(asked[q])] for q in asked}
    hays = spark.createDataFrame([(9, w, other)], "rec long, first array<string>, second array<string>")
    found = spark.createDataFrame([(q, 9, x) for q, x in mixed.items()], "q long, rec long, needle array<string>")
    assert {r.q: r.ok for r in P.stands_again(found, hays).collect()} == {1: True, 2: False, 3: False, 4: True}


def test_proofs_equal_word_by_word(spark):
    rng = random.Random(7)
    some = lambda n: rng.choices(["a", "b", "aa", "é"], k=n)
    hays = {k: (x := some(rng.choice([0, 1, 5, 70, 140])), [rng.choice([y, "c"]) for y in x]) for k in range(40)}
    asked = []
    for q in range(400):
        rec = rng.randrange(42)  # two have no record
        x, y = hays.get(rec, (["a"], ["a"]))
        at, n = rng.randrange(len(x) + 1), rng.choice([0, 1, 2, 63, 64, 65, 128, 129])
        needle = [rng.choice(p) if q % 2 else p[0] for p in zip(x, y, strict=True)][at : at + n] if n > 2 else some(n)
        if needle and q % 5 == 0:
            needle[rng.randrange(len(needle))] = "b"
        asked.append((q, rec, needle))
    records = spark.createDataFrame([(k, " ".join(x)) for k, (x, _) in hays.items()] + [(40, None)], "id long, text string")
    got = P.exact_again(spark.createDataFrame([(q, rec, "-".join(x)) for q, rec, x in asked], "q long, rec long, quoted string"), records)
    assert {r.q: r.ok for r in got.collect()} == {q: stands(x, hays.get(rec, ([],))[0]) for q, rec, x in asked}
    streams = spark.createDataFrame([(k, *xy) for k, xy in hays.items()], "rec long, first array<string>, second array<string>")
    got = {r.q: r.ok for r in P.stands_again(spark.createDataFrame(asked, "q long, rec long, needle array<string>"), streams).collect()}
    assert got == {q: stands(x, *hays.get(rec, ([], []))) for q, rec, x in asked} and 50 < sum(got.values()) < 350


@pytest.mark.parametrize("case", ["long", "frequent", "several"])
def test_v6_equals_sql(spark, tmp_path, case):
    """A quotation of thousands of words, one whose every phrase stands in more than 4,000 items, and several of one item."""
    w = words_of(LONG)
    docs, items = {
        "long": ([["x", *w, "y"], w[:4000], ["x"]], [["z", *w], w[100:]]),
        "frequent": ([["x", *w[:7], "y"], w[1:7], w[:5]], [[*w[:7], f"n{k}"] for k in range(4001)]),
        "several": ([[*w[:8], "x", *w[10:18], "y", *w[20:27]], [*w[:8], "x", *w[:7], "Y"]], [[*w[:9], "z", *w[10:18], "z", *w[20:27], "z", *w[:8]]] * 3),
    }[case]
    c = duckdb.connect()
    for name, key, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", items)):
        spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(rows)], f"{key} long, text string").coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    q = QUERIES["validate_v6"]
    assert same(spark, q.run, q.sql, str(tmp_path), c) == {"long": 4, "frequent": 8002, "several": 6}[case]
