import random
import time

import pytest
from pyspark.sql import functions as F
from quillmark.operators import evaluation as V
from quillmark.operators import extraction as E
from quillmark.operators import intervals as N
from quillmark.operators import segments as G

LABELS = ["", "Ayah", "matn", "isnad", "claimed_source"]


def brute_cells(truth, guess, n):
    cells = {}

    def paint(spans):
        out = [""] * n
        for _, a, b, label in sorted(spans):
            for k in range(max(a, 0), min(b, n)):
                out[k] = label
        return out

    for t, p in zip(paint(truth), paint(guess), strict=True):
        cells[t, p] = cells.get((t, p), 0) + 1
    return cells


def test_swept_equals_painting(spark):
    rng = random.Random(1)
    lengths, truth, guess = {}, {}, {}
    for k in range(60):
        lengths[k] = rng.choice([0, 1, 30, 80])
        for side in (truth, guess):
            side[k] = [(o, a := rng.randrange(-3, 80), a + rng.randrange(0, 30), rng.choice(LABELS[1:])) for o in range(rng.randrange(6))]
    schema = "id int, ord int, start int, end int, label string"
    tables = [spark.createDataFrame([(k, *s) for k, v in side.items() for s in v], schema) for side in (truth, guess)]
    rows = V.swept(*tables, spark.createDataFrame(list(lengths.items()), "id int, n int"))
    got = {}
    for r in rows.collect():
        got.setdefault(r.id, {})[r.truth, r.predicted] = r.n
    assert got == {k: c for k in lengths if (c := brute_cells(truth[k], guess[k], lengths[k]))}
    total = {}
    for cells in got.values():
        for key, n in cells.items():
            total[key] = total.get(key, 0) + n
    f1 = {r.label: r.f1 for r in V.class_f1(rows, LABELS[1:]).collect()}
    for x in LABELS[1:]:
        t, p = (sum(n for key, n in total.items() if key[s] == x) for s in (0, 1))
        assert f1[x] == pytest.approx(2 * total.get((x, x), 0) / (t + p), abs=1e-6)
    matrix = {r.truth: [r[x] for x in LABELS] for r in V.confusion(rows, LABELS).collect()}
    assert matrix == {x: [total.get((x, y), 0) for y in LABELS] for x in LABELS}
    bare = spark.createDataFrame([(k,) for k in truth if not truth[k] and lengths[k]], "id int")
    scores = {r.id: r.f1 for r in V.character_scores(rows, bare).collect()}
    for k in got:
        if not truth[k]:
            assert scores[k] == (1.0 if all(p == "" for _, p in got[k]) else 0.0)


def brute_merged(spans):
    out = []
    for s in sorted(spans, key=lambda s: (s[0], -s[1], s[2], s[3])):
        if not out or s[0] >= out[-1][1]:
            out.append(s)
        elif s[3] and not out[-1][3] and s[1] <= out[-1][1]:
            out[-1] = s
        elif s[3] or not out[-1][3]:
            a, b, kind, marked = out[-1]
            out[-1] = (a, max(b, s[1]), s[2] if kind == "unknown" else kind, marked)
    return out


def test_merged_and_uncovered(spark):
    rng = random.Random(2)
    schema = "id int, start int, end int, kind string, marked boolean"
    some = lambda n: [(a := rng.randrange(60), a + rng.randrange(0, 20), rng.choice(["unknown", "quran", "hadith_matn"]), rng.random() < 0.4) for _ in range(n)]
    one, two = ({k: some(rng.randrange(9)) for k in range(80)} for _ in range(2))
    a, b = (spark.createDataFrame([(k, *s) for k, v in x.items() for s in v], schema) for x in (one, two))
    got = {}
    for r in E.merged(a).collect():
        got.setdefault(r.id, []).append((r.start, r.end, r.kind, r.marked))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(brute_merged(v)) for k, v in one.items() if v}
    free = sorted((k, *s) for k, v in one.items() for s in v if not any(x[0] < s[1] and s[0] < x[1] for x in two[k]))
    assert sorted(map(tuple, E.uncovered(a, b).collect())) == free
    merged_b = {k: brute_merged(v) for k, v in two.items()}
    anchors = spark.createDataFrame([(k, *s) for k, v in merged_b.items() for s in v], schema)
    none = spark.createDataFrame([], schema)
    told = {(r.id, r.start, r.end, r.kind) for r in G.augmented(a, none, anchors).collect()}
    for k, v in one.items():
        for s in v:
            over = [x for x in merged_b[k] if x[0] < s[1] and s[0] < x[1]]
            assert (k, s[0], s[1], over[0][2] if s[2] == "unknown" and over else s[2]) in told


def test_many_spans_in_one_text(spark):
    """Ten times the spans must not take a hundred times as long."""
    took = {}
    for n in (10_000, 100_000):
        spans = spark.range(n).select(F.lit(1).alias("id"), (F.col("id") * 3).cast("int").alias("start"), (F.col("id") * 3 + 4).cast("int").alias("end"), F.lit("unknown").alias("kind"), (F.col("id") % 2 == 0).alias("marked"))
        labelled = spans.select("id", F.col("start").alias("ord"), "start", "end", F.lit("matn").alias("label"))
        lengths = spark.createDataFrame([(1, 3 * n + 10)], "id int, n int")
        began = time.perf_counter()
        assert E.merged(spans).count() >= 1
        assert E.uncovered(spans, spans).count() == 0
        assert G.augmented(spans, spans.limit(0), spans.where("marked")).count() == n
        assert V.swept(labelled, labelled, lengths).agg(F.sum("n")).first()[0] == 3 * n + 10
        assert N.annotation_runs(lengths, spans).count() >= n
        took[n] = time.perf_counter() - began
    assert took[100_000] < 60 and took[100_000] < 40 * took[10_000]
