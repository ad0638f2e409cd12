import random
import tracemalloc

import numpy as np
import pytest
from quillmark.llm import suffix_dedup as S

SCHEMA = "doc_id long, text string, doc string, h int, spans string, start int"


def brute(rows, span):
    """Kept bytes and removed runs of each row, by all strings of all rows."""
    raw = [(-(1 << 63) if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in raw:
        for p in range(len(b) - span + 1):
            s = b[p : p + span]
            first[s] = min(first.get(s, (i, p)), (i, p))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - span + 1):
            if first[b[p : p + span]] < (i, p):
                gone[p : p + span] = True
        cuts = np.flatnonzero(np.diff(np.r_[0, gone.view(np.int8), 0]))
        out.append((None if i == -(1 << 63) else i, len(b), tuple(zip(cuts[::2].tolist(), cuts[1::2].tolist(), strict=True)), bytes(np.frombuffer(b, np.uint8)[~gone])))
    return sorted(out, key=repr)


def run(spark, rows, span):
    made = S.remove_repeats(spark.createDataFrame([(i, t, "x", 1, "y", 2) for i, t in rows], SCHEMA), span)
    assert made.columns == ["doc_id", "n_bytes", "spans", "kept"]
    return sorted(((r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in made.collect()), key=repr)


def passages(rng, n):
    words = [chr(97 + k) * rng.randrange(1, 5) + rng.choice(["", "é", "日本", "😀"]) for k in range(20)]
    line = " ".join(rng.choices(words, k=40))
    shared = [" ".join(rng.choices(words, k=rng.randrange(5, 60))) for _ in range(6)]
    rows = []
    for k in range(n):
        parts = [" ".join(rng.choices(words, k=rng.randrange(60))) for _ in range(rng.randrange(1, 4))]
        for _ in range(rng.randrange(3)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice([*shared, line]))
        rows.append((k, " ".join(parts)))
    return rows


@pytest.mark.parametrize(("span", "crowded"), [(100, False), (10, False), (30, True)])
def test_equals_all_strings(spark, monkeypatch, span, crowded):
    rng = random.Random(span)
    rows = passages(rng, 120)
    rows += [(500 + k, rows[k % 3][1]) for k in range(40)]  # copies
    near = rows[5][1] * 3
    rows += [(600 + k, near[:k] + "#" + near[k + 7 :]) for k in range(0, 60, 3)]  # near copies
    rows += [(900, "ab" * 400), (901, "a" * 700), (902, "a" * 99), (903, "a" * 100), (None, rows[7][1]), (904, None), (905, ""), (3, rows[8][1]), (3, rows[3][1]), (3, rows[3][1])]
    rng.shuffle(rows)
    if crowded:
        monkeypatch.setattr(S, "HOT", 3)
    assert run(spark, rows, span) == brute(rows, span)


def test_blocks_and_flushes_make_no_difference(spark, monkeypatch):
    rng = random.Random(2)
    rows = passages(rng, 40)
    rows.append((77, " ".join(t for _, t in rows) * 2))
    want = brute(rows, 40)
    assert run(spark, rows, 40) == want
    monkeypatch.setattr(S, "BLOCK", 257)
    monkeypatch.setattr(S, "FLUSH", 100)
    monkeypatch.setattr(S, "SAMPLE_TEXTS", 5)
    assert run(spark, rows, 40) == want


def test_one_line_in_every_text(spark):
    rng = random.Random(6)
    line = "x".join(str(rng.random()) for _ in range(8))
    rows = [(k, f"{rng.random()} {line} {rng.random()}") for k in range(800)]
    assert run(spark, rows, 100) == brute(rows, 100)


def test_empty_tables(spark):
    assert run(spark, [], 100) == []
    assert run(spark, [(1, None), (None, "")], 100) == brute([(1, None), (None, "")], 100)


def test_multikey_quicksort():
    rng = np.random.default_rng(1)
    for span in (4, 8, 13, 100):
        data = rng.integers(0, 2, 900).astype(np.uint8)
        data[500:800] = data[100:400]
        starts = rng.permutation(900 - span)
        groups = starts % 2
        rows, class_ = S.same_strings(data, starts, span, groups)
        by = {}
        for r, s in enumerate(starts.tolist()):
            by.setdefault((int(groups[r]), data[s : s + span].tobytes()), set()).add(r)
        got = {}
        for r, c in zip(rows.tolist(), class_.tolist(), strict=True):
            got.setdefault(c, set()).add(r)
        assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in by.values() if len(v) > 1)


def test_finding_anchors_takes_little_memory_however_long_the_text():
    anchors, data = S.Anchors.of(100), np.random.default_rng(3).integers(97, 123, 5 << 20, np.uint8)
    tracemalloc.start()
    found = sum(len(start) for start, *_ in anchors.find(data, np.array([0, len(data)])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found > 10_000
    assert peak < (48 << 20) + 8 * len(data)  # limits of all strings, and the arrays of a block


def test_contexts_are_cut_and_placed_in_one_pass(spark):
    texts = S._texts(spark.createDataFrame([(1, "a" * 300)], "doc_id long, text string"), "doc_id", "text")
    edges = spark.createDataFrame([(1, 0, 0, 5, 1, 7)], "doc long, h long, start int, off int, count int, lead long")
    plan = S._compared(S._contexts(texts, edges, S.Anchors.of(100), np.zeros(0, S._ORDERED)), S.Anchors.of(100), 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2  # a second one in the task that cuts would be a second Python worker beside the first
