import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from quillmark.llm import packing
from tokenizers import Tokenizer

JSON = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(JSON)
SCHEMA = "doc_id long, text string, piece string, offset int"


def brute_best_fit(sizes, capacity):
    rooms, out = [], []
    for s in sizes:
        fits = [(r, b) for b, r in enumerate(rooms) if r >= s]
        if fits:
            r = min(fits)[0]
        else:
            rooms.append(r := capacity)
        out.append(capacity - r)
        rooms[rooms.index(r)] -= s
    return out, len(rooms)


def test_best_fit_equals_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        sizes = sorted((rng.randrange(1, 33) for _ in range(rng.randrange(1, 90))), reverse=True)
        bins, offsets = packing.best_fit(sizes, 32)
        offs, n = brute_best_fit(sizes, 32)
        assert offsets == offs and max(bins) + 1 == n


def optimum(sizes, capacity):
    best = len(sizes)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for b in sorted({r: b for b, r in enumerate(rooms) if r >= sizes[k]}.values()):
            rooms[b] -= sizes[k]
            place(k + 1, rooms)
            rooms[b] += sizes[k]
        place(k + 1, [*rooms, capacity - sizes[k]])

    place(0, [])
    return best


def test_bound_never_passes_the_optimum():
    rng, exact = random.Random(6), 0
    for _ in range(150):
        sizes = sorted((rng.randrange(1, 13) for _ in range(rng.randrange(1, 9))), reverse=True)
        bound, best = packing.lower_bound(np.bincount(sizes, minlength=13), 12), optimum(sizes, 12)
        assert bound <= best
        exact += bound == best
    assert exact > 120


def test_cut():
    assert packing.cut(5, 8) == [(0, 5)] and packing.cut(8, 8) == [(0, 8)]
    assert packing.cut(9, 8) == [(0, 1), (1, 8)] and packing.cut(16, 8) == [(0, 8), (8, 8)]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(7)
    texts = [None, "", "word " * 900] + [" ".join(rng.choices(["the", "é", "copy\nline", "x-y"], k=rng.randrange(1, 60))) for _ in range(300)]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "a b", "", 1), (7, texts[7], "", 1)]
    return spark.createDataFrame(rows, SCHEMA)


def test_whole_packing(spark, docs):
    capacity = 64
    wanted = defaultdict(list)
    for r in docs.collect():
        ids = [*LIBRARY.encode(r.text or "", add_special_tokens=False).ids, 0]
        for piece, (s, n) in enumerate(packing.cut(len(ids), capacity)):
            wanted[r.doc_id, piece].append((s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()), ids[s : s + n]))
    cut = packing.pieces(docs, JSON, capacity)
    packed = packing.pack_pieces(cut, capacity, group_rows=60)
    rows = packed.collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted((str(d), p, *x[:3]) for (d, p), xs in wanted.items() for x in xs)
    fills = defaultdict(list)
    for r in rows:
        fills[r.sequence_id].append((r.offset, r.length))
    for parts in fills.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    used, bound = packing.certificate(packed, capacity)
    assert used == len(fills) and bound <= used <= bound * 1.05
    alone = packing.certificate(packing._packed(packing.materialize(cut, "pieces"), capacity, -(-len(rows) // 60), 0, cut.columns, "packed"), capacity)[0]
    assert used <= alone
    made = packing.sequences(packing.pieces(docs, JSON, capacity, with_ids=True), packed).collect()
    assert len(made) == used
    for r in made:
        for d in r.documents:
            assert r.ids[d.offset : d.offset + d.length] in [x[3] for x in wanted[d.doc_id, d.piece]]


def test_empty(spark, docs):
    assert packing.pack_pieces(packing.pieces(docs.limit(0), JSON)).collect() == []


def test_ids_of_any_type(spark, docs):
    named = packing.pieces(docs.selectExpr("'id' || doc_id as doc_id", "text"), JSON, 64)
    rows = packing.pack_pieces(named, 64, group_rows=60).collect()
    assert len(rows) == named.count() and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


def test_the_exchange_saves_bins(spark):
    rng = random.Random(3)
    rows = spark.createDataFrame([(k, 0, 0, min(2048, max(1, int(rng.lognormvariate(6.4, 0.8)))), k) for k in range(6000)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    used, bound = packing.certificate(packing.pack_pieces(rows, group_rows=600))
    alone = packing.certificate(packing._packed(rows, 2048, 10, 0, rows.columns, "packed"))[0]
    assert bound <= used < alone
