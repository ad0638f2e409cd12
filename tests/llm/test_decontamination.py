import random
import re
import time

import pyarrow as pa
import pytest
from quillmark.llm import decontamination as D

SCHEMA = "doc_id long, text string, item_id string, coverage int"
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute_tiles(item, text, size):
    """Greedy string tiling, literally: the longest unmarked common run, first in the item and then in the text."""
    a, b, tiles = [None] * len(item), [None] * len(text), []
    while True:
        best = (size - 1, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and not a[i + n] and not b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < size:
            return tiles
        tiles.append((i, j, n))
        a[i : i + n] = b[j : j + n] = [1] * n


@pytest.fixture(scope="module")
def case():
    rng = random.Random(11)
    pool = "the of and to in x1 x2 x3 x4 é averylongword1tailtailtail averylongword2tailtailtail".split()
    items = [(k, " ".join(rng.choice(pool) for _ in range(rng.randrange(3, 26)))) for k in range(12)] + [(90, None), (91, ""), (92, "two words")]
    docs = [(0, None), (1, ""), (2, "a " * 40000)]
    for k in range(3, 150):
        parts = [rng.choice(pool) for _ in range(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            w = words(rng.choice(items[:12])[1])
            if rng.random() < 0.6 and len(w) > 8:
                w = w[len(w) // 2 :] + [","] + w[: len(w) // 2]
            parts += w
        docs.append((k, " ".join(parts).upper() if k % 2 else " ".join(parts)))
    return items, docs


@pytest.mark.parametrize("block", [2_000_000, 60])
def test_equals_brute_force(spark, case, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_WORDS", block)
    items, docs = case
    wanted = {}
    for d, text in docs:
        if d == 2:
            continue
        for i, item in items:
            a, b = words(item), words(text)
            tiles = brute_tiles(a, b, 4)
            if tiles and sum(n for *_, n in tiles) >= 0.5 * len(a):
                wanted[d, i] = tiles
    table = spark.createDataFrame([(d, t, "clash", 1) for d, t in docs], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.contaminated(table, bench).collect()
    assert {(r.doc_id, r.item_id): [(t.item_word, t.text_word, t.n_words) for t in r.tiles] for r in got} == wanted and len(wanted) > 40
    assert all(r.n_words == sum(t.n_words for t in r.tiles) and r.n_tiles == len(r.tiles) for r in got)
    kept = D.decontaminate(table, bench)
    assert kept.schema == table.schema and {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in wanted}


def test_edges(spark, case):
    items, docs = case
    bench = spark.createDataFrame(items, "item_id long, text string")
    text = items[0][1] if len(words(items[0][1])) >= 4 else items[1][1]
    repeated = spark.createDataFrame([(None, text, "", 1), (5, text, "", 1), (5, text, "", 1)], SCHEMA)
    assert sorted(str(r.doc_id) for r in D.contaminated(repeated, bench).where("coverage = 1").collect())[:2] == ["5", "5"]
    assert D.contaminated(repeated.limit(0), bench).collect() == []
    assert D.contaminated(repeated, bench.limit(0)).collect() == []
    assert D.decontaminate(repeated, bench.limit(0)).count() == 3


def test_long_words_that_differ_in_the_middle():
    item = [f"w{k}" for k in range(9)] + ["abcdefghXXabcdefgh"] + [f"v{k}" for k in range(10)]
    text = [*item[:9], "abcdefghYYabcdefgh", *item[10:]]
    tiler = D.Tiler([(1, " ".join(item))])
    assert [(t, n) for _, _, t in tiler.find(pa.array([" ".join(text)])) for n in [sum(x[2] for x in t)]] == [([(10, 10, 10), (0, 0, 9)], 19)]


def test_a_failed_verification_keeps_the_verified_parts():
    item, text = list("abcdefghij"), list("abcdXfghij")
    assert D.tile([(0, 0, 10)], item, lambda a, b: text[a:b], 4) == [(5, 5, 5), (0, 0, 4)]


def test_a_phrase_repeated_in_items_and_text_is_bounded():
    phrase = "alpha beta gamma delta "
    tiler, began = D.Tiler([(k, phrase * (8 + k % 5)) for k in range(50)]), time.perf_counter()
    found = list(tiler.find(pa.array([phrase * 25_000])))
    assert len(found) == 50 and all(len(t) == 1 for _, _, t in found) and time.perf_counter() - began < 10


def test_small_steps_find_the_same(case, monkeypatch):
    items, docs = case
    texts = pa.array([t for _, t in docs[3:]])
    whole = list(D.Tiler(items).find(texts))
    monkeypatch.setattr(D, "STEP", 5)
    assert list(D.Tiler(items).find(texts)) == whole and whole
