import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from quillmark.llm import near_dups as N
from quillmark.llm.graphs import connected

SCHEMA = "doc_id long, text string, fingerprint string, f int"


def brute_components(ids, near):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in near:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {i: root(i) for i in ids}


def brute_fingerprint(text, size=3):
    words, low = [], (text or "").translate({c: c + 32 for c in range(65, 91)})
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    runs = [" ".join(words[k : k + size]) for k in range(len(words) - size + 1)] if len(words) >= size else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("bucket", [64, 2])
def test_links_connect_exactly_what_is_within_two_bits(spark, monkeypatch, bucket):
    monkeypatch.setattr(N, "BUCKET", bucket)
    rng = random.Random(8)
    values = {0, 2**64 - 1, 1 << 63, 3 << 62}
    for _ in range(25):
        base = rng.getrandbits(64)
        for _ in range(12):
            values.add(base)
            base ^= sum(1 << rng.randrange(64) for _ in range(rng.randrange(4)))
            base &= 2**64 - 1
    signed = {v: int(np.uint64(v).view(np.int64)) for v in values}
    rows = N.components(spark.createDataFrame([(k, signed[v]) for k, v in enumerate(sorted(values))], "doc_id long, fingerprint long"))
    order = sorted(values)
    near = [(i, j) for (i, a), (j, b) in combinations(enumerate(order), 2) if (a ^ b).bit_count() <= 2]
    assert {r.doc_id: r.component_id for r in rows.collect()} == brute_components(range(len(order)), near)


def test_documents(spark):
    rng = random.Random(9)
    base = [rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randrange(50)) for _ in range(400)]
    texts = [None, "", " \t\n", "one", "one two", "ONE two", "x " * 40000, "é ü É"]
    for k in range(30):
        words = base[:]
        words[rng.randrange(400)] = f"new{k}"
        texts.append(" ".join(words))
    given = [(i, t) for i, t in enumerate(texts)] + [(None, "one two"), (4, "one two")]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in given], SCHEMA)
    got = N.components(N.fingerprints(docs)).collect()
    prints = [brute_fingerprint(t) for t in texts]
    near = [(i, j) for (i, a), (j, b) in combinations(enumerate(prints), 2) if (a ^ b).bit_count() <= 2]
    wanted = brute_components(range(len(texts)), near)
    assert len(got) == len(given)
    for r in got:
        i = 4 if r.doc_id is None else r.doc_id
        assert (np.int64(r.fingerprint).view(np.uint64), r.component_id) == (prints[i], wanted[i])
    assert len(set(wanted.values())) < len(texts)


def test_connected(spark):
    rng = random.Random(10)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, k) for k in range(5001, 5300)]
    got = {r.node: r.label for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    ids = {x for a, b in links if a != b for x in (a, b)}
    assert got == {i: r for i, r in brute_components(range(6000), links).items() if i in ids}


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert N.components(N.fingerprints(docs)).collect() == []
