import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F
from quillmark.operators import alignment as A

LETTERS, MARKS = "ابتحدرسصعقلمنهويأإة", "ًٌٍَُِّْٰ"


def word(rng):
    return "".join(rng.choice(LETTERS) + "".join(rng.choices(MARKS, k=rng.choice([0, 0, 1, 2]))) for _ in range(rng.randrange(1, 8)))


def edited(rng, w):
    k = rng.randrange(len(w) + 1)
    return rng.choice([w[:k] + rng.choice(LETTERS) + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice(LETTERS + MARKS) + w[k + 1 :], word(rng)]) or "ا"


def test_letters_never_split_from_their_marks(spark):
    rng = random.Random(1)
    pairs = [(w, edited(rng, w)) for w in (word(rng) for _ in range(500))] + [("", "قلم"), ("قلم", ""), ("xyz", "قلم"), (None, "قلم"), ("ﻻ", "لا"), ("آن", "آن"), ("کیف", "كيف")]
    rows = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, a string, b string").repartition(3)
    got = {r.k: r.d for r in rows.select("k", A.letter_diff(F.col("a"), F.col("b")).alias("d")).collect()}
    for k, (a, b) in enumerate(pairs):
        if a is None:
            assert got[k] is None
            continue
        for w, ranges in ((a, got[k].quote), (b, got[k].source)):
            for x, y in ranges:
                assert x < y <= len(w) and w[x] not in MARKS and (y == len(w) or w[y] not in MARKS)
        kept = ["".join(c[0] for c in A.clusters(w, True) if not any(x <= c[1] < y for x, y in r)) for w, r in ((a, got[k].quote), (b, got[k].source))]
        if got[k].quote or got[k].source:
            assert kept[0] == kept[1]  # what isn't marked is the same on both sides
    assert got[505].quote == got[505].source == [] and got[506].quote == []


def test_words_with_places_and_other_edition(spark):
    rng = random.Random(2)
    rows = []
    for k in range(200):
        s = [rng.choice("ab cd ef gh ij kl".split()) for _ in range(rng.randrange(0, 9))]
        q = [w if rng.random() < 0.7 else rng.choice(["zz", "ab", "abx"]) for w in s if rng.random() < 0.9]
        rows.append((k, q, s, [w + "'" if rng.random() < 0.2 else w for w in s]))

    def spans(words):
        out, at = [], 0
        for w in words:
            out.append({"strict": w, "start": at, "end": at + len(w)})
            at += len(w) + 1
        return out

    word_type = "array<struct<strict:string,start:int,end:int>>"
    table = spark.createDataFrame([(k, " ".join(q), spans(q), " ".join(s), spans(s), o) for k, q, s, o in rows], f"k int, quote string, q {word_type}, source string, s {word_type}, other array<string>")
    got = {r.k: r.ops for r in table.select("k", A.word_ops(F.col("quote"), F.col("q"), F.col("source"), F.col("s"), F.col("other")).alias("ops")).collect()}
    for k, q, s, o in rows:
        there = [b if a not in q and b in q else a for a, b in zip(s, o, strict=True)]
        assert [(x.op, *x.quote_range, *x.source_range) for x in got[k]] == SequenceMatcher(None, q, there, autojunk=False).get_opcodes()
        for x in got[k]:
            assert " ".join(q)[slice(*x.quote_chars)].split() == q[slice(*x.quote_range)]
            assert " ".join(s)[slice(*x.source_chars)].split() == s[slice(*x.source_range)]
            if x.quote_letters or x.source_letters:
                assert x.op == "replace" and x.quote_range[1] - x.quote_range[0] == x.source_range[1] - x.source_range[0] == 1
