import random

import pytest
from pyspark.sql import functions as F
from quillmark.operators import anchors as N


def brute(text, stream, verses, rule):
    """Anchors of a text, word by word. ``stream``: {id: words}; ``verses``: {(id, first): n}."""

    def occurs(words):
        return [(s, k) for s, w in stream.items() for k in range(len(w) - len(words) + 1) if w[k : k + len(words)] == words]

    out, i, n = [], 0, len(text)
    while i + rule.short <= n:
        s = rule.size if i + rule.size <= n else rule.short
        live = occurs(text[i : i + s])
        if all(w in rule.stop for w in text[i : i + s]) or not 0 < len(live) <= rule.most:
            i += 1
            continue
        j, low = i + s, i
        while j < n and occurs(text[i : j + 1]):
            j += 1
        while low and occurs(text[low - 1 : j]):
            low -= 1
        live = occurs(text[low:j])
        words = text[low:j]
        tells = sum(w not in rule.stop and w not in rule.formal for w in words)
        scripture = any(x in "qr" for x, _ in live)
        chained = sum(w in rule.chain for w in words) * 2 >= len(words) or words.count(rule.link) >= 2
        if len(words) >= (rule.need_scripture if scripture else rule.need) and tells >= rule.content:
            why = "long"
        elif any(verses.get(p) == len(words) for p in live):
            why = "whole"
        elif len(words) >= rule.rare and tells and len(live) <= rule.places and not chained:
            why = "rare"
        else:
            why = None
        if why:
            out.append((low, len(words), len(live), tells, why))
        i = j
    return out


@pytest.mark.parametrize(("most", "places"), [(4000, 60), (3, 2)])
def test_equals_word_by_word(spark, most, places):
    rng = random.Random(most)
    words = list("abcdefgh")
    rule = N.Rule(most=most, places=places, stop=("a", "b"), formal=("c",), chain=("d", "e"), link="d")
    stream = {x: rng.choices(words, k=rng.randrange(3, 30)) for x in "qrstuv"}
    hot = ["a", "c", "h", "g", "f"]  # a phrase that stands everywhere
    for x in "stuv":
        stream[x] += hot + rng.choices(words, k=4) + hot
    verses = {("q", 0): 4, ("q", 4): 5, ("r", 1): 3}
    texts = {}
    for k in range(60):
        t = rng.choices([*words, "zz"], k=rng.randrange(0, 12))
        for _ in range(rng.randrange(3)):
            w = stream[rng.choice("qrstuv")]
            a = rng.randrange(len(w))
            t += w[a : a + rng.randrange(1, 9)] + rng.choices([*words, "zz", "yy"], k=rng.randrange(3))
        texts[k] = t + (hot if k % 7 == 0 else [])
    table = spark.createDataFrame(list(texts.items()), "id int, loose array<string>")
    streams = spark.createDataFrame(list(stream.items()), "id string, loose array<string>")
    parts = spark.createDataFrame([(x, "quran" if x in "qr" else "hadith", x in "qr", a, a + n) for (x, a), n in verses.items()] + [(x, "hadith", False, 0, len(stream[x])) for x in "stuv"], "id string, corpus string, scripture boolean, first int, after int")
    got = {}
    for r in N.detected(table, streams, parts, rule).collect():
        got.setdefault(r.text, []).append((r.i, r.n, r.n_places, r.n_content, r.why))
    for k, t in texts.items():
        assert sorted(got.get(k, [])) == sorted(brute(t, stream, verses, rule)), (k, t)


def test_spans_join_over_punctuation(spark):
    text = "one two three four, five six seven eight nine"
    places = [(0, 3), (4, 7), (8, 13), (14, 18), (20, 24), (25, 28), (29, 34), (35, 40), (41, 45)]
    texts = spark.createDataFrame([(1, text, places)], "id int, text string, places array<struct<start:int,end:int>>")
    anchors = spark.createDataFrame([(1, 0, 4, "x"), (1, 4, 2, "x"), (1, 7, 2, "x"), (1, 6, 1, "y")], "text int, i int, n int, corpus string")
    got = {(r.start, r.end, r.corpus) for r in N.spans(anchors, texts, r"\p{L}").collect()}
    assert got == {(0, 28, "x"), (35, 45, "x"), (29, 34, "y")}


def test_no_anchors(spark):
    none = spark.createDataFrame([], "id int, loose array<string>")
    some = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "id int, loose array<string>")
    parts = spark.createDataFrame([], "id int, corpus string, scripture boolean, first int, after int")
    for texts, stream in ((none, some), (some, none), (some, some)):
        assert N.detected(texts, stream, parts, N.Rule()).select(F.lit(1)).collect() == []
