import random
import re

import pytest
from quillmark.llm.licenses import BASE, TEMPLATES, Automaton, Scanner, scan_licenses

SCHEMA = "doc_id long, text string, labels string, spans int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(text):
    words = WORD.findall((text or "").translate(LOW))
    places = [(k, label) for phrase, label in BASE for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    starts = [k for k, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_matching_statistics_equal_brute_force():
    rng = random.Random(1)
    templates = [[rng.randrange(1, 5) for _ in range(rng.randrange(1, 14))] for _ in range(6)]
    a = Automaton.of(templates)
    inside = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    for _ in range(50):
        words = [rng.randrange(0, 5) for _ in range(40)]
        for k, (s, n) in enumerate(a.stream(words), 1):
            assert n == max((m for m in range(1, k + 1) if tuple(words[k - m : k]) in inside), default=0)
            if n:
                ends = {(t, e) for t, x in enumerate(templates) for e in range(n, len(x) + 1) if x[e - n : e] == words[k - n : k]}
                assert ends == set(a.places[s])


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    vocabulary = sorted({w for p, _ in BASE for w in p.split()} | {"x", "né", "cc-by", "MIT", "2.0"})
    texts = [None, "", "...", "CC BY NC by nc CC BY-NC", "Under the MIT Licence under the mit license", "a" * 70000, "the mit license under " * 9000]
    texts += ["This work is licensed under the GNU General Public License, version 3.", TEMPLATES[1][1].replace("software", "product").upper(), "cc by nc é apache LICENSE, version 2"]
    texts += [" ".join(rng.choices(vocabulary, k=rng.randrange(40))) for _ in range(400)] + ["Under the MIT License"] * 3
    given = list(enumerate(texts)) + [(None, "cc by nc"), (3, "cc by nc")]
    got = scan_licenses(spark.createDataFrame([(i, t, "clash", 1) for i, t in given], SCHEMA)).collect()
    return dict(enumerate(texts)), given, got


def test_base_equals_brute_force(rows):
    texts, given, got = rows
    assert len(got) == len(given)
    for r in got:
        if r.doc_id is not None and r.doc_id != 3:
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
            assert 0 <= r.score <= 1 and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))


def test_templates(rows):
    got = {r.doc_id: r for r in rows[2]}
    assert got[7].labels == "gpl-3" and got[7].n_base == 0 and got[7].score == 1 and got[7].spans[0].first == 0
    assert got[8].labels == "mit" and 0.8 < got[8].score < 1  # changed words: a chain of several matches
    assert got[0].labels == "" and got[1].score == 0


def test_chain_keeps_template_order():
    s = Scanner(templates=(("t", "a b c d e f g h"),), base=(), min_match=3, min_coverage=0.5, max_gap=2)
    import pyarrow as pa

    out = list(s.batch(pa.array(["a b c d x e f g h", "e f g h a b c d", "a b c d x x x e f g h"])))
    assert [round(r[6], 3) for r in out] == [1.0, 0.5, 0.5]


def test_right_maximal_matches_equal_brute_force():
    rng = random.Random(5)
    for _ in range(40):
        templates = tuple(("t", " ".join(rng.choices("abcd", k=rng.randrange(3, 12)))) for _ in range(5))
        s = Scanner(templates=templates, base=(("b", "a b c"),), min_match=3)
        words = rng.choices("abcde", k=30)
        got = s.read([w.encode() for w in words], 0)[1]
        want = set()
        for t, (_, text) in enumerate(templates, 1):
            own = text.split()
            for e in range(1, len(own) + 1):
                for k in range(1, len(words) + 1):
                    n = 0
                    while n < min(e, k) and own[e - n - 1] == words[k - n - 1]:
                        n += 1
                    goes_on = e < len(own) and k < len(words) and own[e] == words[k]
                    if n >= 3 and not goes_on:
                        want.add((t, e - n, k - n, n))
        assert set(got) == want and len(got) == len(want)


def test_deciding_words():
    import pyarrow as pa

    said = {
        "This work is licensed under the GNU General Public License version 2": "gpl-2", "This work is licensed under the GNU General Public License, version 3.": "gpl-3", "Licensed under the GNU General Public License version 3": "gpl-3",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.": "cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution 4.0 International License.": "cc-by",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "cc-by-nc", "Released under the MIT License. Parts are licensed under the GNU General Public License version 2.": "gpl-2,mit",
    }
    assert {t: r[5] for t, r in zip(said, Scanner().batch(pa.array(list(said))), strict=True)} == said


def test_empty_table(spark):
    assert scan_licenses(spark.createDataFrame([], SCHEMA)).collect() == []
