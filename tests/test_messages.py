import html
import random
import re
import unicodedata

from quillmark.operators import messages as G

RUNS = "array<struct<text:string,marked:boolean>>"
SCHEMA = f"id int, grp int, ord int, runs {RUNS}, wrap string, prefix string"


def units(text):
    return len(text.encode("utf-16-le")) // 2


def visible(markup):
    return html.unescape(re.sub(r"</?(?:b|i|blockquote)[^>]*>", "", markup))


def test_runs_never_split_a_letter_from_its_marks(spark):
    rng = random.Random(1)
    texts = {k: "".join(rng.choices(["ب", "َ", "ّ", "ٰ", " ", "e", "́", "x"], k=rng.randrange(0, 30))) for k in range(150)}
    texts[500], texts[501] = "a" + "̀" * 300 + "b", "إِنَّ ٱللَّهَ عَلَىٰ كُلِّ"
    marks = [(k, a := rng.randrange(-2, 32), a + rng.randrange(0, 6)) for k in range(150) for _ in range(rng.randrange(4))] + [(500, 150, 151), (501, a := texts[501].index("عَلَى"), a + 5)]
    rows = G.marked_runs(spark.createDataFrame(list(texts.items()), "id int, text string"), spark.createDataFrame(marks, "id int, start int, end int")).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.id, r.ord)):
        got.setdefault(r.id, []).append((texts[r.id][r.start : r.end], r.marked))
    for k, t in texts.items():
        assert "".join(p for p, _ in got.get(k, [])) == t
        merged = []
        for a, b in sorted((a, b) for i, a, b in marks if i == k and 0 <= a < b):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        want, i = [], 0
        for a, b in merged:
            b = min(b, len(t))
            if a >= len(t):
                continue
            while a > 0 and unicodedata.combining(t[a]):
                a -= 1
            while b < len(t) and unicodedata.combining(t[b]):
                b += 1
            if b > i:
                a = max(a, i)
                want += [(t[i:a], False)] * (a > i) + [(t[a:b], True)]
                i = b
        want += [(t[i:], False)] * (i < len(t))
        assert got.get(k, []) == want, (k, t)
    assert ("عَلَىٰ", True) in got[501] and got[500][0][0] == "a" + "̀" * 300


def brute_pack(groups, budget):
    """Groups: lists of lists of pieces that fit; returns messages."""
    out, current = [], ""
    for pieces, whole in groups:
        joined = "\n".join(whole)
        if not joined:
            continue
        if units(joined) <= budget:
            if current and units(current) + 2 + units(joined) > budget:
                out, current = [*out, current], ""
            current += ("\n\n" if current else "") + joined
            continue
        if current:
            out, current = [*out, current], ""
        for p in pieces:
            if current and units(current) + 1 + units(p) > budget:
                out, current = [*out, current], ""
            current += ("\n" if current else "") + p
    return [*out, current] if current else out


def test_packing_keeps_limits_and_every_character(spark):
    rng = random.Random(2)
    blocks, budget = [], 120
    for k in range(60):
        for g in range(rng.randrange(5)):
            for o in range(rng.randrange(1, 4)):
                runs = [("".join(rng.choices(["word ", "<", "&", "😀", "longerword", "بَ "], k=rng.choice([0, 3, 9, 60]))), rng.random() < 0.4) for _ in range(rng.randrange(1, 4))]
                blocks.append((k, g, o, runs, rng.choice(["", "i", "blockquote expandable"]), rng.choice(["", "• "])))
    rows = spark.createDataFrame(blocks, SCHEMA)
    pieces = G.packed(rows, budget)
    parts = {}
    for r in pieces.collect():
        parts.setdefault((r.id, r.grp, r.ord), []).append((r.piece, r.html))
    for k, g, o, runs, wrap, prefix in blocks:
        told = [h for _, h in sorted(parts.get((k, g, o), []))]
        assert "".join(visible(h).removeprefix(prefix) for h in told) == "".join(t for t, _ in runs)
        assert all(units(h) <= budget for h in told)
        assert all(h.count("<b>") == h.count("</b>") and h.count("<blockquote") == h.count("</blockquote>") for h in told)
    got = {}
    for r in sorted(G.messages(pieces).collect(), key=lambda r: (r.id, r.message)):
        got.setdefault(r.id, []).append(r.html)
        assert units(r.html) <= budget
    whole = {}
    for r in rows.select("id", "grp", "ord", G.rendered(rows["runs"], rows["wrap"], rows["prefix"]).alias("h"), "runs").collect():
        if any(x.text for x in r.runs):
            whole[r.id, r.grp, r.ord] = r.h
    for k in range(60):
        groups = []
        for g in sorted({b[1] for b in blocks if b[0] == k}):
            keys = [(k, g, o) for o in range(3) if (k, g, o) in whole]
            groups.append(([h for key in keys for _, h in sorted(parts[key])], [whole[key] for key in keys]))
        assert got.get(k, []) == brute_pack(groups, budget)


def test_one_long_text_is_linear(spark):
    text = "بِسْمِ ٱللَّهِ " * 60_000
    rows = spark.createDataFrame([(1, 1, 1, [(text, False), ("x" * 50, True)], "blockquote", "")], SCHEMA)
    pieces = G.packed(rows, 1000).collect()
    assert len(pieces) > 500 and all(units(r.html) <= 1000 for r in pieces)
    assert "".join(visible(r.html) for r in sorted(pieces, key=lambda r: r.piece)) == text + "x" * 50
