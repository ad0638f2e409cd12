import hashlib
import random

from quillmark.llm import infilling as I

SCHEMA = "doc_id long, text string, n string, form int, h1 string"


def brute(doc_id, text):
    text, digest = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    form = "plain" if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"
    p, m, s = text[:a], text[a:b], text[b:]
    output = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    return n, form, None if form == "plain" else a, None if form == "plain" else b - a, output


def test_examples_and_restored_texts(spark):
    rng = random.Random(4)
    pieces = ["a", "é", "😀", "\x1e", "\x1f", "0", "1", "\x1e0", "\x1e1", "\n", "\r\n", " ", "$0", "\\", "<", "<P", "<S", "S>", "é", "\x00", " "]
    texts = [None, "", "x", "\x1e", "\x1f", "\x1f" * 9, "\x1e1" * 5, "<P>", "ends <M>", "<<S>>", "word 😀 " * 30_000]
    texts += ["".join(rng.choices(pieces, k=rng.randrange(40))) for _ in range(400)]
    rows = [(k, t, "n", 1, "h") for k, t in enumerate(texts)] + [(None, "no id", None, None, None), (5, "again", None, None, None), (5, "again", None, None, None), (-7, "below zero", None, None, None)]
    made = I.fill_in_middle(spark.createDataFrame(rows, SCHEMA))
    out = made.withColumn("back", I.restored(made["output"], made["form"])).collect()
    assert len(out) == len(rows)
    assert sorted(map(repr, ((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out))) == sorted(map(repr, ((r[0], *brute(r[0], r[1])) for r in rows)))
    assert all(r.back == r.text for r in out)
    assert {r.form for r in out} == {"plain", "psm", "spm"}


def test_other_markers_and_units(spark):
    markers, words = I.Markers("[pre]", "[suf]", "[mid]"), r"(?s)\s*\S+\s*$|\s*\S+|\s+"
    texts = ["one two  three four five", " lead and trail ", "single", "[suf] stays", "with\x1fodd \x1e signs"]
    made = I.fill_in_middle(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), markers, plain_percent=0, spm_percent=50, unit=words)
    out = made.withColumn("back", I.restored(made["output"], made["form"], markers)).collect()
    assert all(r.back == r.text for r in out)
    assert {r.doc_id: r.n for r in out} == {0: 5, 1: 3, 2: 1, 3: 2, 4: 3}
    assert {r.doc_id for r in out if r.form == "plain"} == {3}


def test_empty_table_and_native_plan(spark):
    made = I.digests(I.fill_in_middle(spark.createDataFrame([], SCHEMA)))
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert made.collect() == []
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
