import zipfile

import pytest
from pyspark.sql import functions as F
from quillmark.operators import diffs, evaluation, intervals
from quillmark.operators.index import streams
from quillmark.sources import corpus as S
from quillmark.streaming import checks


def test_readers_and_checks(spark, tmp_path):
    (tmp_path / "v.txt").write_text("# head\n\n1|1|a|b\n1|2|c\n", encoding="utf-8")
    assert [tuple(r) for r in S.verse_lines(spark, f"{tmp_path}/v.txt").collect()] == [(1, 1, "a|b"), (1, 2, "c")]
    (tmp_path / "n.csv").write_text('1,"a, ""b"""\n2,c\n', encoding="utf-8")
    assert [tuple(r) for r in S.numbered_csv(spark, f"{tmp_path}/n.csv").collect()] == [(1, 'a, "b"'), (2, "c")]
    (tmp_path / "bad.csv").write_text("x,c\n", encoding="utf-8")
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        S.numbered_csv(spark, f"{tmp_path}/bad.csv").collect()
    import hashlib

    d = S.file_digests(spark, f"{tmp_path}/v.txt").first()
    assert d.sha256 == hashlib.sha256((tmp_path / "v.txt").read_bytes()).hexdigest()


def test_workbook(spark, tmp_path):
    rows = [["note"], ["id", "t"], ["1", "x"], ["2", "y"]]
    cells = "".join(f"<row>{''.join(f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>' for c, v in enumerate(row))}</row>" for r, row in enumerate(rows, 1))
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{cells}</sheetData></worksheet>')
    assert [tuple(r) for r in S.workbook(spark, f"{tmp_path}/b.xlsx", ["id", "t"]).collect()] == [("1", "x"), ("2", "y")]


def test_images_by_their_first_bytes(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n0000")
    (tmp_path / "b.png").write_bytes(b"<html>")
    assert {r.path[-5:]: (r.kind, r.ok) for r in S.images(spark, f"{tmp_path}/*.png").collect()} == {"a.png": ("png", True), "b.png": (None, False)}


def test_editions_and_display(spark):
    a, b = spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "chapter int, verse int, text string"), spark.createDataFrame([(1, 1, "X"), (1, 3, "Z")], "chapter int, verse int, text string")
    both, odd = S.aligned_editions(a, b)
    assert [tuple(r) for r in both.collect()] == [(1, 1, "x", "X")] and {r.verse for r in odd.collect()} == {2, 3}
    plain, shown = spark.createDataFrame([(1, "قلم جديد"), (2, "كتاب")], "num int, text string"), spark.createDataFrame([(1, "قَلَم جديد"), (2, "بيت")], "num int, text string")
    assert {r.num: (r.text, r.mismatch) for r in S.displayed(plain, shown).collect()} == {1: ("قَلَم جديد", False), 2: ("كتاب", True)}


def test_pins_and_index(spark, tmp_path):
    old, new = (spark.createDataFrame(rows, "name string, sha256 string") for rows in ([("a", "1"), ("b", "2"), ("c", "3")], [("a", "1"), ("b", "9"), ("d", "4")]))
    assert {r.name: r.change for r in S.repinned(old, new).collect()} == {"a": "kept", "b": "drifted", "c": "gone", "d": "added"}
    tables = {"stream": streams(spark.createDataFrame([(1, "a b")], "id long, text string"), "id")}
    S.save_index(tables, f"{tmp_path}/i", "d1")
    assert S.load_index(spark, f"{tmp_path}/i", ["stream"], "d1")["stream"].count() == 1
    assert S.load_index(spark, f"{tmp_path}/i", ["stream"], "d2") is None and S.load_index(spark, f"{tmp_path}/none", [], "d1") is None


def test_an_index_is_published_whole_or_not_at_all(spark, tmp_path):
    path, table = f"{tmp_path}/i", lambda x: {"stream": spark.createDataFrame([(1, x)], "id long, text string")}
    read = lambda digest: S.load_index(spark, path, ["stream"], digest)["stream"].first().text
    S.save_index(table("one"), path, "d1")
    opened = S.load_index(spark, path, ["stream"], "d1")["stream"]

    class Dies(Exception):
        pass

    def broken():
        raise Dies

    bad = table("two")
    bad["late"] = type("Late", (), {"write": property(lambda self: broken()), "sparkSession": spark})()
    with pytest.raises(Dies):
        S.save_index(bad, path, "d2")
    assert read("d1") == "one" and S.load_index(spark, path, ["stream"], "d2") is None  # a writer died: readers stay where they were
    S.save_index(table("three"), path, "d3")
    assert read("d3") == "three"
    S.save_index(table("four"), path, "d4")
    assert read("d4") == "four" and len([x for x in (tmp_path / "i").iterdir() if x.is_dir()]) == 2
    S.save_index(table("five"), path, "d5", keep=3)
    assert read("d5") == "five" and opened is not None


def test_receipts_and_judging(spark):
    t = spark.createDataFrame([("é" * 500,), (None,)], "p string").select("p", diffs.receipt_token("p").alias("t")).select("p", diffs.receipt_payload("t").alias("r"), F.length("t").alias("n")).collect()
    assert t[0].r == t[0].p and t[0].n < 100 and t[1].r is None
    got = spark.createDataFrame([("a", "found", None, ["quran"], ["n"])], "case_id string, status string, reason string, corpora array<string>, notices array<string>")
    want = spark.createDataFrame([("a", "not_found", ["found"], None, "quran", []), ("b", "not_found", [], None, None, [])], "case_id string, status string, never array<string>, reason string, corpus string, notice_any array<string>")
    assert {r.case_id: (r.passed, r.unsafe, r.reasons) for r in evaluation.judged(got, want).collect()} == {"a": (False, True, ["status", "unsafe"]), "b": (True, False, [])}


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, "xx one two three four five six yy")], "id long, text string").write.parquet(f"{tmp_path}/in")
    records = spark.createDataFrame([(9, "one two three four five six")], "item_id long, text string")
    q = checks.check_stream(spark.readStream.schema("id long, text string").parquet(f"{tmp_path}/in"), records, f"{tmp_path}/out", f"{tmp_path}/cp", "id")
    q.awaitTermination()
    assert [(r.text, r.id, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [(1, 9, 6)]
    rows = [(k, 1000 + t, n) for n, (k, t) in enumerate([(1, 0), (1, 1), (1, 2), (1, 3), (1, 4), (2, 1), (3, 100), (1, 101), (3, 102), (3, 102), (3, 102), (4, 300)])]
    for batch in ([r for r in rows if r[1] < 1050], [r for r in rows if 1050 <= r[1] < 1200], [r for r in rows if r[1] >= 1200]):
        spark.createDataFrame(batch, "key long, at long, request long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/req")
        s = checks.rate_limited_stream(spark.readStream.schema("key long, at long, request long").parquet(f"{tmp_path}/req"), most=2, seconds=3)
        q = s.writeStream.format("parquet").option("path", f"{tmp_path}/limited").option("checkpointLocation", f"{tmp_path}/limits").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        kept = sum(o["numRowsTotal"] for o in q.lastProgress["stateOperators"])
    assert kept == 1  # only the key of the last batch; the others' windows have passed
    want = intervals.rate_limited(spark.createDataFrame(rows, "key long, at long, request long"), most=2, seconds=3)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/limited").collect())) == sorted(map(tuple, want.collect()))


def test_exact_ranks_on_heavy_tails(spark, monkeypatch):
    values = [float(k % 997) / 1000 for k in range(4000)] + [1e12, -1e9]
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    for most in (1_000_000, 50, 5):
        got = {r.q: r.value for r in evaluation.quantile_table(rows, "v", (0.0, 0.5, 0.95, 1.0), most).collect()}
        assert got == {q: sorted(values)[min(len(values) - 1, int(len(values) * q))] for q in (0.0, 0.5, 0.95, 1.0)}
    assert evaluation.quantile_table(rows.where("v is null"), "v", (0.5,)).collect() == []
