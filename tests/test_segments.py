from pyspark.sql import functions as F
from quillmark.operators import segments as G


def test_prepared(spark):
    rows = [("a", "quran", False, "قلم كتاب"), ("b", "hadith_matn", False, "قلم كتاب"), ("c", "hadith_matn", True, "قلم كتاب"), ("d", "unknown", False, "..."), ("e", "unknown", False, "some words")]
    got = G.prepared(spark.createDataFrame(rows, "id string, kind string, marked boolean, quoted string"))
    assert sorted(r.id for r in got.collect()) == ["a", "c", "e"]


def test_records_covering(spark):
    records = spark.createDataFrame([(1, "a", 0, 5), (1, "b", 5, 9), (1, "c", 9, 12), (2, "d", 0, 9)], "doc int, rec string, first int, after int")
    windows = spark.createDataFrame([(1, 1, 4, 5), (2, 1, 5, 4)], "q int, doc int, start int, n int")
    assert sorted((r.q, r.ord, r.rec) for r in G.records_covering(windows, records).collect()) == [(1, 1, "a"), (1, 2, "b"), (2, 1, "b")]


def test_best_per_reference(spark):
    rows = [(1, "quran", "2:10", 2, 1, 0.5), (1, "quran", "2:10", 1, 2, 0.5), (1, "quran", "2:9", 1, 3, 0.5), (1, "hadith", "7", 1, 4, 0.5), (1, "hadith", "8", 1, 5, 0.9), (1, "quran", "1:1", 1, 6, 0.0)]
    got = G.best_per_reference(spark.createDataFrame(rows, "q int, kind string, ref string, priority int, id int, score double"), 3).orderBy("rank").collect()
    assert [(r.ref, r.id) for r in got] == [("8", 5), ("2:9", 3), ("2:10", 2)]


def test_arrays_and_chains(spark):
    t = spark.createDataFrame([(["b", "c"], ["a", "b", "c"]), (["b"], ["b", "b"]), (["x"], ["a"]), ([], ["a"])], "n array<string>, h array<string>")
    assert [r.x for r in t.select(G.located(F.col("n"), F.col("h")).alias("x")).collect()] == [1, -1, -1, -1]
    c = spark.createDataFrame([("حدثنا زيد عن عمرو قال".split(),), ("هذا كتاب جديد جدا عن".split(),), (["عن"],)], "t array<string>")  # the first word of a chain is a link
    assert [r.x for r in c.select(G.chain_shaped(F.col("t")).alias("x")).collect()] == [True, False, False]
    b = spark.createDataFrame([("كلام. عن زيد قال: «قلم»", 19), ("كلام قلم", 5)], "t string, s int")
    assert [r.x for r in b.select(G.chain_before(F.col("t"), F.col("s")).alias("x")).collect()] == [("isnad", 6, 17), None]


def test_attribution_only(spark):
    rows = [("«رواه البخاري»", "attribution"), ("متفق عليه", "attribution"), ("أخرجه مسلم هـ", "attribution"), ("رواه البخاري هذا كتاب جديد", "attribution"), ("البخاري هذا كتاب جديد", None), ("عن زيد رضي الله عنه قال", "isnad"), ("حدثنا زيد عن عمرو عن بكر", "isnad"), ("عن زيد قال: هذا كتاب جديد جدا", None), ("قلم كتاب بيت", None), ("", None)]
    got = spark.createDataFrame([r[:1] for r in rows], "q string").select("q", G.attribution_only(F.col("q")).alias("k")).collect()
    assert [(r.q, r.k) for r in got] == rows


def test_segments(spark):
    text = "عن زيد قال: «هذا كتاب جديد» رواه مسلم في صحيحه. ثم"
    a, b = text.index("هذا"), text.index("»")
    t = spark.createDataFrame([(text, a, b), ("«قلم كتاب» سورة البيت 12", 1, 9), ("قلم كتاب وحده", 0, 8)], "t string, a int, b int")
    got = t.select(G.segments(F.col("t"), F.col("a"), F.col("b"), F.col("a") == 1).alias("s")).collect()
    parts = [[(x.type, r[0][x.start : x.end]) for x in g.s] for r, g in zip(t.collect(), got, strict=True)]
    assert parts == [[("matn", "هذا كتاب جديد"), ("claimed_source", "رواه مسلم في صحيحه"), ("isnad", "عن زيد قال:")], [("Ayah", "قلم كتاب"), ("claimed_source", "سورة البيت 12")], [("matn", "قلم كتاب")]]


def test_augmented(spark):
    schema = "id int, start int, end int, kind string, marked boolean"
    spans, tags, anchors = (spark.createDataFrame(r, schema) for r in ([(1, 0, 10, "a", False), (1, 20, 30, "unknown", False)], [(1, 5, 8, "t", True)], [(1, 25, 28, "x", False), (1, 40, 50, "y", False)]))
    assert sorted((r.start, r.kind) for r in G.augmented(spans, tags, anchors).collect()) == [(5, "t"), (20, "x"), (40, "y")]
