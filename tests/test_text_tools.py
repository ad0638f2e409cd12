from pyspark.sql import functions as F
from quillmark.functions import text_tools as T
from quillmark.operators import extraction as E


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def test_scalars(spark):
    assert one(spark, T.word_end(F.col("t"), F.col("e")), t="قلم، كتاب", e=3) == 4
    assert one(spark, T.without_long_vowels(F.col("t")), t="كتاب") == "كتب"
    assert one(spark, T.utf16_length(F.col("t")), t="a😀b") == 4
    assert one(spark, T.html_escaped(F.col("t")), t="<a & b>") == "&lt;a &amp; b&gt;"


def test_lexicon_scan(spark):
    scan = T.forbidden(F.col("t"), ["قلم"], ["كتاب جديد"], ["weak"], ["دار القلم"])
    assert one(spark, scan, t="القلمات هنا كتاب جديد, a weak one") == ["قلمات", "كتاب جديد", "weak"]
    assert one(spark, scan, t="من دار القلم weakly") == []


def test_names(spark):
    names = spark.createDataFrame([("البقرة", 2), ("Maryam", 19)], "name string, number int")
    rows = spark.createDataFrame([("بقره",), ("maryam",), ("none",)], "n string")
    assert {r.n: r.number for r in T.looked_up(rows, "n", names).collect()} == {"بقره": 2, "maryam": 19, "none": None}


def test_asserted(spark):
    def a(before, quote, after):
        t = before + quote + after
        return one(spark, E.asserted_kind(F.col("t"), F.lit(len(before)), F.lit(len(before + quote))), t=t)

    assert a("x. Allah says: ", "q", "") == "quran" and a("The Prophet said ", "q", "") == "hadith" and a("﴿", "q", "﴾") == "quran"
    assert a("Allah says. Then ", "q", " رواه مسلم") == "hadith" and a("Allah says, the Prophet said ", "q", "") == "" and a("", "q", "") == ""



def test_chunks(spark):
    text = "ab\ncdefgh\ni\n" + "z" * 12
    parts = one(spark, T.chunked(F.col("t"), 5), t=text)
    assert "".join(p.part for p in parts) == text and all(len(p.part) <= 5 and text[p.start : p.start + len(p.part)] == p.part for p in parts)
    assert one(spark, T.chunked(F.col("t"), 5), t="") == []
