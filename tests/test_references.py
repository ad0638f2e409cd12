from pyspark.sql import functions as F
from quillmark.operators import references as R

SCHEMA = "id long, corpus string, book string, chapter int, verse int, number int, link string"
RECORDS = [(1, "quran", "", 2, 5, None, None), (2, "hadith", "b one", None, None, 7, None), (3, "encyclopedia", None, None, None, 7, "https://x/7"), (4, "hadith", "b one", None, None, 7, None), (5, "quran", "", 2, None, None, None)]


def test_look_up(spark):
    records = spark.createDataFrame(RECORDS, SCHEMA)
    asked = [(10, "quran", None, 2, 5, None), (11, "quran", None, 2, 6, None), (12, "hadith", "b one", None, None, 7), (13, "hadith", "b", None, None, 7), (14, "encyclopedia", None, None, None, 7), (15, "quran", None, None, None, None), (12, "hadith", "b one", None, None, 7)]
    got = R.looked_up(spark.createDataFrame(asked, "q int, corpus string, book string, chapter int, verse int, number int"), records).collect()
    assert sorted((r.q, r.id or 0) for r in got) == [(10, 1), (11, 0), (12, 2), (12, 2), (13, 0), (14, 3), (15, 0)]


def test_labels_and_links(spark):
    rows = spark.createDataFrame(RECORDS[:4], SCHEMA).withColumn("last", F.when(F.col("id") == 1, 8).cast("int"))
    names = spark.createDataFrame([("2", "The Second"), ("b one", "Book One")], "key string, name string")
    out = {r.id: (r.label, r.url) for r in R.linked(R.labelled(rows, names), {"quran": "https://q/{chapter}/{verse}", "hadith": "https://h/{book}#{number}"}).collect()}
    assert out == {1: ("The Second (2:5–8)", "https://q/2/5"), 2: ("Book One, no. 7", "https://h/b%20one#7"), 3: ("no. 7", "https://x/7"), 4: ("Book One, no. 7", "https://h/b%20one#7")}
    plain = {r.id: r.label for r in R.labelled(rows.withColumn("last", F.col("verse")), names.limit(0), {"verse": "{chapter}.{verse}"}).collect()}
    assert plain == {1: "2.5", 2: "b one, no. 7", 3: "no. 7", 4: "b one, no. 7"}
    link = spark.createDataFrame([(" a b/é ",)], "t string").select(R.search_links(F.col("t"), {"s": "https://s?q={q}"}).alias("x")).first().x
    assert [(x.name, x.url) for x in link] == [("s", "https://s?q=a%20b%2F%C3%A9")]
