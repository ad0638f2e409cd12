import pytest
from pyspark.sql import functions as F
from quillmark import api

RECORDS = [(1, "quran", "", "alpha beta gamma delta epsilon zeta eta theta"), (2, "hadith", "sahih_muslim", "one two three four five six seven eight nine ten"), (3, "hadith", "sunan_ibn-maja", "Élan vital comes from the long road home")]
# A word that stands in more than a fifth of its side's records is a stop word, so each side must have five or more.
RECORDS += [(k, corpus, "", " ".join(f"filler{k}{x}" for x in "abcdefgh")) for k, corpus in enumerate(["hadith"] * 3 + ["quran"] * 4, 4)]


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame(RECORDS, "id long, corpus string, book string, text string")


def verdicts(spark, records, texts):
    rows = api.check(spark.createDataFrame(texts, "id long, text string"), records).collect()
    return {r.id: r for r in rows}


def test_statuses(spark, records):
    got = verdicts(spark, records, [
        (1, 'He wrote "alpha beta gamma delta epsilon zeta" once.'), (2, "see «one two three four six seven eight nine ten» here"), (3, "«alpha beta gamma other epsilon zeta eta theta»"), (4, "«nothing of this is known anywhere»"), (5, "plain text"), (6, None),
        (7, "and then one two three four five six seven eight came"), (8, "«elan vital comes from the long road home»"),
    ])
    assert got[1].status == "found" and got[1].scope == "quran" and got[1].matches[0].rec == 1 and got[1].quoted == "alpha beta gamma delta epsilon zeta"
    assert got[2].status == "partial_match" and got[2].matches[0].rec == 2
    assert got[3].status == "needs_review" and got[3].reason == "near_miss"  # scripture is never a partial match
    assert got[4].status == "not_found" and got[4].matches == [] and 5 not in got and 6 not in got
    assert got[7].status == "found" and got[7].quoted == "one two three four five six seven eight"
    assert got[8].status == "needs_review" and got[8].reason == "orthographic_difference"


def test_guard_and_quotes(spark, records):
    texts = spark.createDataFrame([(1, "no quotation"), (2, "«one two three four five»"), (3, "«one two three four five» and «not known to anybody here»")], "id long, text string")
    assert {r.id: (r.verdict, r.by_status) for r in api.guard(texts, records).collect()} == {1: ("no_quotes", ""), 2: ("clear", "found=1"), 3: ("flagged", "found=1,not_found=1")}
    q = spark.createDataFrame([(1, "five six seven")], "id long, quoted string")
    assert [r.status for r in api.verify_quotes(q, records).collect()] == ["found"]


def test_found_slices_to_the_text(spark, records):
    texts = spark.createDataFrame([(k, f"x{'y' * k} «{r[3][:30]}» z") for k, r in enumerate(RECORDS)], "id long, text string")
    rows = api.check(texts, records).join(texts, "id").select(F.expr("substring(text, start + 1, end - start) = quoted").alias("ok")).collect()
    assert rows and all(r.ok for r in rows)


def test_candidates(spark, records):
    asked = spark.createDataFrame([(1, "the long roads home")], "q long, text string")
    assert api.candidates(asked, records.select("id", "text")).first().id == 3


ARABIC = [
    (1, "quran", "", "قل هو الكتاب الجديد", None, 5, 1, "قُلْ هُوَ الكِتَابُ الجَدِيدُ"), (2, "quran", "", "والبيت الأول في المدينة", None, 5, 2, None),
    (3, "hadith", "sahih_muslim", "حدثنا زيد أن القلم خير من السيف عند أهل العلم", None, None, None, None), (4, "hadith", "sunan_ibn-maja", "إن أحسن الناس من كتب كتابا في بيته", None, None, None, None),
    (5, "quran", "", "هذا الصراط قديم هنا", "هذا السراط قديم هنا", 6, 1, None),
]


_OTHER = "زبدة ملح فلفل كركم زنجبيل قرفة هيل نعناع ريحان سماق كمون حبق بصل ثوم جزر خس لفت فجل خيار قرع توت تين خوخ رمان كرز موز جوز لوز".split()
ARABIC += [(10 + k, corpus, "", " ".join(_OTHER[4 * k : 4 * k + 4]), None, None, None, None) for k, corpus in enumerate(["hadith"] * 4 + ["quran"] * 3)]  # so that rare words are no stop words
ARABIC_SCHEMA = "id long, corpus string, book string, text string, alt string, chapter int, verse int, vocalised string"


@pytest.fixture(scope="module")
def arabic_verdicts(spark):
    """One job for all texts: what it costs is fixed."""
    texts = [
        (1, "قال تعالى: «الكتاب الجديد والبيت الأول» (Quran 5:1)"), (2, "قال رسول الله ﷺ: القلم خير من السيف عند اهل العلم. رواه البخاري"), (3, "«قُلْ هُوَ الكِتَابَ الجَدِيدُ»"), (4, "«قُلْ هُوَ الكِتَابُ الجَدِيدُ»"), (5, "«ان احسن الناس من كتب كتابا»"),
        (6, "«رواه البخاري في صحيحه»"), (7, "«القلم خير xyz من السيف»"), (8, "«هذا السراط قديم هنا»"), (9, "«ليس في هذه الكتب شيء كهذا»"),
        (21, "«قُلْ هُوَ الكِتَابَ الجَدِيدُ»"), (22, "«قُلْ هُوَ الكتَابُ الجَدِيدْ»"), (23, "«القلم خير xyz من السيف»"), (24, "قال رسول الله ﷺ: «حدثنا زيد أن القلم خير من السيوف جدا عند أهل العلم»"), (25, "«قل هو الكتاب الجديد»"),
        (26, "«الكتاب الجديد والبيت الأول في القرية»"),
    ]
    return {r.id: r for r in api.check(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(ARABIC, ARABIC_SCHEMA), arabic=True).collect()}


def test_life_cycle_in_arabic(spark, arabic_verdicts):
    got = arabic_verdicts
    assert got[1].status == "found" and got[1].scope == "quran" and got[1].matches[0].continues_to == 2 and "quran_fragment" in got[1].notices  # across two verses
    assert got[2].status == "found" and got[2].mismatch and {"rasm_completed", "claimed_source_mismatch"} <= set(got[2].notices) and [x.type for x in got[2].segments] == ["matn", "claimed_source"]
    assert got[3].status == "needs_review" and got[3].reason == "diacritic_difference" and got[4].status == "found" and got[4].notices == []
    assert got[5].status == "found" and "rasm_completed" in got[5].notices and got[5].matches[0].tier == "other_nine"  # the corpus has one spelling
    assert 6 not in got  # a reference, no quotation
    assert got[7].status == "needs_review" and got[7].reason == "foreign_material"
    assert got[8].status == "found" and got[8].matches[0].rec == 5  # in the second edition's spelling
    assert got[9].status == "not_found" and got[9].matches == []
    seen = api.check(spark.createDataFrame([(4, "«قُلْ هُوَ الكِتَابُ الجَدِيدُ»")], "id long, text string"), spark.createDataFrame(ARABIC, ARABIC_SCHEMA), arabic=True, image=True).first()
    assert seen.status == "needs_review" and seen.reason == "image_unconfirmed" and "image_extracted" in seen.notices


def test_differences_of_all_families(arabic_verdicts):
    rows = {k - 20: r for k, r in arabic_verdicts.items() if k > 20}
    source = {r[0]: r[3] for r in ARABIC}

    def first(i):
        m = rows[i].matches[0]
        return rows[i].quoted, source[m.rec], m

    quoted, text, m = first(1)  # a conflict: the last vowel of the third word
    assert m.kinds == ["diacritic_conflict"] and [o.op for o in m.diff] == ["equal", "equal", "replace", "equal"]
    (a, b), (c, d) = m.diff[2].quote_letters[0], m.diff[2].source_letters[0]
    assert quoted[a:b] == "بَ" and text[c:d] == "ب" and m.source_range == [0, len(text)]
    quoted, text, m = first(2)  # one vowel left out, and a pause at the end
    assert rows[2].status == "found" and m.kinds == ["diacritic_missing", "waqf"] and {o.op for o in m.diff} == {"equal"}
    assert [[quoted[a:b] for a, b in o.quote_letters] for o in m.diff] == [[], [], ["ك"], ["دْ"]]
    quoted, text, m = first(3)  # foreign matter
    assert m.kinds == ["foreign_material"] and [o.op for o in m.diff] == ["equal", "equal", "delete", "equal", "equal"]
    assert quoted[slice(*m.diff[2].quote_chars)] == "xyz" and [text[slice(*o.source_chars)] for o in m.diff if o.op == "equal"] == ["القلم", "خير", "من", "السيف"]
    quoted, text, m = first(4)  # a word replaced and one added
    assert m.kinds == ["word_replaced"] or set(m.kinds) == {"word_replaced", "word_added_in_quote"}
    for o in m.diff:
        if o.op == "equal":
            assert quoted[slice(*o.quote_chars)].split() == text[slice(*o.source_chars)].split()
    assert rows[5].status == "found" and first(5)[2].diff == [] and first(5)[2].kinds == []
    quoted, text, m = first(6)  # across two verses: words of the other record have no place
    assert m.kinds == ["word_added_in_quote"] and [o.op for o in m.diff] == ["equal", "delete"] and m.source_range == [text.index("الكتاب"), len(text)] and m.diff[0].source_chars[1] == -1
