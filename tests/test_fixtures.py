"""The Arabic rules on neutral words: what they make of each, derived by hand."""

import pytest
from pyspark.sql import functions as F
from quillmark.functions import orthography as O
from quillmark.operators import extraction as E
from quillmark.operators import validation as P

# Neutral words and what the rules make of them: written, loose tokens, strict tokens.
FOLDS = [
    ("أحمد إلى آخر", "احمد الي اخر", "أحمد إلى آخر"), ("مدرسةٌ", "مدرسه", "مدرسة"), ("كِتَــابٌ جَدِيدٌ", "كتاب جديد", "كتاب جديد"), ("سؤال بئر", "سوال بير", "سؤال بئر"),
    ("ٱلبيت", "البيت", "البيت"), ("کیف", "كيف", "كيف"), ("قال ﷺ نعم", "قال نعم", "قال نعم"), ("رقم 12 و 3", "رقم و", "رقم و"), ("ﻻ بأس", "لا باس", "لا بأس"), ("hello", "", ""), ("كلمة،أخرى", "كلمه اخري", "كلمة أخرى"),
]
COMPOSITIONS = [("آخر", "اخر", "آخر"), ("أمر", "امر", "أمر"), ("إذا", "اذا", "إذا"), ("سؤال", "سوال", "سؤال"), ("بئر", "بير", "بئر"), ("قىٔ", "قي", "قئ")]
SPANS = [("قلم كِتَابٌ", 0, "قلم", 0, 3), ("قلم كِتَابٌ", 1, "كتاب", 4, 10), ("(بيت)", 0, "بيت", 1, 4), ("a بيت", 0, "بيت", 2, 5)]
CLASSES = [("على", "على", "equal"), ("علي", "على", "completion"), ("على", "علي", "swap"), ("ان", "أن", "completion"), ("إن", "أن", "swap"), ("قلم", "كتاب", "other"), ("مدرسه", "مدرسة", "completion")]
VOWELS = [
    ("كَتَبَ", "كَتَبَ", False, ""), ("كُتَبَ", "كَتَبَ", False, "conflict"), ("كتب", "كَتَبَ", False, "missing,missing,missing"), ("كَتَبْ", "كَتَبَ", True, "waqf"), ("كَتَبْ", "كَتَبَ", False, "conflict"),
    ("مَدَ", "مَدَّ", False, "missing"), ("مَدَّ", "مَدَ", False, "conflict"), ("قلم", "كتاب", False, None),
]
FOREIGN = [("قلم xyz كتاب", "xyz"), ("قلم، كتاب", ""), ("قلم (12) كتاب", ""), ("قلم 12 كتاب", "12"), ("xyz قلم كتاب", ""), ("قلم", None)]
CLAIMS = [("رواه البخاري ومسلم", "sahih_al-bukhari,sahih_muslim", None, None), ("متفق عليه", "sahih_al-bukhari,sahih_muslim", None, None), ("see Muslim", "sahih_muslim", None, None), ("Malik said", None, None, None), ("Muwatta of Malik", "maliks_muwataa", None, None), ("(Quran 2:255)", "", 2, 255), ("12:5", "", 12, 5), ("Q 115:1", None, None, None), ("nothing", None, None, None)]
TAGGED = [("x <aya_start> «قلم» <aya_end> y", 15, 18, "quran"), ("<hadith_start>كتاب جديد<hadith_end>", 14, 23, "hadith_matn")]
TRAILED = [("قلت. هذا كتاب جديد جدا، رواه مسلم", 5, 22, "hadith_matn"), ("هذا كتاب رواه", None, None, None)]
INTRODUCED = [("وقال تعالى: هذا كتاب جديد جدا. نعم", 12, 29, "quran"), ("قال رسول الله صلى الله عليه وسلم هذا كتاب جديد", 33, 46, "hadith_matn"), ("قال فلان هذا كتاب", None, None, None), ("قال ﷺ: هذا كتاب جديد، نعم", 7, 25, "hadith_matn"), ("وفي الحديث قال عز وجل رضي الله عنه هذا بيت جديد؟ لا", 11, 47, "hadith_matn"), ("وفي الحديث قال عز وجل رضي الله عنه هذا بيت جديد؟ لا", 35, 47, "quran")]
REFERENCES = [(1, 7, None, 7, True), (1, 8, None, 7, False), (2, 3, 5, 286, True), (2, 5, 3, 286, False), (115, 1, None, None, False)]


def rows(spark, data, schema, *picked):
    return spark.createDataFrame([tuple(r[k] for k in picked) for r in data], schema)


@pytest.mark.parametrize("data", [FOLDS, COMPOSITIONS])
def test_folds(spark, data):
    t = rows(spark, data, "text string", 0)
    assert [tuple(r) for r in t.select("text", O.joined(O.loose_tokens(F.col("text"))), O.joined(O.strict_tokens(F.col("text")))).collect()] == data


def test_spans(spark):
    t = rows(spark, SPANS, "text string", 0).distinct().select("text", F.posexplode(O.tokens(F.col("text"))).alias("pos", "t"))
    assert sorted(map(tuple, t.select("text", "pos", "t.loose", "t.start", "t.end").collect())) == sorted(SPANS)


def test_classes_and_vowels(spark):
    c = rows(spark, CLASSES, "u string, c string", 0, 1)
    assert [tuple(r) for r in c.select("u", "c", O.classify(F.col("u"), F.col("c"))).collect()] == CLASSES
    v = rows(spark, VOWELS, "u string, r string, f boolean", 0, 1, 2)
    d = O.compare_vowels(F.col("u"), F.col("r"), F.col("f"))
    assert [tuple(r) for r in v.select("u", "r", "f", F.when(d.isNotNull(), F.array_join(F.transform(d, lambda x: x["kind"]), ","))).collect()] == VOWELS


def test_foreign_runs_and_claims(spark):
    runs = E.foreign_runs(F.col("text"))
    assert [tuple(r) for r in rows(spark, FOREIGN, "text string", 0).select("text", F.when(runs.isNotNull(), F.array_join(F.transform(runs, lambda r: r["value"]), ","))).collect()] == FOREIGN
    c = E.claimed_source(F.col("text"))
    assert [tuple(r) for r in rows(spark, CLAIMS, "text string", 0).select("text", F.array_join(c["books"], ","), c["surah"], c["ayah"]).collect()] == CLAIMS


@pytest.mark.parametrize(("data", "find"), [(TAGGED, E.tagged), (TRAILED, E.trailed), (INTRODUCED, E.introduced)])
def test_spans_of_rules(spark, data, find):
    t = rows(spark, data, "id string, text string", 0, 0).distinct()
    got = t.select("id").join(find(t), "id", "left").select("id", "start", "end", "kind").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, data))


def test_references(spark):
    t = rows(spark, REFERENCES, "surah int, ayah int, ayah_to int, verses int", 0, 1, 2, 3)
    assert [tuple(r) for r in t.select("*", P.possible_reference(F.col("surah"), F.col("ayah"), F.col("ayah_to"), F.col("verses"))).collect()] == REFERENCES
