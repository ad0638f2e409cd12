"""What queries do once for a row, a word or a text, and must not do once for each place."""

import math
import re
import unicodedata

import pytest
from pyspark.sql import functions as F
from quillmark.functions import orthography as O
from quillmark.operators import evaluation, index, intervals
from quillmark.operators import messages as G
from quillmark.operators import tables
from quillmark.plans import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_class_of_letters_has_few_members():
    assert set(re.findall(f"[{O.PRESENTATION}]", "".join(map(chr, range(0xFB00, 0xFFFF))))) == set(O._FORMS)
    assert len(O.PRESENTATION) < 60 < len(O._FORMS)


def test_tokens_are_folded_as_one_text(spark):
    assert "transform(CASE WHEN" not in plan(spark.createDataFrame([("a",)], "t string").select(O.joined(O.loose_tokens(F.col("t")))))
    rows = spark.createDataFrame([("قَالَ  ﻻ ىٔ (12) آمَنَ\nأُولَئِكَ",), ("",), ("latin 7",), (None,)], "t string")
    got = rows.select(O.loose_tokens(F.col("t")), O.strict_tokens(F.col("t")), F.transform(O.surfaces(F.col("t")), O.loose_form), F.transform(O.surfaces(F.col("t")), O.strict_form)).collect()
    assert all(r[0] == r[2] and r[1] == r[3] for r in got) and len(got[0][0]) == 5


def test_combining_marks_are_told_from_all_others(spark):
    some = [chr(p) for p in range(0x20, 0x3100) if unicodedata.category(chr(p)) != "Cs"]
    got = spark.createDataFrame([(c,) for c in some], "c string").select("c", F.col("c").rlike(f"^{G.MARKS}$").alias("m")).collect()
    assert all(r.m == bool(unicodedata.combining(r.c)) for r in got if ord(r.c) >= 0x300)


@pytest.mark.parametrize("name", ["ar_bare_class", "vowel_diffs"])
def test_a_word_is_judged_once(spark, name):
    assert plan(QUERIES[name].run(spark, FOLDER)).count("Aggregate [") >= 2


def test_spans_meet_no_lengths(spark):
    spans = spark.createDataFrame([(1, 0, -3, 4, "a"), (1, 1, 2, 99, "b"), (2, 0, 0, 5, "a"), (None, 0, 0, 5, "a")], "id long, ord long, start int, end int, label string")
    lengths = spark.createDataFrame([(1, 10), (3, 4), (4, 0)], "id long, n int")
    cells = evaluation.swept(spans, spans.where("label = 'a'"), lengths)
    assert "Join" not in plan(cells)
    got = sorted((r.id, r.truth, r.predicted, r.n) for r in cells.collect())
    assert got == [(1, "a", "a", 2), (1, "b", "", 6), (1, "b", "a", 2), (3, "", "", 4)]


def test_runs_read_marks_once(spark):
    marks = spark.createDataFrame([(1, 2, 5, "a"), (1, 4, 9, "b"), (2, 0, 3, "a"), (5, 0, 1, "a"), (None, 0, 1, "a")], "id long, start int, end int, kind string")
    runs = intervals.annotation_runs(spark.createDataFrame([(1, 12), (2, 3), (3, 4), (4, 0)], "id long, n int"), marks)
    assert "Join" not in plan(runs)
    got = sorted((r.id, r.ord, r.kind, r.start, r.end) for r in runs.collect())
    assert got == [(1, 0, "text", 0, 2), (1, 1, "a", 2, 5), (1, 2, "b", 5, 9), (1, 3, "text", 9, 12), (2, 0, "a", 0, 3), (3, 0, "text", 0, 4)]


def test_painted_spans_are_those_swept(spark):
    kind = "array<struct<start:int,end:int>>"
    rows = [(1, 12, [(0, 4), (4, 6)], [(5, 9)], [(3, 12)]), (2, 0, [], [], []), (3, 5, [], [], [(0, 5)]), (4, 3, [], [], [])]
    texts = spark.createDataFrame(rows, f"id long, n int, a {kind}, b {kind}, c {kind}")
    got = evaluation.painted(texts, {"a": "x", "b": "y"}, {"c": "x"})
    assert "Repartition" not in plan(got) and "Join" not in plan(got)
    spans = lambda c, k, label: texts.select("id", F.explode(c).alias("s")).select("id", (F.col("s.start") + k).alias("ord"), "s.start", "s.end", F.lit(label).alias("label"))
    want = evaluation.swept(spans("a", 0, "x").unionByName(spans("b", 100, "y")), spans("c", 0, "x"), texts.select("id", "n"))
    assert sorted(map(tuple, got.collect())) == sorted((r.id, r.truth, r.predicted, r.n) for r in want.collect())


def test_scores_of_characters_shuffle_no_spans(spark):
    assert "Generate explode" not in plan(QUERIES["char_confusion"].run(spark, FOLDER))


def test_scores_read_cells_once(spark):
    rows = [(1, "a", "a", 3), (1, "a", "", 1), (1, "", "b", 2), (2, "", "", 5)]
    f1 = evaluation.macro_f1(spark.createDataFrame(rows, "id long, truth string, predicted string, n long"), "id")
    assert "Join" not in plan(f1)
    assert sorted(map(tuple, f1.collect())) == [(1, round(6 / 7 / 3, 6)), (2, 1.0)]


def shuffled(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_pairs_of_words_stay_where_they_are(spark):
    assert "SortMergeJoin" not in shuffled(QUERIES["census_proof"].run(spark, FOLDER))


def test_kept_terms_meet_queries_by_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = shuffled(QUERIES["bm25_words"].run(spark, FOLDER))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert any("BroadcastHashJoin [term" in line for line in text.splitlines())


def test_stored_tables_are_well_compressed(spark, tmp_path):
    source = f"file://{tmp_path}/source"
    spark.range(3).write.parquet(source)
    assert all(".zstd." in path for path in tables.stored(spark, source, "any", lambda: spark.range(9)).inputFiles())


def reads(df, column):
    """How often a query reads the table that has this column."""
    return sum("Relation [" in line and f"{column}#" in line for line in plan(df).splitlines())


@pytest.mark.parametrize(("name", "most"), [("anchors", 2), ("anchor_accept", 1)])
def test_texts_are_read_for_their_grams_only(spark, name, most):
    df = QUERIES[name].run(spark, FOLDER)
    assert 0 < reads(df, ",n") <= most  # of the documents' token lines, which alone have n
    assert "sequence(" not in plan(df)  # neither hashes place by place nor a row for each telling word


@pytest.mark.parametrize("name", ["candidates_topk", "rule_pick"])
def test_two_channels_read_and_join_texts_once(spark, name):
    df = QUERIES[name].run(spark, FOLDER)
    assert reads(df, "[doc_id") == 1


@pytest.mark.parametrize("name", ["tok_loose", "tok_strict"])
def test_lines_of_tokens_need_no_table(spark, name):
    text = plan(QUERIES[name].run(spark, FOLDER))
    assert "Relation [doc_id" in text and text.count("regexp_extract_all") == 1


def test_lines_are_the_joined_tokens(spark):
    rows = spark.createDataFrame([(1, "Straße, ÀÉ x_1"), (2, "plain Text"), (3, ""), (4, None), (5, "İstanbul 7")], "id int, text string")
    want, got = index.streams(rows, "id"), index.tokenised(index.lines(rows, "id"))
    assert sorted(map(str, got.select("id", "loose", "strict").collect())) == sorted(map(str, want.select("id", "loose", "strict").collect()))
    assert {r.id: (r.loose, r.n) for r in index.lines(rows, "id").collect()} | {5: 0} == {1: ("strasse ae x 1", 4), 2: ("plain text", 2), 3: ("", 0), 4: ("", 0), 5: 0}


def test_scores_of_two_channels(spark):
    asked = spark.createDataFrame([(1, ["a", "b", "b", "zz"]), (2, ["zz"]), (3, ["c"]), (4, [])], "q int, t array<string>")
    docs = spark.createDataFrame([(7, ["a", "b"]), (8, ["b", "a", "c"]), (9, [])], "id int, t array<string>")
    got = {(r.q, r.id): r.score for r in index.words_and_pairs(asked, docs).collect()}
    assert set(got) == {(1, 7), (1, 8), (3, 8)}

    def part(df, tf, size, average):
        return math.log1p((3 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / average))

    idf = lambda df: math.log1p((3 - df + 0.5) / (df + 0.5))
    assert abs(got[1, 7] - (0.8 * 2 * part(2, 1, 2, 5 / 3) / (2 * idf(2)) + 0.2 * part(1, 1, 1, 1) / idf(1))) < 1e-12
    assert abs(got[1, 8] - 0.8 * 2 * part(2, 1, 3, 5 / 3) / (2 * idf(2))) < 1e-12 and abs(got[3, 8] - 0.8 * part(1, 1, 3, 5 / 3) / idf(1)) < 1e-12
