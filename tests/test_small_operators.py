from pyspark.sql import functions as F
from quillmark import api
from quillmark.operators import decisions as D
from quillmark.operators import evaluation as V
from quillmark.operators import extraction as E
from quillmark.streaming.checks import windowed_counts


def test_tags_are_no_part_of_quotations(spark):
    t = spark.createDataFrame([("a <aya_start>b<aya_end> c",), ("none",), (None,)], "t string")
    got = [r.x for r in t.select(E.tag_places(F.col("t")).alias("x")).collect()]
    assert [[(x.start, x.end) for x in r or []] for r in got] == [[(2, 13), (14, 23)], [], []]


def test_outputs_that_differ_between_repeats(spark):
    runs = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("b", "y")], "case_id string, output string")
    assert [tuple(r) for r in V.unstable(runs).collect()] == [("b", 2)]


def test_receipts_tell_whether_verdicts_are_current(spark):
    then = spark.createDataFrame([(1, "h"), (2, "h"), (3, "h")], "id int, hash string")
    now = spark.createDataFrame([(1, "h"), (2, "other")], "id int, hash string")
    assert {r.id: r.state for r in D.receipt_state(then, now).collect()} == {1: "current", 2: "stale", 3: "unknown"}


def test_arabic_number_agreement(spark):
    forms = ("one", "two", "few", "many")
    rows = spark.createDataFrame([(n,) for n in (1, 2, 3, 10, 11)], "n int").select(D.agree(F.col("n"), forms).alias("s")).collect()
    assert [r.s for r in rows] == ["one", "two", "3 few", "10 few", "11 many"]


def test_compact_verdicts(spark):
    schema = "id long, start int, status string, reason string, quoted string, notices array<string>, matches array<struct<rec:bigint>>"
    verdicts = spark.createDataFrame([(1, 0, "found", None, "q", ["many_positions", "quran_fragment", "waqf_note"], [(7,), (8,)]), (1, 9, "not_found", None, "r", [], [])], schema)
    sentences = spark.createDataFrame([("waqf_note", "a pause"), ("quran_fragment", "a part"), ("many_positions", "many")], "notice string, said string")
    got = {r.start: (r.ref, r.said) for r in api.compact_check(verdicts, sentences).collect()}
    assert got == {0: (7, ["a part", "a pause"]), 9: (None, [])}


def test_events_in_windows(spark):
    events = spark.createDataFrame([("2024-01-01 00:01:00", "a"), ("2024-01-01 00:04:59", "a"), ("2024-01-01 00:05:00", "b")], "t string, event_type string").select(F.to_timestamp("t").alias("ts"), "event_type")
    assert sorted((r.event_type, r["count"]) for r in windowed_counts(events).collect()) == [("a", 2), ("b", 1)]
