"""Independent re-proof of verdicts, from texts and records alone: it must not lean on the matcher that it checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import orthography as O

#: Words that are compared at once; a place that fails early costs no more, however long the span is.
BLOCK = 64

#: Words by which a span meets the records; so a common first word alone brings nothing together.
HEAD = 3


def _line(tokens: Column) -> Column:
    """Words between spaces; no word has one, so words stand in others without gaps where their line does in that of the others."""
    return F.concat(F.lit(" "), O.joined(tokens), F.lit(" "))


def _stands(needle: str, hay: str) -> Column:
    """Whether a line of words, of whatever length, stands in another one; that of no words stands nowhere."""
    return (F.trim(needle) != "") & F.contains(hay, needle)


def source_texts(matches: DataFrame, records: DataFrame) -> DataFrame:
    """Rules 1 to 3 of (q, rec, source_text, start, end, quoted, text): the source text is the record's, byte for byte;
    the record exists; the quoted characters are those at their place in the text. Adds ok and rule (the first broken one)."""
    rows = matches.join(records.select(F.col("id").alias("rec"), F.col("text").alias("true_text")), "rec", "left")
    rule = F.when(F.col("true_text").isNull(), "no_record").when(F.col("source_text") != F.col("true_text"), "source_text").when(F.expr("substring(text, start + 1, end - start)") != F.col("quoted"), "span")
    return rows.select("q", "rec", rule.isNull().alias("ok"), rule.alias("rule"))


def exact_again(found: DataFrame, records: DataFrame) -> DataFrame:
    """(q, rec, ok): the strict tokens of ``found`` (q, rec, quoted) stand without a gap in those of the record."""
    rows = found.join(records.select(F.col("id").alias("rec"), _line(O.strict_tokens(F.col("text"), False)).alias("hay")), "rec", "left")
    rows = rows.withColumn("needle", _line(O.strict_tokens(F.col("quoted"), False)))
    return rows.select("q", "rec", F.coalesce(_stands("needle", "hay"), F.lit(False)).alias("ok"))


def open_streams(streams: DataFrame) -> DataFrame:
    """(rec, first, second): from each record's first indexed word on the words of its stream, in both editions."""
    rows = streams.select("strict", "strict_alt", F.explode("parts").alias("p"))
    rest = lambda c: F.slice(c, F.col("p.open") + 1, F.size(c))
    return rows.select(F.col("p.rec").alias("rec"), rest("strict").alias("first"), rest("strict_alt").alias("second"))


def stands_again(found: DataFrame, hays: DataFrame) -> DataFrame:
    """(q, rec, ok): the words of ``found`` (q, rec, needle) stand in the record or run on from it, each word in either edition."""
    rows = found.join(hays, "rec", "left")
    n = F.size("needle")
    part = lambda c, k, b: F.slice(c, k + b, F.least(n - b, F.lit(BLOCK)))
    equal = lambda k, b: F.forall(F.arrays_zip(part("needle", F.lit(1), b).alias("u"), part("first", k, b).alias("a"), part("second", k, b).alias("b")), lambda x: (x["u"] == x["a"]) | (x["u"] == x["b"]))
    same = lambda k: F.forall(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(BLOCK)), lambda b: equal(k, b))
    inside = F.exists(F.sequence(F.lit(1), F.greatest(F.size("first") - n + 1, F.lit(1))), lambda k: (F.get("first", k - 1).eqNullSafe(F.get("needle", F.lit(0))) | F.get("second", k - 1).eqNullSafe(F.get("needle", F.lit(0)))) & same(k))
    return rows.select("q", "rec", F.coalesce((n > 0) & (n <= F.size("first")) & inside, F.lit(False)).alias("ok"))


def completed_again(found: DataFrame, records: DataFrame) -> DataFrame:
    """(q, ok, spellings): bare forms stand somewhere, all places spell them alike, and no other form was chosen.

    ``found``: (q, user array<string>); ``records``: (id, tokens array<string>), strict. Starts again from bare forms,
    not from the matcher's hits.
    """
    bare = lambda c: F.transform(F.col(c), O.bare_form)
    hay = records.select("id", "tokens", bare("tokens").alias("bare"))
    asked = found.select("q", "user", bare("user").alias("b")).where(F.size("user") > 0).withColumn("g", F.least(F.size("b"), F.lit(HEAD)))
    lengths = F.broadcast(asked.select("g").distinct())  # at most HEAD rows
    places = hay.select("id", F.posexplode("bare").alias("k", "t"), "bare").crossJoin(lengths).where(F.col("k") + F.col("g") <= F.size("bare"))
    heads = places.select("id", "k", F.xxhash64("g", F.slice("bare", F.col("k") + 1, F.col("g"))).alias("h"))
    met = asked.withColumn("h", F.xxhash64("g", F.slice("b", 1, F.col("g")))).join(heads, "h").join(hay, "id")
    window = lambda c: F.slice(F.col(c), F.col("k") + 1, F.size("b"))
    places = met.where(window("bare") == F.col("b")).select("q", F.zip_with("user", window("tokens"), O.classify).alias("kinds"), F.array_join(window("tokens"), " ").alias("spelling"))
    judged = places.groupBy("q").agg(F.count_distinct("spelling").alias("spellings"), F.bool_or(F.exists("kinds", lambda k: ~k.isin("equal", "completion"))).alias("swap"))
    rows = found.select("q").join(judged, "q", "left")
    return rows.select("q", (F.coalesce(F.col("spellings") == 1, F.lit(False)) & ~F.coalesce("swap", F.lit(True))).alias("ok"), F.coalesce("spellings", F.lit(0)).alias("spellings"))


def possible_reference(surah: Column, ayah: Column, to: Column, verses: Column) -> Column:
    """Whether a claimed reference can exist; ``verses``: how many the chapter has, null if there is no such chapter."""
    return verses.isNotNull() & ayah.between(1, verses) & (to.isNull() | (to.between(ayah, verses)))
