"""Evidence for quotations: exact places in either edition of the records, proofs of spelling, and near windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import orthography as O
from ..functions.arrays import running
from . import index as I
from . import matching as M

SCRIPTURE, ENCYCLOPEDIA = "quran", "encyclopedia"

#: Columns of records that a corpus may lack: second edition, chapter and verse, vocalised text, words not indexed, and what is shown.
OPTIONAL = {"alt": "string", "chapter": "int", "verse": "int", "vocalised": "string", "skip": "int", "grade": "string", "takhrij": "string", "link": "string"}

# Records compared with a quote, by each channel's ranks and at most; words of them; seeds in a chapter's stream.
CHANNEL, CANDIDATES, BUDGET, STREAM_SEEDS = 50, 100, 400_000, 5


def completed(records: DataFrame) -> DataFrame:
    """``records`` (id, corpus, book, text ..) with all OPTIONAL columns, null where they were absent."""
    return records.select("id", "corpus", "book", "text", *(F.col(c).cast(t).alias(c) if c in records.columns else F.lit(None).cast(t).alias(c) for c, t in OPTIONAL.items()))


def editions(records: DataFrame, arabic: bool) -> DataFrame:
    """(id, corpus, book, chapter, verse, skip, loose, strict, loose_alt, strict_alt) of completed records.

    The second edition's words stand beside the first one's where both have as many; otherwise the first stands for both.
    """
    first = records.select("id", "corpus", "book", "chapter", "verse", F.coalesce("skip", F.lit(0)).alias("skip"), *(f(F.col(c), arabic).alias(n) for c, n in (("text", ""), ("alt", "_alt")) for f, n in ((O.loose_tokens, "loose" + n), (O.strict_tokens, "strict" + n))))
    same = F.size("loose") == F.size("loose_alt")
    return first.withColumns({f"{n}_alt": F.when(same, F.col(f"{n}_alt")).otherwise(F.col(n)) for n in ("loose", "strict")})


def streams(editions_: DataFrame) -> DataFrame:
    """(sid, corpus, loose, strict, loose_alt, strict_alt, parts): a chapter's records one after the other, others alone.

    ``parts``: (rec, first, after, open) of each record in its stream; a search may not begin before ``open``.
    """
    part = lambda rec, first, n, skip: F.struct(rec.alias("rec"), first.cast("int").alias("first"), (first + n).cast("int").alias("after"), (first + skip).cast("int").alias("open"))
    names = ["loose", "strict", "loose_alt", "strict_alt"]
    alone = editions_.where("chapter is null").select(F.col("id").alias("sid"), "corpus", *names, F.array(part(F.col("id"), F.lit(0), F.size("loose"), F.col("skip"))).alias("parts"))
    verses = editions_.where("chapter is not null").groupBy("corpus", "chapter").agg(F.array_sort(F.collect_list(F.struct("verse", "id", "skip", *names))).alias("v"))
    first = running(F.transform("v", lambda x: F.size(x["loose"])))
    parts = F.zip_with("v", first, lambda x, a: part(x["id"], a, F.size(x["loose"]), x["skip"]))
    chapters = verses.select(F.get("v", F.lit(0))["id"].alias("sid"), "corpus", *(F.flatten(F.col(f"v.{n}")).alias(n) for n in names), parts.alias("parts"))
    return alone.unionByName(chapters)


def at(parts: Column, place: Column) -> Column:
    """The part of a stream that holds a place."""
    return F.get(F.filter(parts, lambda p: (p["first"] <= place) & (place < p["after"])), F.lit(0))


def exact_places(quotes: DataFrame, streams_: DataFrame) -> DataFrame:
    """(q, id, sid, corpus, variant, start, place, strict_ok, user, first, second) of each place where a quote's loose words stand.

    ``id`` and ``start``: record and place in it; ``place``: in the stream. A word agrees strictly if it does with either edition.
    """
    found = None
    for variant, name in enumerate(("loose", "loose_alt")):
        rows = streams_ if variant == 0 else streams_.where("loose <> loose_alt")
        hits = M.phrase_hits(quotes, rows.select(F.col("sid").alias("id"), F.col(name).alias("loose"), F.col("strict"))).select("q", F.col("id").alias("sid"), F.col("start").alias("place"), F.lit(variant).alias("variant"))
        found = hits if found is None else found.unionByName(hits)
    met = found.join(quotes.select("q", F.col("strict").alias("user")), "q").join(streams_.select("sid", "corpus", "strict", "strict_alt", "parts"), "sid")
    window = lambda c: F.slice(c, F.col("place") + 1, F.size("user"))
    rows = met.select("q", "sid", "corpus", "variant", "place", "user", window("strict").alias("first"), window("strict_alt").alias("second"), at(F.col("parts"), F.col("place")).alias("p")).where("place >= p.open")
    ok = F.forall(F.arrays_zip("user", "first", "second"), lambda x: (x["user"] == x["first"]) | (x["user"] == x["second"]))
    return rows.select("q", F.col("p.rec").alias("id"), "sid", "corpus", "variant", (F.col("place") - F.col("p.first")).alias("start"), "place", ok.alias("strict_ok"), "user", "first", "second")


def proofs(places: DataFrame) -> DataFrame:
    """(q, corpus, rasm, spelling, alternatives): of quotes without a strict place, whether the corpus proves what wasn't written.

    rasm: unique (one spelling, nothing chosen otherwise), ambiguous, or no row where a word is another one.
    """
    loose = places.where(~F.col("any"))
    keyed = loose.select(F.struct("q", "corpus").alias("q"), F.struct("sid", "place").alias("place"), "user", "first", "second").dropDuplicates(["q", "place"])
    judged = M.census(keyed).where("proved")
    return judged.select("q.q", "q.corpus", F.when(F.col("unique"), "unique").otherwise("ambiguous").alias("rasm"), "spelling", "alternatives")


def near_records(quotes: DataFrame, records: DataFrame) -> DataFrame:
    """(q, id, rank) of the records nearest to each quote by words and trigrams, channels fused; ``records``: (id, loose), one corpus side."""
    grams = lambda c: F.flatten(F.transform(c, lambda t: O.grams(t)))
    words = I.bm25(quotes.select("q", F.col("loose").alias("terms")), records.select("id", F.col("loose").alias("terms")))
    trigrams = I.bm25(quotes.select("q", grams("loose").alias("terms")), records.select("id", grams("loose").alias("terms")), I.GRAM_CUTOFF)
    return I.top_k(I.fused([I.top_k(words, CHANNEL), I.top_k(trigrams, CHANNEL)]), CANDIDATES, 9)


def within_budget(near: DataFrame, sizes: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The first of a quote's near records whose words together stay under a budget; the one that passes it is the last."""
    upto = Window.partitionBy("q").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    return near.join(sizes, "id").withColumn("used", F.coalesce(F.sum("n").over(upto), F.lit(0))).where(F.col("used") < budget).drop("used", "n")


def near_windows(quotes: DataFrame, editions_: DataFrame, streams_: DataFrame) -> DataFrame:
    """(q, id, at, w, score, place, sid, mixed): each near record's best window, of scripture in its chapter's stream too.

    ``mixed``: null, or where the window is as long as the quote and each word is one of two spellings, whether it is strict.
    """
    found = None
    for scripture in (True, False):
        side = editions_.where((F.col("corpus") == SCRIPTURE) == F.lit(scripture))
        near = within_budget(near_records(quotes, side), side.select("id", F.size("loose").cast("long").alias("n")))
        pairs = near.join(quotes.select("q", F.col("loose").alias("ql")), "q").join(side.select("id", F.slice("loose", F.col("skip") + 1, F.size("loose")).alias("loose"), "skip"), "id")
        best = M.best_windows(M.windows(pairs.select("q", "ql", "id", "loose"))).join(side.select("id", "skip"), "id").select("q", "id", (F.col("at") + F.col("skip")).alias("at"), "w", "score")
        found = best if found is None else found.unionByName(best)
    parts = streams_.select("sid", "corpus", F.explode("parts").alias("p")).select("sid", "corpus", F.col("p.rec").alias("id"), "p.first", "p.open")
    placed = found.join(parts, "id").select("q", "id", "sid", "corpus", "at", "w", "score", (F.col("first") + F.col("at")).alias("place"))
    seeds = placed.where(F.col("corpus") == SCRIPTURE).withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("n") <= STREAM_SEEDS)
    around = M.region(seeds.join(quotes.select("q", F.col("loose").alias("ql")), "q").select("q", "ql", F.col("sid").alias("id"), F.col("place").alias("at"), "w"), streams_.select(F.col("sid").alias("id"), "loose"))
    keyed = around.select(F.struct("q", "low").alias("q"), "ql", "id", "loose").distinct()
    wide = M.best_windows(M.windows(keyed)).select("q.q", F.col("id").alias("sid"), (F.col("at") + F.col("q.low")).alias("place"), "w", "score")
    wide = wide.join(streams_.select("sid", "corpus", "parts"), "sid").withColumn("p", at(F.col("parts"), F.col("place"))).where("place >= p.open")
    every = placed.unionByName(wide.select("q", F.col("p.rec").alias("id"), "sid", "corpus", (F.col("place") - F.col("p.first")).alias("at"), "w", "score", "place"))
    best = Window.partitionBy("q", "id").orderBy(F.desc("score"), "w", "at")
    one = every.withColumn("k", F.row_number().over(best)).where("k = 1").drop("k")
    names = ["loose", "strict", "loose_alt", "strict_alt"]
    met = one.join(quotes.select("q", F.col("loose").alias("ql"), F.col("strict").alias("qs")), "q").join(streams_.select("sid", *names), "sid")
    cut = lambda c: F.slice(c, F.col("place") + 1, F.col("w"))
    either = lambda q, a, b: F.forall(F.arrays_zip(F.col(q).alias("q"), cut(a).alias("a"), cut(b).alias("b")), lambda x: (x["q"] == x["a"]) | (x["q"] == x["b"]))
    mixed = F.when((F.col("corpus") == SCRIPTURE) & (F.col("w") == F.size("ql")) & either("ql", "loose", "loose_alt"), either("qs", "strict", "strict_alt"))
    return met.select("q", "id", "sid", "corpus", "at", "w", "score", "place", mixed.alias("mixed"))


_ROWS = ["q", "id", "sid", "corpus", "start", "place", "w", "score", "is_exact", "strict_ok", "rasm", "first_edition"]


def gathered(quotes: DataFrame, records: DataFrame, own: DataFrame, lib: DataFrame, settle=lambda df: df) -> DataFrame:
    """Evidence (q, id, sid, corpus, book, start, place, w, score, is_exact, strict_ok, rasm, first_edition).

    ``quotes``: (q, loose, strict); ``own``: the records' editions, ``lib``: their streams. Exact places first, one for each of a record's; where no place of a quote is strict, the
    corpora are asked for proof. Only quotes without any place are compared with near windows. A window whose words are each
    one of two spellings is exact; others score below one. ``first_edition``: strict in the first edition but not in the second.
    """
    places = settle(exact_places(quotes, lib).withColumn("any", F.bool_or("strict_ok").over(Window.partitionBy("q"))))
    proved = settle(proofs(places))
    one = Window.partitionBy("q", "id", "variant")
    second = places.withColumn("ok1", F.bool_or(F.forall(F.arrays_zip("user", "second"), lambda x: x["user"] == x["second"])).over(Window.partitionBy("q", "id")))
    flagged = second.groupBy("q", "id").agg(F.bool_and(~F.col("ok1")).alias("first_edition"))
    hits = M.dedupe_hits(places.select("q", "id", "variant", "start", "strict_ok")).select("q", "id", "variant", "start", "strict_ok")
    whole = places.groupBy("q", "id", "sid", "corpus").agg(F.min("place").alias("place"), F.max(F.size("user")).alias("w"))
    exact = hits.groupBy("q", "id").agg(F.min("start").alias("start"), F.bool_or("strict_ok").alias("strict_ok")).join(whole, ["q", "id"]).join(flagged, ["q", "id"]).join(proved.select("q", "corpus", "rasm"), ["q", "corpus"], "left")
    exact = exact.select("q", "id", "sid", "corpus", "start", "place", "w", F.lit(1.0).alias("score"), F.lit(True).alias("is_exact"), "strict_ok", F.coalesce("rasm", F.lit("")).alias("rasm"), (F.col("first_edition") & F.col("strict_ok")).alias("first_edition"))
    rest = settle(quotes.join(places.select("q").distinct(), "q", "left_anti"))
    near = near_windows(rest, own, lib)
    fuzzy = near.select("q", "id", "sid", "corpus", F.col("at").cast("int").alias("start"), F.col("place").cast("int").alias("place"), F.col("w").cast("int").alias("w"), F.when(F.col("mixed").isNotNull(), 1.0).otherwise(F.least("score", F.lit(0.999))).alias("score"), F.col("mixed").isNotNull().alias("is_exact"), F.coalesce("mixed", F.lit(False)).alias("strict_ok"), F.lit("").alias("rasm"), F.lit(False).alias("first_edition"))
    rows = exact.unionByName(fuzzy).join(records.select("id", "book"), "id")
    return settle(rows)


def matched_verse(evidence: DataFrame, records: DataFrame, claims: DataFrame) -> DataFrame:
    """(q, m_surah, m_ayah): the verse that a quote strictly is: the claimed one if it is among them, else that of the best record.

    ``claims``: (q, surah, ayah, ayah_to).
    """
    rows = evidence.where((F.col("corpus") == SCRIPTURE) & F.col("is_exact") & F.col("strict_ok")).join(records.select("id", "chapter", "verse"), "id").join(claims, "q", "left")
    claimed = F.coalesce((F.col("chapter") == F.col("surah")) & F.col("verse").between(F.col("ayah"), F.coalesce("ayah_to", "ayah")), F.lit(False))
    best = F.min_by(F.struct("chapter", "verse"), F.struct(~claimed, "id")).alias("v")
    return rows.groupBy("q").agg(best).select("q", F.col("v.chapter").alias("m_surah"), F.col("v.verse").alias("m_ayah"))


def covered(evidence: DataFrame, streams_: DataFrame) -> DataFrame:
    """(q, id, rec, ord): the records that the window of each piece of evidence runs over, in their order."""
    met = evidence.join(streams_.select("sid", "parts"), "sid")
    inside = F.filter("parts", lambda p: (p["first"] < F.col("place") + F.col("w")) & (F.col("place") < p["after"]))
    return met.select("q", "id", F.posexplode(F.transform(inside, lambda p: p["rec"])).alias("ord", "rec"))


def fragments(evidence: DataFrame, streams_: DataFrame) -> DataFrame:
    """(q, fragment): whether no exact place begins with its first record's first word and ends with its last one's last."""
    rows = evidence.where("is_exact").join(streams_.select("sid", "parts"), "sid")
    first, last = at(F.col("parts"), F.col("place")), at(F.col("parts"), F.col("place") + F.col("w") - 1)
    whole = (F.col("place") == first["open"]) & (F.col("place") + F.col("w") == last["after"])
    return rows.groupBy("q").agg((~F.bool_or(whole)).alias("fragment"))


def compared(evidence: DataFrame, quotes: DataFrame, records: DataFrame, streams_: DataFrame, arabic: bool) -> DataFrame:
    """(q, id, start, w, quoted, words, text, window, other, vocalised) of each piece of evidence.

    ``words``: array<struct<loose,strict,start,end>> of the quotation; ``window``: array<struct<strict,start,end>> of the words
    it was matched with, places in the record's text, -1 for words of other records of the stream; ``other``: the same words
    in the second edition. ``quotes``: (q, quoted); ``records``: completed ones.
    """
    met = evidence.select("q", "id", "sid", "start", "place", "w").join(quotes.select("q", "quoted"), "q").join(records.select("id", "text", "vocalised"), "id").join(streams_.select("sid", "strict", "strict_alt"), "sid")
    cut = lambda c: F.slice(c, F.col("place") + 1, F.col("w"))
    rows = met.select("q", "id", "start", "w", "quoted", "text", "vocalised", O.tokens(F.col("quoted"), arabic).alias("words"), O.tokens(F.col("text"), arabic).alias("shown"), cut("strict").alias("s"), cut("strict_alt").alias("other"))

    def word(strict: Column, k: Column) -> Column:
        at_ = F.when(F.col("start") + k >= 0, F.get("shown", F.col("start") + k))
        return F.struct(strict.alias("strict"), F.coalesce(at_["start"], F.lit(-1)).alias("start"), F.coalesce(at_["end"], F.lit(-1)).alias("end"))

    return rows.select("q", "id", "start", "w", "quoted", "words", "text", F.transform("s", word).alias("window"), "other", "vocalised")


def vowel_diffs(rows: DataFrame) -> DataFrame:
    """(q, id, found): array<struct<k, kind, quote_chars, source_chars>> of conflict, missing and waqf between a vocalised quote
    and each record that it is; null where letters don't align. ``k``: the word's number; places in the quote and the record.

    ``rows``: of ``compared``. The reference is the record's vocalised text where it has as many words as the shown text, else
    the shown text itself; what aligns with neither can't be told. Windows that run past their record don't align. The letter
    is marked in the shown word, or all of that word if it has another number of letters.
    """
    written = lambda text, a: F.regexp_extract(F.substring(text, a + 1, F.length(text)), "^(?:[ء-يٱ][^\\sء-يٱ]*)+", 0)
    voiced = F.transform(O.tokens(F.col("vocalised")), lambda t: written(F.col("vocalised"), t["start"]))
    shown = O.tokens(F.col("text"))
    named = rows.select("q", "id", "quoted", "words", "window", "text", F.when(F.size(voiced) == F.size(shown), F.slice(voiced, F.col("start") + 1, F.col("w"))).alias("voiced"))
    pairs = F.zip_with("words", "window", lambda u, d: F.struct(u["start"].alias("at"), written(F.col("quoted"), u["start"]).alias("u"), d["start"].alias("da"), F.when(d["start"] >= 0, written(F.col("text"), d["start"])).alias("d")))
    rows = named.where(F.size("words") == F.size("window")).select("q", "id", pairs.alias("pairs"), "voiced")

    def judged(x: Column, k: Column) -> Column:
        final = k == F.size("pairs") - 1
        found = F.coalesce(O.compare_vowels(x["u"], F.get("voiced", k), final), O.compare_vowels(x["u"], x["d"], final))
        letters = O.skeleton(x["d"])
        same = F.size(letters) == F.size(O.skeleton(x["u"]))

        def place(f: Column) -> Column:
            letter = F.get(letters, f["i"])
            source = F.when(same, F.array(x["da"] + letter["start"], x["da"] + letter["end"])).otherwise(F.array(x["da"], x["da"] + F.length(x["d"])))
            return F.struct(k.cast("int").alias("k"), f["kind"].alias("kind"), F.array(x["at"] + f["u_start"], x["at"] + f["u_end"]).alias("quote_chars"), source.alias("source_chars"))

        return F.transform(found, place)

    each = F.transform("pairs", judged)
    return rows.select("q", "id", each.alias("each")).select("q", "id", F.when((F.size("each") > 0) & F.forall("each", lambda e: e.isNotNull()), F.flatten("each")).alias("found"))
