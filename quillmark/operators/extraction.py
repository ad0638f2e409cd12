"""Quotations, tags and claims in free text: spans by brackets, introducing words, trailing words, tags; merging; detectors."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import orthography as O
from ..functions.arrays import bound, placed, running
from . import lexicon as L

def places(text: Column, pattern: str) -> Column:
    """array<struct<value, start, end>> of all matches of a pattern, in code points."""
    return placed(text, pattern, lambda m, a, b: F.struct(m.alias("value"), a.alias("start"), b.alias("end")))


def _quoted(s: str) -> str:
    return "\\" + s if s in "()[]{}" else s


def is_reference(inner: Column) -> Column:
    """Bracketed text that cites rather than quotes: numbers, chapter and verse, who narrated it, an honorific."""
    t = F.trim(inner)
    agreed = F.greatest(*(t.contains(p) for p in L.AGREED))
    verses = t.rlike(L.VERSE_WORDS) & t.rlike(r"\d")
    honorific = O.joined(O.loose_tokens(t)).isin(*L.HONORIFICS, "رضي الله عنهم")
    return (t == "") | t.rlike(f"^(?:{L.NUMBERS_ALONE})$") | t.rlike(f"^(?:{L.VERSE})$") | agreed | t.rlike(f"^{L.NARRATED_BY}") | verses | honorific


_SPAN = "struct<start:int,end:int,kind:string,marked:boolean>"


def bracketed(texts: DataFrame, least_arabic: int = 2, least_latin: int = 3) -> DataFrame:
    """(id, start, end, kind, marked) of what stands in each kind of brackets and isn't a reference. ``texts``: (id, text), read once."""

    def inside(first: str, last: str) -> Column:
        make = lambda m, a, b: F.struct(F.substring(m, F.lit(2), F.length(m) - 2).alias("inner"), (a + 1).alias("start"), (b - 1).alias("end"), F.lit("quran" if first == "﴿" else "unknown").alias("kind"))
        return placed(F.col("text"), f"{_quoted(first)}[^{_quoted(last)}]*{_quoted(last)}", make)

    spans = texts.select("id", F.explode(F.concat(*(inside(a, b) for a, b in L.BRACKETS))).alias("m")).select("id", "m.*")
    enough = (F.size(O.surfaces(F.col("inner"))) >= least_arabic) | (F.regexp_count("inner", F.lit("[A-Za-z]{2,}")) >= least_latin)
    return spans.where(enough & ~is_reference(F.col("inner"))).select("id", "start", "end", "kind", F.lit(True).alias("marked"))


def uncovered(spans: DataFrame, by: DataFrame) -> DataFrame:
    """The spans that overlap none of ``by`` in their text.

    One pass over a text's places: a span is covered if, of all that begin before its end, one reaches beyond its start.
    """
    row = F.struct(*spans.columns)
    asked = spans.select("id", F.col("end").cast("long").alias("key"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("reach"), row.alias("row"))
    there = by.select("id", F.col("start").cast("long").alias("key"), F.lit(1).alias("side"), F.col("end").cast("long").alias("reach"), F.lit(None).cast(asked.schema["row"].dataType).alias("row"))
    before = Window.partitionBy("id").orderBy("key", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = asked.unionByName(there).withColumn("reach", F.max("reach").over(before)).where("side = 0")
    return met.where(F.col("id").isNull() | F.col("reach").isNull() | (F.col("reach") <= F.col("row.start"))).select("row.*")


def introduced_english(texts: DataFrame) -> DataFrame:
    """(id, start, end, kind, marked): what follows an introducer, to the end of the sentence; three Latin words at least."""
    m = texts.select("id", "text", F.explode(places(F.col("text"), L.INTRODUCERS_EN)).alias("m"))
    rest = m.select("id", "m", F.expr("substring(text, m.end + 1)").alias("rest"))
    body = rest.withColumn("body", F.rtrim(F.get(F.split("rest", L.SENTENCE_END_EN, 2), F.lit(0)))).where(~F.substring("rest", 1, 1).isin(*(a for a, _ in L.BRACKETS)))
    kept = body.where((F.regexp_count("body", F.lit("[A-Za-z]{2,}")) >= 3) & (F.size(O.surfaces(F.col("body"))) == 0))
    said = F.lower("m.value").contains("said") & ~F.lower("m.value").contains("allah")
    return kept.select("id", F.col("m.end").alias("start"), (F.col("m.end") + F.length("body")).alias("end"), F.when(said, "hadith_matn").otherwise("quran").alias("kind"), F.lit(False).alias("marked"))


def trailed(texts: DataFrame, least: int = 3) -> DataFrame:
    """(id, start, end, kind, marked): what precedes a trailer, back to the last sentence's end. Callers keep the ``uncovered`` ones."""
    pattern = "(?<![ء-ي])(?:" + "|".join(L.TRAILERS) + ")"
    m = texts.select("id", "text", F.explode(places(F.col("text"), pattern)).alias("m"))
    before = F.regexp_replace(F.expr("substring(text, 1, m.start)"), "[\\s،,\\-–—]+$", "")
    rows = m.select("id", F.regexp_extract(before, f"[^{L.SENTENCE[1:]}*$", 0).alias("body"), F.length(before).alias("end"), F.col("m.value").startswith("صدق").alias("scripture"))
    rows = rows.withColumn("body", F.ltrim("body")).where(F.size(O.surfaces(F.col("body"))) >= least)
    return rows.select("id", (F.col("end") - F.length("body")).alias("start"), "end", F.when(F.col("scripture"), "quran").otherwise("hadith_matn").alias("kind"), F.lit(False).alias("marked")).distinct()


def _words(phrase: str) -> str:
    """A phrase of loose words as a pattern over marked words, see ``marked_words``."""
    return f"{L.LIGATURE}? ".join(phrase.split(" "))


def introducer_pattern(phrases: tuple[str, ...]) -> str:
    """Introducers and the honorifics after them, over marked words; the longest of those that begin at a place."""
    loose = {" ".join(_LOOSE(p)) for p in phrases}
    whole = sorted((p for p in loose if p not in L.BARE_VERBS), key=lambda p: (-len(p.split()), p))
    some = "|".join([*map(_words, whole), *(v + L.LIGATURE for v in L.BARE_VERBS)])
    return f"(?<![^ ])[وف]?(?:{some})(?![^ {L.LIGATURE}])(?>(?:{L.LIGATURE}? )(?:{'|'.join(map(_words, L.HONORIFICS))})(?![^ {L.LIGATURE}]))*"


def _LOOSE(phrase: str) -> list[str]:
    """The loose words of a short constant phrase, as ``loose_tokens`` makes them."""
    return phrase.replace(L.LIGATURE, " ").translate(str.maketrans(*O.LOOSE)).split()


INTRODUCER = introducer_pattern(L.INTRODUCERS)


def marked_words(text: Column, tokens: Column) -> Column:
    """Loose words joined by a space, each with the ligature after it if one stands before the next word."""

    def word(t: Column, i: Column) -> Column:
        after = F.coalesce(F.get(tokens, i + 1)["start"], F.length(text))
        return F.concat(t["loose"], F.when(F.substring(text, t["end"] + 1, after - t["end"]).contains(L.LIGATURE), L.LIGATURE).otherwise(""))

    return F.array_join(F.transform(tokens, word), " ")


def kind_of_introducer(words: Column) -> Column:
    any_ = lambda names: F.greatest(*(words.contains(n) for n in names))
    return F.when(any_(L.OF_SCRIPTURE) & ~any_(L.OF_NARRATION), "quran").otherwise("hadith_matn")


def introduced(texts: DataFrame, phrases: tuple[str, ...] = L.INTRODUCERS, least: int = 3) -> DataFrame:
    """(id, start, end, kind, marked): from the word after an introducer (and honorifics) to the end of the sentence.

    Introducers are found on loose words, the longest at a place; one inside another is none. A conjunction may stand
    before its first word. Texts are read once and meet nothing.
    """
    pattern = INTRODUCER if phrases == L.INTRODUCERS else introducer_pattern(phrases)
    spaces = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
    openers = "[" + "".join(_quoted(a) for a, _ in L.BRACKETS) + "]"

    def hits(t: Column) -> Column:
        found = bound(marked_words(F.col("text"), t), lambda w: placed(w, pattern, lambda m, a, b: F.struct(m.alias("intro"), (spaces(F.substring(w, F.lit(1), b)) + 1).alias("j"))))
        place = lambda x: F.struct(x["intro"].alias("intro"), F.get(t, x["j"] - 1)["end"].alias("last"), F.get(t, x["j"])["start"].alias("start"))
        return F.filter(F.transform(found, place), lambda x: x["start"].isNotNull())

    rows = texts.select("id", "text", F.explode(bound(O.tokens(F.col("text")), hits)).alias("x")).select("id", "text", "x.*")
    rows = rows.where(~F.expr("substring(text, last + 1, start - last)").rlike(openers))
    body = F.rtrim(F.get(F.split(F.expr("substring(text, start + 1)"), L.SENTENCE_END, 2), F.lit(0)))
    rows = rows.withColumn("body", body).where(F.size(O.surfaces(F.col("body"))) >= least)
    return rows.select("id", "start", (F.col("start") + F.length("body")).alias("end"), kind_of_introducer(F.col("intro")).alias("kind"), F.lit(False).alias("marked"))


def kind_from_context(before: Column, claim: Column) -> Column:
    """quran, hadith_matn or unknown: by an introducer that ends the text before a quotation, else by the claimed source."""
    intro = bound(O.tokens(before), lambda t: F.regexp_extract(marked_words(before, t), f"(?:{INTRODUCER}){L.LIGATURE}?$", 0))
    return F.when(intro != "", kind_of_introducer(intro)).when(claim["surah"].isNotNull(), "quran").when(F.size(claim["books"]) > 0, "hadith_matn").otherwise("unknown")


def is_noise(segment: Column, marked: Column) -> Column:
    """An unmarked span that only announces a quotation: it ends in a colon with few words, or has label words alone."""
    words = O.loose_tokens(segment)
    return ~marked & ((F.trim(segment).rlike("[:：]$") & (F.size(words) < 4)) | ((F.size(words) > 0) & F.forall(words, lambda w: w.isin(*L.LABELS))))


def asserted_kind(text: Column, start: Column, end: Column, window: int = 60) -> Column:
    """What the wording around a quotation asserts: quran, hadith, or '' for neither and for both.

    Before it counts the sentence, with what stands before its colon; after it, the rest of the sentence.
    """
    low = F.greatest(start - window, F.lit(0))
    before = F.regexp_extract(F.substring(text, low + 1, start - low), f"[^{L.SENTENCE[1:]}*(?::[^{L.SENTENCE[1:]}*)?$", 0)
    after = F.get(F.split(F.substring(text, end + 1, F.lit(window)), L.SENTENCE, 2), F.lit(0))
    q = before.rlike(L.ASSERTS_SCRIPTURE) | ((start > 0) & (F.substring(text, start, F.lit(1)) == "﴿"))
    h = before.rlike(L.ASSERTS_NARRATION) | after.rlike(L.ASSERTS_AFTER)
    return F.when(q & ~h, "quran").when(h & ~q, "hadith").otherwise("")


def tagged(texts: DataFrame) -> DataFrame:
    """(id, start, end, kind, marked) of text between a tag's start and its end, without edges."""
    m = texts.select("id", F.explode(places(F.col("text"), "(?s)" + L.TAGS)).alias("m"))
    head = F.length(F.regexp_extract("m.value", "^<(?:aya|hadith)_start>", 0))
    inner = tightened(F.regexp_extract("m.value", "(?s)" + L.TAGS, 2))
    start = F.col("m.start") + head + inner["lead"]
    return m.select("id", start.alias("start"), (start + F.length(inner["core"])).alias("end"), F.when(F.col("m.value").startswith("<aya"), "quran").otherwise("hadith_matn").alias("kind"), F.lit(True).alias("marked")).where("end > start")


def tag_places(text: Column) -> Column:
    """array<struct<value, start, end>> of the tags themselves, which are part of no quotation."""
    return places(text, L.TAG)


def tightened(text: Column) -> Column:
    """struct<lead, core>: a text without punctuation, quotation marks, markup and a tag at its edges, and what was cut before it."""
    edges = f"(?:[{L.EDGE}]*(?:<(?:aya|hadith)_(?:start|end)>)?[{L.EDGE}]*)"
    lead = F.regexp_extract(text, f"^{edges}", 0)
    core = F.regexp_replace(F.substring(text, F.length(lead) + 1, F.length(text)), f"{edges}$", "")
    return F.struct(F.length(lead).alias("lead"), core.alias("core"))


def merged(spans: DataFrame) -> DataFrame:
    """Overlapping spans of a text become one: an explicit quotation wins over a wider unmarked one, others unite.

    In the order of start and, at one start, of length; each span is held against the last one kept. A text's spans stream
    by in that order, so only one is held.
    """
    kinds = {f.name: f.dataType.simpleString() for f in spans.schema}
    names = ["id", "start", "end", "kind", "marked"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list | None = None
        for batch in batches:
            done = []
            for id_, start, end, kind, marked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last is None or last[0] != id_ or start >= last[2]:
                    done += [last] if last else []
                    last = [id_, start, end, kind, marked]
                elif marked and not last[4] and end <= last[2]:
                    last = [id_, start, end, kind, marked]
                elif marked or not last[4]:
                    last[2], last[3] = max(last[2], end), kind if last[3] == "unknown" else last[3]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in done], batch.schema)
        if last:
            yield pa.RecordBatch.from_pylist([dict(zip(names, last, strict=True))], batch.schema)

    rows = spans.select("id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("kind").cast("string").alias("kind"), "marked")
    ordered = rows.repartition("id").sortWithinPartitions("id", "start", F.desc("end"), "kind", "marked")
    return ordered.mapInArrow(run, f"id {kinds['id']}, start int, end int, kind string, marked boolean")


_CLAIM = "struct<raw:string,books:array<string>,surah:int,ayah:int,ayah_to:int>"


def claimed_source(part: Column, chapters: dict[str, int] | None = None) -> Column:
    """struct<raw, books, surah, ayah, ayah_to>: the first claim of a source in a piece of text, or null.

    In this order: agreed by two books, narrated by, a book's name, chapter and verse. ``chapters``: numbers by the loose
    names of chapters; a verse of an unknown chapter is no claim.
    """
    low = F.lower(part)

    def claim(raw: Column, books: Column | None = None, *numbers: Column) -> Column:
        s, a, to = numbers or (F.lit(None),) * 3
        return F.struct(raw.alias("raw"), (F.array().cast("array<string>") if books is None else books).alias("books"), s.cast("int").alias("surah"), a.cast("int").alias("ayah"), to.cast("int").alias("ayah_to")).cast(_CLAIM)

    options = [F.when(part.contains(p), claim(F.lit(p), F.array(F.lit("sahih_al-bukhari"), F.lit("sahih_muslim")))) for p in L.AGREED]
    narrated = F.regexp_extract(part, L.NARRATED_BY, 1)
    named = F.array_compact(F.array(*(F.when(F.greatest(*(F.lower(narrated).contains(a) for a in names)), F.lit(book)) for book, names in L.BOOKS.items())))
    options.append(F.when((narrated != "") & (F.size(named) > 0), claim(F.trim(F.regexp_extract(part, L.NARRATED_BY, 0)), named)))
    for book, names in L.BOOKS.items():
        for name in names:
            hit = low.rlike(f"(?<![\\wء-ي]){name.lower()}(?![\\wء-ي])")
            if book in L.AMBIGUOUS_BOOKS:
                hit = hit & low.rlike(L.BOOK_CONTEXT)
            options.append(F.when(hit, claim(F.lit(name), F.array(F.lit(book)))))
    found = F.regexp_extract(part, L.VERSE, 0)
    group = lambda k: F.regexp_extract(part, L.VERSE, k)
    number = lambda k: F.nullif(group(k), F.lit("")).try_cast("int")
    if chapters:
        table = F.create_map(*(F.lit(x) for pair in chapters.items() for x in pair))
        chapter = F.try_element_at(table, F.regexp_replace(O.joined(O.loose_tokens(group(1))), "^(?:سوره )?", ""))
        options.append(F.when((group(1) != "") & chapter.isNotNull(), claim(F.trim(found), None, chapter, number(2), number(3))))
    s, a = F.coalesce(number(4), number(7)), F.coalesce(number(5), number(8))
    options.append(F.when((group(1) == "") & s.between(1, 114) & a.between(1, 286), claim(F.trim(found), None, s, a, number(6))))
    return F.coalesce(*options)


def claimed_around(text: Column, start: Column, end: Column, chapters: dict[str, int] | None = None, window: int = 80) -> Column:
    """The claim right after a quotation, else the one before it."""
    low = F.greatest(start - window, F.lit(0))
    both = F.array(F.substring(text, end + 1, F.lit(window)), F.substring(text, low + 1, start - low))
    return bound(F.transform(both, lambda part: claimed_source(part, chapters)), lambda found: F.coalesce(F.get(found, F.lit(0)), F.get(found, F.lit(1))))


def foreign_runs(text: Column) -> Column:
    """array<struct<value, start, end>>: what stands between the first and the last token and is neither letter nor punctuation.

    Verse numbers of up to three digits in brackets are no foreign matter.
    """
    scrubbed = F.regexp_replace(text, "[﴿﴾(\\[【](\\s*)[0-9٠-٩۰-۹]{1}(\\s*)[﴾﴿)\\]】]", "   ")
    scrubbed = F.regexp_replace(scrubbed, "[﴿﴾(\\[【][0-9٠-٩۰-۹]{2}[﴾﴿)\\]】]", "    ")
    scrubbed = F.regexp_replace(scrubbed, "[﴿﴾(\\[【][0-9٠-٩۰-۹]{3}[﴾﴿)\\]】]", "     ")
    # Members of a class are tried in this order, so letters and spaces come first.
    runs = places(scrubbed, "[^" + O.LETTERS + O.PERSIAN[0] + "\\s.,،؛;:!?؟*_`>#\\-–—…\"'“”«»﴾﴿()\\[\\]{}/\\\\|~^+=<·•\\p{Mn}\\p{Me}\\p{Cf}ﷺﷻ۞۝۩ـ" + O.PRESENTATION + "]+")
    words = bound(O.tokens(text), lambda t: F.when(F.size(t) > 1, F.struct(F.get(t, F.lit(0))["end"].alias("first"), F.element_at(t, -1)["start"].alias("last"))))
    return bound(words, lambda w: F.when(w.isNotNull(), F.filter(runs, lambda r: (r["start"] >= w["first"]) & (r["end"] <= w["last"]))))


def detectors(texts: DataFrame) -> DataFrame:
    """(id, private, chain_message, refusal): flags of a text as a whole. Arabic phrases are looked for in loose words."""
    text = F.coalesce("text", F.lit(""))
    low, loose = F.lower(text), O.joined(O.loose_tokens(text))
    said = lambda phrases: F.greatest(*(low.contains(p) if p.isascii() else loose.contains(" ".join(_LOOSE(_MARKS.sub("", p)))) for p in phrases))
    return texts.select("id", F.greatest(*(text.rlike(p) for p in L.PRIVATE)).alias("private"), said(L.CHAIN_MESSAGES).alias("chain_message"), said(L.RULINGS).alias("refusal"))


_MARKS = re.compile(f"[{O.DROPPED}]")


def deduplicated(quotes: DataFrame, most: int = 30) -> DataFrame:
    """Quotes (id, start, quoted) with one verdict for equal characters: ord, repeats (later starts), truncated beyond ``most``.

    The cut is in text order, before repeats are folded.
    """
    text = Window.partitionBy("id").orderBy("start")
    rows = quotes.withColumn("k", F.row_number().over(text)).withColumn("truncated", F.count("*").over(Window.partitionBy("id")) > most).where(F.col("k") <= most)
    grouped = rows.groupBy("id", "quoted", "truncated").agg(F.min("start").alias("start"), F.array_sort(F.collect_list("start")).alias("all"))
    return grouped.select("id", F.row_number().over(text).alias("ord"), "start", "quoted", F.slice("all", 2, most).alias("repeats"), "truncated")


def relocate(text: Column, piece: Column, hint: Column) -> Column:
    """Where a piece stands verbatim in a text, nearest to the hinted place; null if nowhere. Occurrences don't overlap."""
    def nearest(gaps: Column) -> Column:
        gone = F.slice(gaps, F.lit(1), F.size(gaps) - 1)
        starts = F.zip_with(running(F.transform(gone, lambda g: F.length(g) + F.length(piece))), gone, lambda r, g: r + F.length(g))
        return F.array_min(F.transform(starts, lambda s: F.struct(F.abs(s - hint).alias("d"), s.alias("s"))))["s"]

    return F.when(F.length(piece) > 0, bound(F.split(text, F.concat(F.lit("\\Q"), piece, F.lit("\\E")), -1), nearest))
