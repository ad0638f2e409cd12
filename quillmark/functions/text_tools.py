"""Smaller scalar operators: edges of spans, lengths, lexicon scans, names, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import orthography as O

# Suffixes with which a stem of the forbidden lexicon is still that stem.
SUFFIXES = ("", "ه", "ها", "هم", "ات", "ون")


def word_end(text: Column, end: Column) -> Column:
    """A span's end past what follows without a space and is no letter: punctuation that belongs to its last word."""
    tail = F.regexp_extract(F.substring(text, end + 1, F.length(text)), "^[^\\s\\u0621-\\u064a]*", 0)
    return end + F.length(tail)


def without_long_vowels(word: Column) -> Column:
    """A word's skeleton without the letters that write long vowels."""
    return F.translate(word, "اوي", "")


def utf16_length(text: Column) -> Column:
    return (F.length(F.encode(text, "UTF-16LE")) / 2).cast("int")


def html_escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def forbidden(text: Column, stems: list[str], phrases: list[str], english: list[str], masked: list[str]) -> Column:
    """The forbidden words of a text: loose tokens (without the article) that are a stem with a suffix, phrases, English words.

    Names of books in ``masked`` are taken out first, for they may hold such a word.
    """
    t = text
    for name in masked:
        t = F.replace(t, F.lit(name), F.lit(" "))
    tokens = O.loose_tokens(t)
    bare = F.transform(tokens, lambda w: F.when((F.length(w) > 4) & w.startswith("ال"), F.substring(w, 3, 99)).otherwise(w))
    forms = [s + x for s in stems for x in SUFFIXES]
    hits = F.filter(bare, lambda w: w.isin(*forms)) if forms else F.array().cast("array<string>")
    joined = F.concat(F.lit(" "), O.joined(tokens), F.lit(" "))
    said = F.array_compact(F.array(*(F.when(joined.contains(f" {p} "), F.lit(p)) for p in phrases))) if phrases else F.array().cast("array<string>")
    words = F.regexp_extract_all(F.lower(t), F.lit(r"\b(" + "|".join(english) + r")\b"), F.lit(1)) if english else F.array().cast("array<string>")
    return F.array_distinct(F.concat(hits, said, words))


def looked_up(rows: DataFrame, name_col: str, names: DataFrame) -> DataFrame:
    """Adds number: that of the name (name, number) which is the same in loose letters, with or without its article."""
    key = lambda c: F.regexp_replace(O.joined(O.loose_tokens(c)), "^ال", "")
    latin = lambda c: F.regexp_replace(F.lower(c), "[^a-z]", "")
    full = lambda c: F.concat_ws("|", key(c), latin(c))
    table = names.select(full(F.col("name")).alias("__key"), "number").dropDuplicates(["__key"])
    return rows.withColumn("__key", full(F.col(name_col))).join(table, "__key", "left").drop("__key")


def chunked(text: Column, most: int = 5000) -> Column:
    """array<struct<start, part>>: a long text in parts of at most ``most`` characters, cut after line ends where there are any."""
    lines = F.filter(F.split(text, "(?<=\\n)", -1), lambda x: x != "")
    kind = "array<struct<start:int,part:string>>"
    pieces = F.flatten(F.transform(lines, lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(x) / most).cast("int") - 1, F.lit(0))), lambda k: F.substring(x, k * most + 1, F.lit(most)))))

    def step(out: Column, x: Column) -> Column:
        last = F.element_at(out, -1)
        fits = F.length(last["part"]) + F.length(x) <= most
        grown = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(last["start"].alias("start"), F.concat(last["part"], x).alias("part"))))
        new = F.concat(out, F.array(F.struct((last["start"] + F.length(last["part"])).alias("start"), x.alias("part"))))
        return F.when(F.size(out) == 0, F.array(F.struct(F.lit(0).alias("start"), x.alias("part"))).cast(kind)).when(fits, grown).otherwise(new)

    return F.aggregate(pieces, F.array().cast(kind), step)
