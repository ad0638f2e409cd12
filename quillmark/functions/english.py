"""English index terms: footnote marks, accents, case and apostrophes go, plurals are stripped."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .orthography import ACCENTS, shingles

# Characters written for an apostrophe.
APOSTROPHES = "'\u2019\u2018\u02bb\u02bc\u02be\u02bf`\u00b4"


def stem(word: Column) -> Column:
    """The S-stemmer: ies to y, es to e, s to nothing, each with its exceptions; words of three letters stay."""
    ies = word.endswith("ies") & ~word.rlike("[ea]ies$")
    es = word.endswith("es") & ~word.rlike("[aeo]es$")
    s = word.endswith("s") & ~word.rlike("[uis]s$")
    cut = lambda n: F.substring(word, F.lit(1), F.length(word) - n)
    return F.when(~word.endswith("s") | (F.length(word) <= 3), word).when(ies, F.concat(cut(3), F.lit("y"))).when(es | s, cut(1)).otherwise(word)


def english_tokens(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    t = F.lower(F.when(t.contains("["), F.regexp_replace(t, r"\[\d+\]", " ")).otherwise(t))
    plain = F.replace(F.replace(t, F.lit("'")), F.lit("`"))  # where each character is one byte there are no accents
    folded = F.translate(F.regexp_replace(F.replace(t, F.lit("ß"), F.lit("ss")), "[\u0300-\u036f]", ""), ACCENTS[0] + APOSTROPHES, ACCENTS[1])
    t = F.when(F.octet_length(t) == F.length(t), plain).otherwise(folded)
    return F.transform(F.array_remove(F.split(t, "[^a-z0-9]+"), ""), stem)


def bigrams(tokens: Column) -> Column:
    return shingles(tokens, 2)
