"""Arabic orthography in two tiers, and a Latin profile in which case and accents play the part of marks.

The loose tier folds letters that writers interchange, the strict tier keeps all letters; both drop marks. Everything
is native column work: one regular expression finds the tokens, replacements and translations make their forms.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import bound, placed

# Code points of the Arabic letters and of what is dropped between them.
LETTERS = "ء-ؿف-يٱ"
DROPPED = "ؐ-ًؚ-ٰٟۖ-ۭـ‎‏؜ﷺﷻ"

# Persian letters written for Arabic ones, loose folds, strict folds, bare folds.
PERSIAN = ("یک", "يك")
LOOSE = ("إأآٱىةؤئ", "اااايهوي")
STRICT = ("ٱ", "ا")
BARE = ("أإآٱؤئىة", "ااااوييه")

# Forms that a writer chooses; a letter with a combining hamza or madda, and its composed letter.
MARKED = "أإآؤئىة"
COMPOSED = (
    ("آ", "آ"), ("أ", "أ"), ("إ", "إ"),
    ("ؤ", "ؤ"), ("ئ", "ئ"), ("ىٔ", "ئ"),
)

# Latin letters with accents and the plain ones they fold to.
ACCENTS = ("àâäáãåçèéêëìíîïñòóôöõùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def _compatible() -> dict[str, str]:
    """Presentation forms to the letters they stand for, by rule: what the compatibility form has of Arabic letters."""
    out = {}
    for low, high in ((0xFB50, 0xFDF9), (0xFDFC, 0xFDFF), (0xFE70, 0xFEFC)):
        for point in range(low, high + 1):
            form = unicodedata.normalize("NFKC", chr(point))
            letters = "".join(c for c in form if "ء" <= c <= "ؿ" or "ف" <= c <= "ي" or c == "ٱ")
            if letters:
                out[chr(point)] = letters
    return out


def ranges_of(letters: str) -> str:
    """Characters as the ranges of a pattern's class. The regular expressions try a class's members one after another for
    each character that is none of them, so a list of hundreds costs hundreds of times what a few ranges do."""
    out: list[list[int]] = []
    for point in sorted(map(ord, letters)):
        if out and out[-1][1] == point - 1:
            out[-1][1] = point
        else:
            out.append([point, point])
    return "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in out)


_FORMS = _compatible()
PRESENTATION = ranges_of("".join(_FORMS))
_PRESENTED = f"(?=[ﭐ-ﻼ])[{PRESENTATION}]"  # other letters fail at one range
_LETTER = f"[{LETTERS}{PERSIAN[0]}]|{_PRESENTED}"
_TOKEN_LETTER = "(?:ا[ٓ-ٕ]|[ويى]ٔ|" + _LETTER + ")"
ARABIC_TOKEN = f"(?=[ء-ﻼ]){_TOKEN_LETTER}(?:[{DROPPED}]*{_TOKEN_LETTER})*"  # most other letters fail at the first range
LATIN_TOKEN = r"[\p{L}\p{N}]+"


def plain_letters(text: Column) -> Column:
    """Presentation forms and Persian letters become Arabic ones, one character or more for each."""
    forms = F.str_to_map(F.lit(",".join(f"{a}:{b}" for a, b in _FORMS.items())), F.lit(","), F.lit(":"))  # one literal once folded
    spelt = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.element_at(forms, c), c)), "")
    return F.translate(F.when(text.rlike(_PRESENTED), spelt).otherwise(text), *PERSIAN)


def _letters(surface: Column) -> Column:
    for pair, letter in COMPOSED:
        surface = F.replace(surface, F.lit(pair), F.lit(letter))
    return F.regexp_replace(plain_letters(surface), f"(?![ء-غف-ي ])[{DROPPED}]", "")


def strict_form(surface: Column) -> Column:
    return F.translate(_letters(surface), *STRICT)


def loose_form(surface: Column) -> Column:
    return F.translate(_letters(surface), *LOOSE)


def bare_form(token: Column) -> Column:
    """Letters without what a writer may leave out: hamza seats, final ya, final ta."""
    return F.translate(token, *BARE)


def latin_loose(surface: Column) -> Column:
    low = F.lower(surface)  # all there is to do where each character is one byte
    return F.when(F.octet_length(surface) == F.length(surface), low).otherwise(F.translate(F.replace(low, F.lit("ß"), F.lit("ss")), *ACCENTS))


def surfaces(text: Column, pattern: str = ARABIC_TOKEN) -> Column:
    """The tokens of a text as they are written; null and empty texts have none."""
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def tokens(text: Column, arabic: bool = True) -> Column:
    """array<struct<loose, strict, start, end>> with half-open code-point spans; interior marks stay inside a span."""
    pattern = ARABIC_TOKEN if arabic else LATIN_TOKEN
    loose = lambda found: _folded(found, loose_form if arabic else latin_loose)
    strict = (lambda found: _folded(found, strict_form)) if arabic else (lambda found: found)
    return placed(text, pattern, lambda w, a, b, x, y: F.struct(x.alias("loose"), y.alias("strict"), a.alias("start"), b.alias("end")), loose, strict)


def _folded(found: Column, form: Callable[[Column], Column]) -> Column:
    """The forms of tokens, made in one go: no token has a space, no form looks beyond one, and none is empty."""
    return words(form(joined(found)))


def loose_tokens(text: Column, arabic: bool = True) -> Column:
    """The loose forms of a text's tokens."""
    return _folded(surfaces(text), loose_form) if arabic else words(latin_loose(joined(surfaces(text, LATIN_TOKEN))))


def strict_tokens(text: Column, arabic: bool = True) -> Column:
    return _folded(surfaces(text), strict_form) if arabic else surfaces(text, LATIN_TOKEN)


def joined(tokens_: Column) -> Column:
    return F.array_join(tokens_, " ")


def words(line: Column) -> Column:
    """The tokens that ``joined`` made one string of; no token has a space and none is empty."""
    return F.array_remove(F.split(line, " ", -1), "")


def grams(token: Column, n: int = 3) -> Column:
    """Character n-grams of a token between boundary marks; a shorter one is its own gram."""
    padded = F.concat(F.lit("#"), token, F.lit("#"))
    return F.when(F.length(padded) < n, F.array(padded)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - (n - 1), F.lit(1))), lambda i: F.substring(padded, i, F.lit(n))))


def shingles(tokens_: Column, n: int) -> Column:
    """Runs of n neighbouring tokens, joined by a space; none if there are fewer."""
    some = F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens_) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(tokens_, i, n), " "))
    return F.when(F.size(tokens_) >= n, some).otherwise(F.array().cast("array<string>"))


def classify(user: Column, corpus: Column) -> Column:
    """equal; completion: the writer left marks out; swap: the writer chose another marked form; other: another word."""
    chosen = F.exists(F.arrays_zip(F.split(user, "").alias("u"), F.split(corpus, "").alias("c")), lambda x: (x["u"] != x["c"]) & F.lit(MARKED).contains(x["u"]) & (F.length(x["u"]) > 0))
    return F.when(user == corpus, "equal").when(bare_form(user) != bare_form(corpus), "other").when(chosen, "swap").otherwise("completion")


def letter_distance(user: Column, corpus: Column) -> Column:
    """Places in which two tokens differ, and the difference of their lengths."""
    pairs = F.zip_with(F.split(user, ""), F.split(corpus, ""), lambda u, c: F.when(u.isNull() | c.isNull() | (u != c), 1).otherwise(0))
    return F.aggregate(pairs, F.lit(0), lambda a, x: a + x)


def choose_spelling(user: Column, first: Column, second: Column) -> Column:
    """struct<spelling, class> of the spelling nearest to what was written: by class, letters, then the first one."""

    def rank(kind: Column) -> Column:
        return F.when(kind == "equal", 0).when(kind == "completion", 1).when(kind == "swap", 2).otherwise(3)

    def option(spelling: Column, order: int) -> Column:
        kind = classify(user, spelling)
        return F.struct(rank(kind).alias("r"), letter_distance(user, spelling).alias("d"), F.lit(order).alias("o"), spelling.alias("spelling"), kind.alias("class"))

    best = F.least(option(first, 0), option(second, 1))
    return F.struct(best["spelling"].alias("spelling"), best["class"].alias("class"))


def language(text: Column) -> Column:
    """ar, en or other: Arabic token characters against Latin letters."""
    ar = F.length(F.array_join(surfaces(text), ""))
    latin = F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[A-Za-z]"))
    arabic = (ar >= 2 * F.greatest(latin, F.lit(1))) | ((ar > 0) & (latin == 0))
    return F.when(arabic, "ar").when((latin > ar) & text.rlike("[A-Za-z]{3,}"), "en").otherwise("other")


# Vowel signs, doubling, silence, and signs of other editions that stand for them.
VOWELS = "ًٌٍَُِ"
SHADDA, SUKUN, SILENT, OPEN_TANWEEN = "ّ", "ْ", "ۡ۟۠", ("ࣰࣱࣲ", "ًٌٍ")
CARRIERS = ("ٱىیک", "اييك")
_BASE = "[ء-يٱیک]"
_LETTER_WITH_MARKS = _BASE + "[^ء-يٱیک\\s]*"


def vocalised(text: Column) -> Column:
    """Whether any vowel sign, doubling or silence is written."""
    return text.rlike(f"[{VOWELS}{SHADDA}{SUKUN}]")


def skeleton(word: Column) -> Column:
    """array<struct<letter, vowel, shadda, start, end>> of base letters; vowel: a sign, empty for silence, or null."""

    def letter(p: Column, a: Column, b: Column) -> Column:
        marks = F.translate(F.substring(p, 2, 99), *OPEN_TANWEEN)
        signs = F.regexp_extract_all(marks, F.lit(f"[{VOWELS}]"), F.lit(0))
        vowel = F.when(F.size(signs) > 0, F.element_at(signs, -1)).when(marks.rlike(f"[{SUKUN}{SILENT}]"), "")
        return F.struct(F.substring(p, 1, 1).alias("letter"), vowel.alias("vowel"), marks.contains(SHADDA).alias("shadda"), a.alias("start"), b.alias("end"))

    return placed(word, _LETTER_WITH_MARKS, letter)


def compare_vowels(user: Column, reference: Column, final: Column) -> Column:
    """array<struct<kind, u_start, u_end, r_start, r_end, i>> of conflict, missing and waqf; null where letters don't align.

    ``i``: the letter's number in either word, from 0.

    A letter without signs is missing what the reference has. Doubling alone is compared as doubling. At the end of a
    quotation silence may stand for a vowel (waqf). Otherwise another vowel, a vowel where there is none, or doubling
    where there is none is a conflict, and doubling left out is missing.
    """
    return bound(F.struct(skeleton(user).alias("u"), skeleton(reference).alias("r")), lambda both: _compared(both["u"], both["r"], final))


def _compared(u: Column, r: Column, final: Column) -> Column:
    """``compare_vowels`` of two skeletons."""
    letters = lambda s: F.transform(s, lambda m: F.translate(m["letter"], *CARRIERS))
    aligned = (F.size(u) > 0) & (F.size(u) == F.size(r)) & (letters(u) == letters(r))
    pairs = F.arrays_zip(u.alias("a"), r.alias("b"), F.sequence(F.lit(1), F.greatest(F.size(u), F.lit(1))).alias("i"))

    def judge(x: Column) -> Column:
        a, b = x["a"], x["b"]
        av, bv = a["vowel"], b["vowel"]
        sounded = bv.isNotNull() & (bv != "")
        conflict = (av.isNotNull() & bv.isNotNull() & (av != bv)) | (av.isNotNull() & bv.isNull() & (av != "")) | (a["shadda"] & ~b["shadda"])
        kind = (
            F.when(av.isNull() & ~a["shadda"], F.when(sounded | b["shadda"], "missing"))
            .when(av.isNull(), F.when(~b["shadda"], "conflict").when(sounded, "missing"))
            .when((av == "") & final & (x["i"] == F.size(u)) & sounded, "waqf")
            .when(conflict, "conflict").when(~a["shadda"] & b["shadda"], "missing")
        )
        return F.struct(kind.alias("kind"), a["start"].alias("u_start"), a["end"].alias("u_end"), b["start"].alias("r_start"), b["end"].alias("r_end"), (x["i"] - 1).alias("i"))

    return F.when(aligned, F.filter(F.transform(pairs, judge), lambda d: d["kind"].isNotNull()))


def vowel_conflicts(user: Column, reference: Column) -> Column:
    """The conflicts alone, every letter judged as one that other words follow; none where letters don't align."""
    found = compare_vowels(user, reference, F.lit(False))
    return F.coalesce(F.filter(found, lambda d: d["kind"] == "conflict"), F.array().cast("array<struct<kind:string,u_start:int,u_end:int,r_start:int,r_end:int,i:int>>"))
