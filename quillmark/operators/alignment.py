"""Alignment of a quotation's words with its source's, and of two words' letters, in Arrow batches.

Both levels align by matching blocks: the longest run that both sides share, the earliest of equal ones, then the same
to its left and right. Words are compared in their strict forms. A letter is a cluster: a base letter with all marks that
follow it, so that no range splits a letter from its marks. Offsets of both sides go along as code-point places.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import orthography as O

_RANGE = T.ArrayType(T.IntegerType())
_SIDES, _MARKS = ("quote_range", "source_range", "quote_chars", "source_chars"), ("quote_letters", "source_letters")
_OPS_TYPE = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), *(T.StructField(n, _RANGE) for n in _SIDES), *(T.StructField(n, T.ArrayType(_RANGE)) for n in _MARKS)]))
_LETTERS_TYPE = T.StructType([T.StructField(n, T.ArrayType(_RANGE)) for n in ("quote", "source")])

#: Type of stretches: what happened, word numbers and characters on both sides, and the letters that differ.
OPS = _OPS_TYPE.simpleString()

_PAIR, _PAIRS = pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32()))
_OPS = pa.list_(pa.struct([("op", pa.string()), *((n, _PAIR) for n in _SIDES), *((n, _PAIRS) for n in _MARKS)]))
_LETTERS = pa.struct([("quote", _PAIRS), ("source", _PAIRS)])

# Marks that stay with the letter before them; letters that share less than this are other words.
ARABIC_MARKS, LATIN_MARKS, LIKE = "ً-ٰٟۖ-ۭـ", "̀-ͯ", 0.5

_CLUSTERS = {True: re.compile(f"(?s).[{ARABIC_MARKS}]*"), False: re.compile(f"(?s).[{LATIN_MARKS}]*")}
_FOLD = str.maketrans(*O.PERSIAN) | {ord(a): b for a, b in O._FORMS.items()}
_LETTER, _DROPPED, _STRICT = re.compile(f"[{O.LETTERS}]+"), re.compile(f"[{O.DROPPED}]"), str.maketrans(*O.STRICT)


@lru_cache(1 << 14)
def _strict(cluster: str) -> str:
    """The strict letters of an Arabic cluster; empty if it has none."""
    for pair, letter in O.COMPOSED:
        cluster = cluster.replace(pair, letter)
    found = _LETTER.match(_DROPPED.sub("", cluster.translate(_FOLD)))
    return found[0].translate(_STRICT) if found else ""


def clusters(word: str, arabic: bool) -> list[tuple[str, int, int]]:
    """(letter, start, end) of the letters of a word."""
    cut = ((m[0], m.start(), m.end()) for m in _CLUSTERS[arabic].finditer(word))
    named = ((_strict(c) if arabic else c if c[0].isalnum() else "", a, b) for c, a, b in cut)
    return [x for x in named if x[0]]


def letters(quote: str, source: str, arabic: bool) -> tuple[list[list[int]], list[list[int]]]:
    """Ranges of the letters in which two words differ; none on either side if they share next to nothing."""
    q, s = clusters(quote, arabic), clusters(source, arabic)
    matcher = SequenceMatcher(None, [x[0] for x in q], [x[0] for x in s], autojunk=False)
    if not q or not s or matcher.ratio() < LIKE:
        return [], []
    ops = [x for x in matcher.get_opcodes() if x[0] != "equal"]
    return [[q[i][1], q[j - 1][2]] for _, i, j, _, _ in ops if j > i], [[s[i][1], s[j - 1][2]] for _, _, _, i, j in ops if j > i]


def _chars(spans: list[tuple[int, int]], i: int, j: int) -> list[int]:
    """Where words i to j stand; of no words the end of what stands before them, or the beginning."""
    if i < j:
        return [spans[i][0], spans[j - 1][1]]
    return [spans[i - 1][1]] * 2 if i else [spans[0][0]] * 2 if spans else [-1, -1]


def words(quote: str, q: list[dict], source: str, s: list[dict], other: list[str] | None, arabic: bool) -> list[dict]:
    """Stretches that turn a quotation's words into the source's. ``q``, ``s``: {strict, start, end} of each word, places
    below zero where the text doesn't hold it; ``other``: the source's words in another edition, one for each."""
    written, there = [t["strict"] for t in q], [t["strict"] for t in s]
    if other is not None and len(other) == len(there):
        own = set(written)
        there = [o if t not in own and o in own else t for t, o in zip(there, other, strict=True)]
    q_at, s_at = ([(t["start"], t["end"]) for t in x] for x in (q, s))
    out = []
    for op, i, j, k, m in SequenceMatcher(None, written, there, autojunk=False).get_opcodes():
        ql: list[list[int]] = []
        sl: list[list[int]] = []
        if op == "replace" and j - i == m - k == 1 and s_at[k][0] >= 0:
            (a, b), (c, d) = q_at[i], s_at[k]
            ql, sl = letters(quote[a:b], source[c:d], arabic)
            ql, sl = [[a + x, a + y] for x, y in ql], [[c + x, c + y] for x, y in sl]
        out.append({"op": op, "quote_range": [i, j], "source_range": [k, m], "quote_chars": _chars(q_at, i, j), "source_chars": _chars(s_at, k, m), "quote_letters": ql, "source_letters": sl})
    return out


def _once(make: Callable[..., object], rows: zip) -> list:
    """``make`` of each row, once for equal rows of a batch; null where a needed value is."""
    made: dict[str, object] = {}
    out = []
    for row in rows:
        key = repr(row)
        if key not in made:
            made[key] = make(*row)
        out.append(made[key])
    return out


@F.arrow_udf(_OPS_TYPE)
def _words(quote: pa.Array, q: pa.Array, source: pa.Array, s: pa.Array, other: pa.Array, arabic: pa.Array) -> pa.Array:
    def one(a, b, c, d, e, f):
        return None if a is None or b is None or c is None or d is None else words(a, b, c, d, e, f)

    return pa.array(_once(one, zip(*(x.to_pylist() for x in (quote, q, source, s, other, arabic)), strict=True)), _OPS)


@F.arrow_udf(_LETTERS_TYPE)
def _letters(quote: pa.Array, source: pa.Array, arabic: pa.Array) -> pa.Array:
    def one(a, b, c):
        return None if a is None or b is None else dict(zip(("quote", "source"), letters(a, b, c), strict=True))

    return pa.array(_once(one, zip(quote.to_pylist(), source.to_pylist(), arabic.to_pylist(), strict=True)), _LETTERS)


def word_ops(quote: Column, quote_words: Column, source: Column, source_words: Column, other: Column | None = None, arabic: bool = False) -> Column:
    """Opcodes between a text's words and its source's, with places and, in single words that were replaced, letters.

    Words: array<struct<strict,start,end>>. ``other``: the source's strict words in another edition; where the quotation has
    only that spelling of a word, it is compared. Null if a text or its words are. Arguments must be plain columns, not
    higher-order expressions: write them to a table or a checkpoint first.
    """
    return _words(quote, quote_words, source, source_words, F.lit(None).cast("array<string>") if other is None else other, F.lit(arabic))


def letter_diff(quote: Column, source: Column, arabic: bool = True) -> Column:
    """struct<quote, source> of ranges of the letters in which two words differ, with their marks; none if they share less than half."""
    return _letters(quote, source, F.lit(arabic))
