"""Differences between a quotation and its source, for display: of words, of vowels, foreign matter; and receipts."""

from __future__ import annotations

import base64
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

def diff_kinds(ops: Column) -> Column:
    """The kinds of difference that opcodes have, sorted."""
    named = F.transform(ops, lambda o: F.when(o["op"] == "replace", "word_replaced").when(o["op"] == "insert", "word_missing_in_quote").when(o["op"] == "delete", "word_added_in_quote"))
    return F.array_sort(F.array_distinct(F.array_compact(named)))


def vowel_ops(words: Column, window: Column, found: Column) -> Column:
    """A stretch for each word, replaced where its vowels contradict the source, with the letters that carry other marks.

    ``words``: array<struct<start,end>> of the quotation, ``window``: of the source, ``found``: differences by word number.
    """

    def one(w: Column, k: Column) -> Column:
        mine = F.filter(found, lambda d: d["k"] == k)
        return _stretch(F.when(F.exists(mine, lambda d: d["kind"] == "conflict"), "replace").otherwise("equal"), k, k + 1, w, F.get(window, k), F.transform(mine, lambda d: d["quote_chars"]), F.transform(mine, lambda d: d["source_chars"]))

    return F.transform(words, one)


def foreign_ops(words: Column, window: Column, runs: Column) -> Column:
    """A stretch for each word, and one that is to be deleted for each foreign run (start, end), in their order in the text."""
    none = F.array().cast("array<array<int>>")
    equal = F.transform(words, lambda w, k: _stretch(F.lit("equal"), k, k + 1, w, F.get(window, k), none, none))
    nowhere = F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"))
    extra = F.transform(runs, lambda r: _stretch(F.lit("delete"), F.lit(-1), F.lit(-1), r, nowhere, none, none))
    keyed = F.transform(F.concat(equal, extra), lambda o: F.struct(F.get(o["quote_chars"], F.lit(0)).alias("at"), (F.get(o["quote_range"], F.lit(0)) < 0).alias("late"), o.alias("o")))
    return F.transform(F.array_sort(keyed), lambda x: x["o"])


def _stretch(op: Column, first: Column, after: Column, word: Column, source: Column, quote_letters: Column, source_letters: Column) -> Column:
    chars = lambda w: F.array(F.coalesce(w["start"], F.lit(-1)).cast("int"), F.coalesce(w["end"], F.lit(-1)).cast("int"))
    both = F.array(first.cast("int"), after.cast("int"))
    return F.struct(op.alias("op"), both.alias("quote_range"), both.alias("source_range"), chars(word).alias("quote_chars"), chars(source).alias("source_chars"), quote_letters.alias("quote_letters"), source_letters.alias("source_letters"))


def vowel_kinds(found: Column) -> Column:
    """The kinds of vowel differences as they are told, sorted."""
    return F.array_sort(F.array_distinct(F.transform(found, lambda d: F.when(d["kind"] == "conflict", "diacritic_conflict").when(d["kind"] == "missing", "diacritic_missing").otherwise("waqf"))))


@F.pandas_udf(T.StringType())
def receipt_token(payload: pd.Series) -> pd.Series:
    """A URL-safe token of a compressed text."""
    return payload.map(lambda p: None if p is None else base64.urlsafe_b64encode(zlib.compress(p.encode(), 9)).decode())


@F.pandas_udf(T.StringType())
def receipt_payload(token: pd.Series) -> pd.Series:
    """The text of a token, up to a million bytes; null if it isn't one."""

    def read(t: str | None) -> str | None:
        try:
            return None if t is None else zlib.decompressobj().decompress(base64.urlsafe_b64decode(t), 1_000_000).decode()
        except (ValueError, zlib.error):
            return None

    return token.map(read)
