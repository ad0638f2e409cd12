"""References: records looked up by what they are called, and called by it, with links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import decisions as D
from . import evidence as V

#: What a record is called, by kind: a verse, verses of a chapter, a numbered narration, an entry.
LABELS = {"verse": "{name} ({chapter}:{verse})", "verses": "{name} ({chapter}:{verse}–{last})", "number": "{name}, no. {number}", "entry": "no. {number}"}


def reference_key(corpus: Column, book: Column, chapter: Column, verse: Column, number: Column) -> Column:
    """A text that two references share if they mean one record: chapter and verse, book and number, or an entry's number."""
    part = lambda *xs: F.concat_ws("\x00", corpus, *(x.cast("string") for x in xs))
    whole = F.when(corpus == V.SCRIPTURE, F.when(chapter.isNotNull() & verse.isNotNull(), part(chapter, verse)))
    return whole.when(corpus == V.ENCYCLOPEDIA, F.when(number.isNotNull(), part(number))).when(book.isNotNull() & number.isNotNull(), part(book, number))


def looked_up(asked: DataFrame, records: DataFrame) -> DataFrame:
    """``asked`` (corpus, book, chapter, verse, number, ..) with id: the record (id, corpus, book, chapter, verse, number) meant, or null.

    Of several records of one reference the smallest id. Rows of ``asked`` stay as they are, repeated ones too.
    """
    key = lambda: reference_key(*(F.col(c) for c in ("corpus", "book", "chapter", "verse", "number")))
    known = records.select(key().alias("__ref"), "id").where("__ref is not null").groupBy("__ref").agg(F.min("id").alias("id"))
    return asked.withColumn("__ref", key()).join(known, "__ref", "left").drop("__ref")


def labelled(rows: DataFrame, names: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """``rows`` (corpus, book, chapter, verse, last, number, ..) with label: what each is called.

    ``names``: (key, name) of books and, as text, of chapters; without one the key stands for itself. ``last``: the last verse of
    a stretch, null or the same for one verse.
    """
    told = {**LABELS, **(labels or {})}
    scripture = F.col("corpus") == V.SCRIPTURE
    keyed = rows.withColumn("__key", F.when(scripture, F.col("chapter").cast("string")).otherwise(F.col("book")))
    named = keyed.join(names.select(F.col("key").alias("__key"), F.col("name").alias("__name")).dropDuplicates(["__key"]), "__key", "left")
    values = {"name": F.coalesce("__name", "__key", F.lit("")), "chapter": F.col("chapter"), "verse": F.col("verse"), "last": F.col("last"), "number": F.col("number")}
    fill = lambda kind: D.filled(F.lit(told[kind]), {n: v for n, v in values.items() if "{" + n + "}" in told[kind]})
    label = F.when(scripture & F.col("last").isNotNull() & (F.col("last") != F.col("verse")), fill("verses")).when(scripture, fill("verse")).when(F.col("corpus") == V.ENCYCLOPEDIA, fill("entry")).otherwise(fill("number"))
    return named.withColumn("label", label).drop("__key", "__name")


def linked(rows: DataFrame, pages: dict[str, str]) -> DataFrame:
    """``rows`` (corpus, book, chapter, verse, number, link, ..) with url: the record's own link, else its corpus's page.

    ``pages``: templates by corpus with {book}, {chapter}, {verse}, {number}; a corpus without one has no page.
    """
    url = F.lit(None).cast("string")
    for corpus, template in pages.items():
        used = {n: D.percent_encoded(F.col(n).cast("string")) for n in ("book", "chapter", "verse", "number") if "{" + n + "}" in template}
        page = F.when(F.greatest(*(v.isNull() for v in used.values()), F.lit(False), F.lit(False)), F.lit(None)).otherwise(D.filled(F.lit(template), used))
        url = F.when(F.col("corpus") == corpus, page).otherwise(url)
    return rows.withColumn("url", F.coalesce(F.nullif("link", F.lit("")), url))


def search_links(text: Column, pages: dict[str, str]) -> Column:
    """array<struct<name,url>>: where a quotation can be searched for; ``pages``: templates with {q} by name."""
    return F.array(*(F.struct(F.lit(n).alias("name"), F.replace(F.lit(t), F.lit("{q}"), D.percent_encoded(F.trim(text))).alias("url")) for n, t in pages.items()))
