"""Array operators that Spark lacks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements whose sums are appended one by one; such chunks carry on from chunk to chunk.
CHUNK = 64


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once for each row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(sizes: Column) -> Column:
    """array<int>: before each element the sum of all before it. In chunks, so that long arrays don't cost their square."""

    def sums(values: Column) -> Column:  # one more than there are values; the last is the sum of all
        return F.aggregate(values, F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))

    def carried(chunks: Column) -> Column:  # of each chunk its sums
        return bound(sums(F.transform(chunks, lambda c: F.element_at(c, -1))), lambda before: F.flatten(F.transform(chunks, lambda c, k: bound(F.get(before, k), lambda start: F.transform(F.slice(c, F.lit(1), F.size(c) - 1), lambda x: x + start)))))

    def chunked(all_: Column) -> Column:
        cuts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(all_) / CHUNK).cast("int") - 1, F.lit(0)))
        some = F.when(F.size(all_) > CHUNK, bound(F.transform(cuts, lambda k: sums(F.slice(all_, k * CHUNK + 1, F.lit(CHUNK)))), carried))
        return some.when(F.size(all_) > 0, bound(sums(all_), lambda c: F.slice(c, F.lit(1), F.size(c) - 1))).otherwise(F.array().cast("array<int>"))

    return bound(sizes, chunked)


def placed(text: Column, pattern: str, make: Callable[..., Column], *forms: Callable[[Column], Column]) -> Column:
    """Of each match of a pattern in a text ``make(match, start, end, *formed)``, with half-open code-point places.

    ``forms``: each makes, of the array of all matches, one of as many elements.
    """

    def made(x: Column) -> Column:
        found, gaps = x["m"], F.slice(x["g"], F.lit(1), F.size(x["m"]))
        sizes = F.zip_with(gaps, found, lambda g, m: F.length(g) + F.length(m))
        formed = [form(found).alias(f"f{k}") for k, form in enumerate(forms)]
        start = lambda y: y["b"] + F.length(y["g"])
        one = lambda y: make(y["m"], start(y), start(y) + F.length(y["m"]), *(y[f"f{k}"] for k in range(len(forms))))
        return F.transform(F.arrays_zip(found.alias("m"), gaps.alias("g"), running(sizes).alias("b"), *formed), one)

    return bound(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g")), made)
