"""Anchors: stretches of a text that nothing marks and that stand verbatim in the corpus.

A seed is a run of words with few places in the corpus, not made of stop words alone. From left to right, each seed grows as
long as one of its places goes on to agree, then backwards in the same way; what it covered is passed over. As the places
of a grown seed are those of the longest agreement, everything follows from the maximal runs that texts and corpus share:
those are found on diagonals by gram joins, counted for each stretch of a text, and one pass over a text's own few
stretches picks the anchors. Grams with very many places are never joined: the few runs that reach one are extended word by
word in place.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import matching as M
from .index import bounded


@dataclass(frozen=True)
class Rule:
    """``size``: words of a seed, ``short``: of one at a text's very end; ``most``: places beyond which a seed is none.

    A stretch is an anchor if it has ``need`` words (``need_scripture`` in scripture) and ``content`` of them tell something,
    if it is a whole verse, or if it has ``rare`` words or more, one telling, at most ``places`` places, and is no list of
    narrators (half its words or more are ``chain`` words, or ``link`` stands in it twice). ``stop``: words that make no
    seed; those and ``formal`` ones tell nothing.
    """

    size: int = 4
    short: int = 3
    most: int = 4000
    need: int = 6
    need_scripture: int = 4
    content: int = 3
    rare: int = 3
    places: int = 60
    stop: tuple[str, ...] = ()
    formal: tuple[str, ...] = ()
    chain: tuple[str, ...] = ()
    link: str = ""


def _united(runs: DataFrame) -> DataFrame:
    """(text, id, d, lo, hi, seeds): stretches on a diagonal that overlap or touch as one, with the seeds of all."""
    order = Window.partitionBy("text", "id", "d").orderBy("lo", "hi")
    fresh = F.coalesce(F.col("lo") > F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    parts = runs.withColumn("part", F.sum(fresh.cast("int")).over(order))
    return parts.groupBy("text", "id", "d", "part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.flatten(F.collect_list("seeds")).alias("seeds")).drop("part")


def shared_runs(texts: DataFrame, stream: DataFrame, rule: Rule) -> DataFrame:
    """Maximal runs (text, id, d, lo, hi, seeds) of words that texts and stream share and that hold a seed's gram.

    ``texts``, ``stream``: (id, loose). ``d``: the place in the text less that in the stream; ``seeds``: where in the text the
    run's telling seeds begin. A seed's words are those of the stream, so only the stream's are looked at.
    """
    def grams(rows: DataFrame, size: int) -> DataFrame:
        silent = F.forall(F.array(*(F.col("g")[f"w{k}"] for k in range(size))), lambda w: w.isin(*rule.stop)) if rule.stop else F.lit(False)
        return M.grams(rows, size, "j", "id").select("id", "j", "x", "y", (~silent).alias("tells"))

    asked = M.grams(texts.select(F.col("id").alias("text"), "loose"), rule.size, "i", "text").select("text", "i", "x", "y")
    corpus = grams(stream.select("id", "loose"), rule.size)
    common = corpus.groupBy("x", "y").agg(F.count("*").alias("n")).where(F.col("n") > rule.most).select("x", "y")
    crowded = not common.isEmpty()
    rare = corpus.join(common, ["x", "y"], "left_anti") if crowded else corpus
    met = asked.join(bounded(rare), ["x", "y"]).select("text", "id", "i", (F.col("i") - F.col("j")).alias("d"), F.lit(rule.size).alias("n"), "tells")
    # The last words of a text may be a shorter seed.
    tails = texts.where(F.size("loose") >= rule.short).select(F.col("id").alias("text"), (F.size("loose") - rule.short).alias("at"), F.slice("loose", -rule.short, rule.short).alias("loose"))
    ends = M.grams(tails, rule.short, "i", "text", "at").select("text", "at", "x", "y")
    short = grams(stream.select("id", "loose"), rule.short)
    many = short.groupBy("x", "y").agg(F.count("*").alias("n")).where(F.col("n") > rule.most).select("x", "y")
    last = ends.join(bounded(short.join(many, ["x", "y"], "left_anti")), ["x", "y"]).select("text", "id", F.col("at").alias("i"), (F.col("at") - F.col("j")).alias("d"), F.lit(rule.short).alias("n"), "tells")
    found = met.unionByName(last)
    seeds = F.when(F.col("tells"), F.array("i")).otherwise(F.array().cast("array<int>"))
    runs = _united(found.select("text", "id", "d", F.col("i").alias("lo"), (F.col("i") + F.col("n")).alias("hi"), seeds.alias("seeds")))
    return _extended(runs, texts, stream, asked.join(common, ["x", "y"], "left_semi").select("text", "i").distinct(), rule.size) if crowded else runs


def _extended(runs: DataFrame, texts: DataFrame, stream: DataFrame, common: DataFrame, size: int) -> DataFrame:
    """``runs`` over the frequent grams (text, i) beside them, as far as the words agree."""
    right, left = common.withColumn("hi", F.col("i") + (size - 1)).select("text", "hi", F.lit(True).alias("r")), common.withColumn("lo", F.col("i") + 1).select("text", "lo", F.lit(True).alias("l"))
    flagged = runs.join(right, ["text", "hi"], "left").join(left, ["text", "lo"], "left")
    open_ = flagged.where("r or l").join(texts.select(F.col("id").alias("text"), F.col("loose").alias("t")), "text").join(stream.select("id", F.col("loose").alias("s")), "id")

    def agreeing(a: Column, b: Column) -> Column:
        first = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
        return F.when(first > 0, first - 1).otherwise(F.size(a)).cast("int")

    rest = lambda c, at: F.slice(c, at + 1, F.size(c))
    ahead = lambda c, n: F.reverse(F.slice(c, F.lit(1), n))
    lo, hi = F.col("lo"), F.col("hi")
    grown = open_.select("text", "id", "d", (lo - F.when(F.col("l"), agreeing(ahead("t", lo), ahead("s", lo - F.col("d")))).otherwise(0)).alias("lo"), (hi + F.when(F.col("r"), agreeing(rest("t", hi), rest("s", hi - F.col("d")))).otherwise(0)).alias("hi"), "seeds")
    return _united(flagged.where("r is null and l is null").select("text", "id", "d", "lo", "hi", "seeds").unionByName(grown))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _picked(seeds: pa.Array, low: pa.Array, high: pa.Array) -> pa.Array:
    """Numbers of the stretches that become anchors. ``seeds``: places in order; ``low``, ``high``: stretches in the order of ``low``."""
    out = []
    for s, a, b in zip(seeds, low, high, strict=True):
        at, lo, hi = (np.asarray(x.values) for x in (s, a, b))
        reach, first = np.maximum.accumulate(hi), {}
        for k, end in enumerate(hi.tolist()):
            first.setdefault(end, k)  # the longest of those with this end
        chosen, after = [], 0
        while (k := int(np.searchsorted(at, after))) < len(at):
            n = int(np.searchsorted(lo, at[k], "right"))
            after = int(reach[n - 1])
            chosen.append(first[after])
        out.append(chosen)
    return pa.array(out, pa.list_(pa.int32()))


def detected(texts: DataFrame, stream: DataFrame, parts: DataFrame, rule: Rule) -> DataFrame:
    """(text, i, n, id, corpus, n_places, n_content, why) of the anchors of ``texts`` (id, loose).

    ``stream``: (id, loose); ``parts``: (id, corpus, scripture, first, after), the records in each stream. ``id``: the stream of
    the first place, scripture first. Why: long, whole (a whole verse) or rare. Texts shorter than a seed have none.
    """
    runs = shared_runs(texts, stream, rule)
    of = parts.groupBy("id").agg(F.first("corpus").alias("corpus"), F.bool_or("scripture").alias("scripture"))
    verses = parts.where("scripture").select("id", F.col("first").alias("j"), (F.col("after") - F.col("first")).alias("n"), F.lit(True).alias("verse"))
    placed = runs.withColumns({"j": F.col("lo") - F.col("d"), "n": F.col("hi") - F.col("lo")}).join(verses, ["id", "j", "n"], "left").join(of, "id")
    # All places of a stretch agree with the text from end to end, and so hold the same seeds.
    stretches = placed.groupBy("text", "lo", "hi").agg(F.count("*").alias("n_places"), F.min(F.struct((~F.col("scripture")).alias("other"), "id", "j", "corpus")).alias("p"), F.coalesce(F.bool_or("verse"), F.lit(False)).alias("whole"), F.first("seeds").alias("seeds"))
    listed = stretches.groupBy("text").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "n_places", "p", "whole"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("seeds")))).alias("seeds")).where(F.size("seeds") > 0)
    listed = listed.select("text", "s", "seeds", F.col("s.lo").alias("low"), F.col("s.hi").alias("high"))
    chosen = listed.withColumn("k", F.explode(_picked("seeds", "low", "high"))).select("text", F.get("s", F.col("k")).alias("x")).withColumn("id", F.col("x.p.id"))
    # A stretch's words are read at its place in the stream: the texts are needed no more.
    words = F.slice("loose", F.col("x.p.j") + 1, F.col("x.hi") - F.col("x.lo")).alias("w")
    rows = chosen.join(stream.select("id", "loose"), "id").select("text", F.col("x.lo").alias("i"), (F.col("x.hi") - F.col("x.lo")).alias("n"), "id", "x.p.corpus", (~F.col("x.p.other")).alias("scripture"), "x.n_places", "x.whole", words)
    telling = F.size(F.filter("w", lambda x: ~x.isin(*rule.stop, *rule.formal))) if rule.stop or rule.formal else F.col("n")
    chained = (F.size(F.filter("w", lambda x: x.isin(*rule.chain))) * 2 >= F.col("n")) if rule.chain else F.lit(False)
    chained = chained | (F.size(F.filter("w", lambda x: x == rule.link)) >= 2) if rule.link else chained
    why = (
        F.when((F.col("n") >= F.when(F.col("scripture"), rule.need_scripture).otherwise(rule.need)) & (F.col("n_content") >= rule.content), "long")
        .when(F.col("whole"), "whole").when((F.col("n") >= rule.rare) & (F.col("n_content") >= 1) & (F.col("n_places") <= rule.places) & ~chained, "rare")
    )
    return rows.withColumn("n_content", telling).withColumn("why", why).where("why is not null").select("text", "i", "n", "id", "corpus", "n_places", "n_content", "why")


def spans(anchors: DataFrame, texts: DataFrame, letters: str) -> DataFrame:
    """(id, start, end, corpus): anchors as characters of ``texts`` (id, text, places array<struct<start,end>>), those of one
    corpus joined where at most three characters without a letter (of the class ``letters``) part them."""
    rows = anchors.join(texts.select(F.col("id").alias("text"), F.col("text").alias("written"), "places"), "text")
    cut = rows.select("text", F.col("corpus").alias("id"), "written", F.get("places", F.col("i"))["start"].alias("start"), F.get("places", F.col("i") + F.col("n") - 1)["end"].alias("end"))
    before = F.lag("end").over(Window.partitionBy("text", "id").orderBy("start", "end"))
    gap = F.substring(F.col("written"), before + 1, F.greatest(F.col("start") - before, F.lit(0)))
    blank = cut.withColumn("blank", F.coalesce(~gap.rlike(letters), F.lit(False))).drop("written")
    return M.widened(blank).select(F.col("text").alias("id"), "start", "end", F.col("id").alias("corpus"))
