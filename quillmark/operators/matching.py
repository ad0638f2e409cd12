"""Finding token runs of one text inside others: phrases, seeds and runs, windows of small edit distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import orthography as O
from .index import bounded, texts_of, tokens_of


def phrase_hits(quotes: DataFrame, stream: DataFrame) -> DataFrame:
    """(q, id, start, strict_ok) of each place where a quote's loose tokens stand in a stream.

    ``quotes``: (q, loose, strict); ``stream``: (id, loose, strict). Quotes meet the postings on their rarest token
    alone; the rest is compared in place. A quote with a token that occurs nowhere is gone before the join.
    """
    asked = quotes.select("q", F.posexplode("loose").alias("k", "token"))
    places = stream.select("id", F.posexplode("loose").alias("pos", "token")).join(bounded(asked.select("token").distinct()), "token")
    frequency = places.groupBy("token").agg(F.count("*").alias("df"))
    known = asked.join(frequency, "token", "left")
    pivot = known.groupBy("q").agg(F.min(F.struct("df", "k", "token")).alias("p"), F.bool_or(F.col("df").isNull()).alias("unknown")).where("not unknown")
    wanted = quotes.join(pivot.select("q", "p.k", "p.token"), "q").select("q", F.col("loose").alias("ql"), F.col("strict").alias("qs"), "k", "token")
    found = wanted.join(places, "token").withColumn("start", F.col("pos") - F.col("k")).where("start >= 0")
    window = lambda c: F.slice(F.col(c), F.col("start") + 1, F.size("ql"))
    hits = tokens_of(found.join(texts_of(stream), "id"))
    return hits.where(window("loose") == F.col("ql")).select("q", "id", "start", (window("strict") == F.col("qs")).alias("strict_ok"))


def dedupe_hits(hits: DataFrame) -> DataFrame:
    """Hits (q, id, variant, start, strict_ok) of two editions to one for each place.

    Places in the first edition are preferred; a strict hit anywhere in the record makes all of its places strict.
    Without a place in the first edition the first of the second stands for it, with start -1. ``ord`` counts a quote's
    hits: strict ones first, then by record and place.
    """
    record = Window.partitionBy("q", "id")
    rows = hits.withColumn("any", F.bool_or("strict_ok").over(record)).withColumn("first", F.min("variant").over(record))
    rows = rows.where("variant = first").withColumn("n", F.row_number().over(Window.partitionBy("q", "id", F.when(F.col("variant") == 0, F.col("start"))).orderBy("start")))
    rows = rows.where("n = 1").select("q", "id", "variant", F.when(F.col("variant") == 0, F.col("start")).otherwise(-1).alias("start"), F.col("any").alias("strict_ok"))
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("strict_ok"), "id", "start")))


def mixed_hits(windows: DataFrame) -> DataFrame:
    """Windows whose every token is one of two spellings, but which are not wholly in either.

    ``windows``: loose, strict (of the quote) and loose_a, loose_b, strict_a, strict_b of the record; adds strict_ok.
    """
    either = lambda q, a, b: F.forall(F.arrays_zip(F.col(q).alias("q"), F.col(a).alias("a"), F.col(b).alias("b")), lambda x: (x["q"] == x["a"]) | (x["q"] == x["b"]))
    pure = (F.col("loose") == F.col("loose_a")) | (F.col("loose") == F.col("loose_b"))
    same = (F.size("loose") == F.size("loose_a")) & (F.size("loose") == F.size("loose_b")) & (F.size("loose") > 0)
    return windows.where(same & ~pure & either("loose", "loose_a", "loose_b")).withColumn("strict_ok", either("strict", "strict_a", "strict_b"))


def seeds(texts: DataFrame, stream: DataFrame, size: int = 4, most: int | None = 4000) -> DataFrame:
    """(text, id, i, j, strict_ok): a text's runs of ``size`` tokens and their places in the corpus; strict where the strict forms agree,
    null where either side comes without them.

    Runs that occur at more than ``most`` places are no evidence and start nothing (``rare`` is false); they count only on
    the diagonals where a rarer one stands, so that a quotation isn't broken at a frequent phrase; without ``most`` all runs are
    seeds alike. Runs meet by 128 bits of hashes, so that no string is made for a place.
    """
    told = "strict" in texts.columns and "strict" in stream.columns

    def hashed(df: DataFrame, name: str, pos: str, z: str) -> DataFrame:
        strict = F.xxhash64(*(F.col("g")[f"s{k}"] for k in range(size))) if told else F.lit(None).cast("long")
        return grams(df.select(F.col("id").alias(name), "loose", *["strict"] * told), size, pos, name).select(name, pos, "x", "y", strict.alias(z))

    corpus, asked = hashed(stream, "id", "j", "zs"), hashed(texts, "text", "i", "zt")
    common = None if most is None else corpus.groupBy("x", "y").agg(F.count("*").alias("n")).where(F.col("n") > most).drop("n")
    row = lambda df, rare: df.select("text", "id", "i", "j", (F.col("zt") == F.col("zs")).alias("strict_ok"), F.lit(rare).alias("rare"))
    if common is None or common.isEmpty():
        return row(asked.join(bounded(corpus), ["x", "y"]), True)
    met = row(asked.join(bounded(corpus.join(common, ["x", "y"], "left_anti")), ["x", "y"]), True)
    diagonals = met.select("text", "id", (F.col("i") - F.col("j")).alias("d")).distinct()
    frequent = asked.join(common, ["x", "y"], "left_semi").join(diagonals, "text").withColumn("j", F.col("i") - F.col("d")).where("j >= 0")
    return met.unionByName(row(frequent.join(corpus.join(common, ["x", "y"], "left_semi"), ["id", "j", "x", "y"]), False))


def grams(rows: DataFrame, size: int, pos: str, *names: str) -> DataFrame:
    """(.., pos, x, y, g) of each run of ``size`` tokens of ``rows`` (.., loose, and strict perhaps): its place, two hashes of it, and
    its tokens w0, w1 .. and s0, s1 ...

    Neighbours are brought side by side by shifted arrays; the hashes are then plain expressions over a row's columns, which
    cost a third of those made for each place within the array.
    """
    n = F.greatest(F.size("loose") - (size - 1), F.lit(0))
    beside = F.arrays_zip(*(F.slice(c, F.lit(k + 1), n).alias(f"{w}{k}") for c, w in (("loose", "w"), ("strict", "s")) if c in rows.columns for k in range(size)))
    run = [F.col("g")[f"w{k}"] for k in range(size)]
    return rows.where(F.size("loose") >= size).select(*names, F.posexplode(beside).alias(pos, "g")).select(*names, pos, F.xxhash64(*run).alias("x"), F.xxhash64(F.lit(size), *run).alias("y"), "g")


def runs(seeds_: DataFrame, size: int = 4) -> DataFrame:
    """(text, id, i, j, n, strict_ok): the longest runs that seeds make, neighbour by neighbour on a diagonal; one of them must be rare."""
    diagonal = Window.partitionBy("text", "id", F.col("i") - F.col("j")).orderBy("i")
    islands = seeds_.withColumn("island", F.col("i") - F.row_number().over(diagonal))
    grouped = islands.groupBy("text", "id", (F.col("i") - F.col("j")).alias("d"), "island").agg(F.min("i").alias("i"), F.min("j").alias("j"), (F.count("*") + size - 1).cast("int").alias("n"), F.bool_and("strict_ok").alias("strict_ok"), F.bool_or("rare").alias("rare"))
    return grouped.where("rare").select("text", "id", "i", "j", "n", "strict_ok")


def quotations(texts: DataFrame, stream: DataFrame, size: int = 4, least: int = 6, most: int | None = 4000) -> DataFrame:
    """(text, id, i, j, n, strict_ok): runs of at least ``least`` tokens; strict where case and accents agree too.

    Texts are read once: what the strict test needs travels with the seeds. ``size`` and ``most`` are those of ``seeds``.
    """
    return runs(seeds(texts, stream, size, most), size).where(F.col("n") >= least)


def accepted(runs_: DataFrame, stream: DataFrame, stop: list[str], chain: list[str], need: int = 6, content: int = 3, rare: int = 3, most: int = 60) -> DataFrame:
    """Runs that are quotations: long ones with enough content words, whole records, and short ones that are rare.

    ``stop``: words that carry no content; ``chain``: words of which a list of narrators is made. Adds why, n_content, n_places.
    A run's words are read in the stream, where they are the same, so texts are read once, for their seeds.
    """
    words = F.slice("loose", F.col("j") + 1, F.col("n"))
    size = F.size(F.filter(words, lambda w: ~w.isin(stop)))
    chained = F.size(F.filter(words, lambda w: w.isin(chain))) * 2 >= F.col("n")
    rows = runs_.join(stream.select("id", "loose"), "id").withColumns({"n_content": size, "chained": chained, "whole": F.size("loose")}).drop("loose")
    rows = rows.withColumn("n_places", F.count("*").over(Window.partitionBy("text", "i", "n")))
    why = (
        F.when((F.col("n") >= need) & (F.col("n_content") >= content), "long")
        .when((F.col("j") == 0) & (F.col("n") == F.col("whole")), "whole")
        .when((F.col("n") >= rare) & (F.col("n_content") >= 1) & (F.col("n_places") <= most) & ~F.col("chained"), "rare")
    )
    return rows.withColumn("why", why).where("why is not null").select("text", "id", "i", "j", "n", "n_content", "n_places", "why")


def widened(anchors: DataFrame, gap: int = 3) -> DataFrame:
    """Spans (text, id, start, end) at most ``gap`` apart are joined; what stands between must not be a letter (``blank``)."""
    order = Window.partitionBy("text", "id").orderBy("start", "end")
    near = F.coalesce((F.col("start") - F.lag("end").over(order) <= gap) & F.col("blank"), F.lit(False))
    grouped = anchors.withColumn("part", F.sum(F.when(near, 0).otherwise(1)).over(order))
    return grouped.groupBy("text", "id", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("parts")).drop("part")


def coded(tokens: Column, quote: Column) -> Column:
    """Tokens as a string with a character for each: those of the quote by their first place in it, all others alike."""
    place = lambda t: F.when(F.array_position(quote, t) > 0, F.array_position(quote, t) + 34).otherwise(33)
    char = lambda t: F.decode(F.unhex(F.lpad(F.hex(place(t).cast("long")), 4, "0")), "UTF-16BE")
    return F.array_join(F.transform(tokens, char), "")


def windows(pairs: DataFrame) -> DataFrame:
    """(q, id, w, at, score) of each window of a record around the quote's length: 1 - distance / longer length.

    ``pairs``: (q, ql, id, loose). Lengths are 0.8, 1 and 1.2 times the quote's, rounded. A record shorter than a
    window is compared whole, once. Windows further off than 0.45 of the longer length are left out.
    """
    n, m = F.size("ql"), F.size("loose")
    lengths = F.array_distinct(F.array(*(F.greatest(F.lit(1), F.round(n * x).cast("int")) for x in (0.8, 1.0, 1.2))))
    rows = pairs.where((n > 0) & (m > 0)).select("q", "ql", "id", "loose", F.explode(lengths).alias("w"))
    rows = rows.withColumn("whole", F.col("w") > m).withColumn("w", F.least(F.col("w"), m)).distinct()
    rows = rows.select("*", coded(F.col("ql"), F.col("ql")).alias("qc"), coded(F.col("loose"), F.col("ql")).alias("rc"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), m - F.col("w"))).alias("at"))
    longer = F.greatest(n, F.col("w"))
    cutoff = F.when(F.col("whole"), longer).otherwise(F.floor(longer * 0.45).cast("int"))
    distance = F.levenshtein("qc", F.expr("substring(rc, at + 1, w)"))
    return rows.withColumn("d", distance).where(F.col("d") <= cutoff).select("q", "id", "w", "at", (1 - F.col("d") / longer).alias("score"))


def best_windows(windows_: DataFrame) -> DataFrame:
    """The best window of each record: score, then the shorter, then the first. Scores have four decimals, half to even."""
    order = Window.partitionBy("q", "id").orderBy(F.desc("score"), "w", "at")
    return windows_.withColumn("n", F.row_number().over(order)).where("n = 1").select("q", "id", "w", "at", F.bround("score", 4).alias("score"))


def merged_windows(hits: DataFrame) -> DataFrame:
    """Window hits of several searches: the best of each record."""
    return best_windows(hits)


def region(seeds_: DataFrame, stream: DataFrame) -> DataFrame:
    """Around each seed window (q, ql, id, at, w) as many tokens as the quote has on both sides, within the stream: pairs for ``windows``."""
    n = F.size("ql")
    rows = seeds_.join(stream.select("id", "loose"), "id")
    low = F.greatest(F.lit(0), F.col("at") - n)
    high = F.least(F.size("loose"), F.col("at") + F.col("w") + n)
    return rows.select("q", "ql", "id", F.slice("loose", low + 1, high - low).alias("loose"), low.alias("low"))


def census(hits: DataFrame) -> DataFrame:
    """Whether unwritten letters are proved by the corpus: one spelling at all places of a quote, and no form chosen otherwise.

    ``hits``: (q, place, user, first, second), strict tokens of the quote and of both editions there. Gives (q, proved,
    has_swap, unique, spelling, alternatives): not proved if a token is another word. Alternatives by count, then spelling.
    """
    chosen = F.zip_with(F.arrays_zip(F.col("user").alias("u"), F.col("first").alias("a")), F.col("second"), lambda x, b: O.choose_spelling(x["u"], x["a"], b))
    rows = hits.withColumn("c", chosen).select("q", "place", F.array_join(F.col("c.spelling"), " ").alias("spelling"), F.exists("c", lambda c: c["class"] == "other").alias("other"), F.exists("c", lambda c: c["class"] == "swap").alias("swap"))
    counted = rows.groupBy("q", "spelling").agg(F.count("*").alias("n"), F.bool_or("other").alias("other"), F.bool_or("swap").alias("swap"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "spelling", "n")))
    out = counted.groupBy("q").agg(F.bool_or("other").alias("other"), F.bool_or("swap").alias("has_swap"), order.alias("all"))
    unique = ~F.col("other") & ~F.col("has_swap") & (F.size("all") == 1)
    return out.select("q", (~F.col("other")).alias("proved"), "has_swap", unique.alias("unique"), F.when(unique, F.col("all")[0]["spelling"]).otherwise("").alias("spelling"), F.transform("all", lambda x: F.struct(x["spelling"].alias("spelling"), x["n"].alias("count"))).alias("alternatives"))
