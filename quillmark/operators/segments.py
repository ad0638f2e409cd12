"""What belongs to a quotation beside its words: records it runs over, its rank among translations, chains and sources around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import orthography as O
from ..functions.arrays import bound
from . import extraction as E
from . import lexicon as L

# Tokens from which a quotation is judged, by what it claims to be; those of an explicit quotation.
LEAST = {"quran": 2, "hadith_matn": 3}
LEAST_MARKED = 2

def prepared(quotes: DataFrame, arabic: bool = True) -> DataFrame:
    """Quotes (kind, marked, quoted) with enough words to be judged; those without a word in any script are none."""
    n, language = F.size(O.loose_tokens(F.col("quoted"), arabic)), O.language(F.col("quoted")) if arabic else F.lit("ar")
    least = F.when(F.col("kind") == "quran", LEAST["quran"]).otherwise(LEAST["hadith_matn"])
    enough = n >= F.when(F.col("marked"), F.least(least, F.lit(LEAST_MARKED))).otherwise(least)
    return quotes.where(F.when(language == "ar", enough).otherwise((n > 0) | (language != "other")))


def records_covering(windows: DataFrame, records: DataFrame) -> DataFrame:
    """(q, rec, ord): records (doc, rec, first, after) that a window (q, doc, start, n) touches, in their order.

    Records of a document lie side by side, so the join is on the document with a range inside it.
    """
    met = windows.join(records, "doc").where((F.col("first") < F.col("start") + F.col("n")) & (F.col("start") < F.col("after")))
    return met.select("q", "rec", F.row_number().over(Window.partitionBy("q").orderBy("first")).alias("ord"))


def best_per_reference(scores: DataFrame, k: int = 5, decimals: int = 6) -> DataFrame:
    """(q, kind, ref, id, score, rank): of (q, kind, ref, priority, id, score) the k best references, each by its best translation.

    Order: rounded score, scripture first, the reference's numbers in natural order, the source's priority, the id.
    """
    natural = F.transform(F.split("ref", ":"), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    order = [F.desc("score"), F.col("kind") != "quran", natural, "priority", "id"]
    rows = scores.withColumn("score", F.bround("score", decimals)).where("score > 0")
    one = rows.withColumn("n", F.row_number().over(Window.partitionBy("q", "kind", "ref").orderBy(*order))).where("n = 1")
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k).select("q", "kind", "ref", "id", "score", "rank")


def located(needle: Column, hay: Column) -> Column:
    """Where an array stands in another one, from 0: -1 if nowhere or at more than one place."""
    n = F.size(needle)
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(hay) - n, F.lit(0))), lambda k: F.slice(hay, k + 1, n) == needle)
    return F.when((n > 0) & (n <= F.size(hay)) & (F.size(at) == 1), at[0]).otherwise(-1)


def chain_shaped(tokens: Column) -> Column:
    """Whether loose words are a list of narrators: three to forty, begun by a link, two links at least, each name close after a chain word."""
    links = F.size(F.filter(tokens, lambda t: t.isin(*L.CHAIN_START)))
    near = F.forall(F.transform(tokens, lambda t, i: t.isin(*L.CHAIN_WORDS) | F.exists(F.slice(tokens, F.greatest(i - 1, F.lit(1)), F.least(i, F.lit(2))), lambda w: w.isin(*L.CHAIN_WORDS))), lambda x: x)
    return F.coalesce(F.get(tokens, F.lit(0)).isin(*L.CHAIN_START), F.lit(False)) & F.size(tokens).between(3, L.LONGEST_CHAIN) & (links >= 2) & near


def only_filler(text: Column) -> Column:
    """Whether a text has nothing but honorifics and reporting verbs."""
    some = "|".join(sorted(L.CHAIN_FILLER, key=lambda p: -len(p.split())))
    return O.joined(O.loose_tokens(text)).rlike(f"^(?:(?:{some})(?: |$))*$")


def chain_then_filler(text: Column, most: int = 12) -> Column:
    """Whether narrators are peeled off from the left, ``most`` at most, until only filler is left."""
    kind = "struct<rest:string,some:boolean,done:boolean,filler:boolean>"
    start = F.struct(text.alias("rest"), F.lit(False).alias("some"), F.lit(False).alias("done"), F.lit(False).alias("filler")).cast(kind)

    def step(acc: Column, _: Column) -> Column:
        link = F.regexp_extract(acc["rest"], f"^(?:{L.NARRATOR})", 0)
        rest = F.ltrim(F.regexp_replace(F.substring(acc["rest"], F.length(link) + 1, F.length(acc["rest"])), "[\\s:：،,.؛;\\-–]+$", ""))
        further = F.regexp_replace(rest, "^(?:قال|قالت)\\s+", "")
        stop = (further == rest) & ~rest.rlike(L.CHAIN_LINK)
        peeled = F.struct(F.when(stop, rest).otherwise(further).alias("rest"), F.lit(True).alias("some"), (only_filler(rest) | stop).alias("done"), only_filler(rest).alias("filler")).cast(kind)
        halted = F.struct(acc["rest"].alias("rest"), acc["some"].alias("some"), F.lit(True).alias("done"), acc["filler"].alias("filler")).cast(kind)
        return F.when(acc["done"], acc).when(link == "", halted).otherwise(peeled)

    end = F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step)
    return bound(end, lambda e: e["filler"] | (e["some"] & only_filler(e["rest"])))


def quote_inner(quoted: Column) -> Column:
    """What stands in the first brackets of a quotation that kept its introducer; else the quotation without marks at its edges."""
    pattern, marks = '«([^«»]+)»|“([^“”]+)”|"([^"]+)"|﴿([^﴾﴿]+)﴾', "«»\"“”‹›﴾﴿()\\[\\]'’"
    groups = [F.nullif(F.regexp_extract(quoted, pattern, k), F.lit("")) for k in range(1, 5)]
    return F.trim(F.coalesce(*groups, F.regexp_replace(F.trim(quoted), f"^[{marks}]+|[{marks}]+$", "")))


def attribution_only(quoted: Column) -> Column:
    """attribution: a quotation that only names books; isnad: a chain of narrators without a text; null: it has words of its own."""

    def kind(inner: Column) -> Column:
        claim = E.claimed_source(inner)
        at = F.position(claim["raw"], inner)  # only the first place is taken out
        rest = F.concat(F.substring(inner, F.lit(1), at - 1), F.lit(" "), F.substring(inner, at + F.length(claim["raw"]), F.length(inner)))
        letters = F.length(F.regexp_replace(rest, r"\P{L}", ""))
        bare = (F.size(claim["books"]) > 0) & (letters <= 2)
        words = O.loose_tokens(inner)
        chain = (F.size(words) >= 3) & (chain_then_filler(inner) | chain_shaped(words))
        return F.when(F.coalesce(bare, F.lit(False)), "attribution").when(chain, "isnad")

    return bound(quote_inner(quoted), kind)


def chain_before(text: Column, start: Column, reach: int = L.CHAIN_REACH) -> Column:
    """struct<type, start, end> of the chain of narrators that ends right before a quotation, two characters between at most; null if there is none."""
    low = F.greatest(start - reach, F.lit(0))

    def last(window: Column) -> Column:
        between = lambda x: F.regexp_replace(F.substring(window, x["end"] + 1, F.length(window)), f"{L.TAG}|[\\s\"'«“*:]", "")
        good = F.filter(E.places(window, L.NARRATOR), lambda x: F.length(between(x)) <= 2)
        return bound(F.element_at(good, -1), lambda x: F.when(F.size(good) > 0, F.struct(F.lit("isnad").alias("type"), (low + x["start"]).alias("start"), (low + x["start"] + F.length(F.rtrim(x["value"]))).alias("end"))))

    return bound(F.substring(text, low + 1, start - low), lambda w: F.when(w.rlike(L.NARRATOR), last(w)))


def source_near(text: Column, start: Column, end: Column, scripture: Column, chapters: dict[str, int] | None = None, window: int = 90, reach: int = 40) -> Column:
    """struct<type, start, end> of a claimed source after a quotation, else before it, at most ``reach`` characters away.

    After it the search stops where the next citation begins. Of the two kinds of sources that of the quotation's own kind
    comes first; one of scripture must name a chapter.
    """
    low = F.greatest(start - window, F.lit(0))
    after = F.get(F.split(F.substring(text, end + 1, F.lit(window)), L.NEXT_CITATION, 2), F.lit(0))
    before = F.substring(text, low + 1, start - low)

    def names_chapter(value: Column) -> Column:
        claim = E.claimed_source(value, chapters)
        return value.contains("سورة") | F.coalesce(claim["surah"].isNotNull() & value.rlike("[ء-ي]"), F.lit(False))

    def found(part: Column, base: Column, pattern: str, first: bool) -> Column:
        near = (lambda x: x["start"] <= reach) if first else (lambda x: F.length(part) - x["end"] <= reach)

        def segment(x: Column) -> Column:
            fits = near(x) & (names_chapter(x["value"]) if pattern == L.SOURCE_OF_SCRIPTURE else F.lit(True))
            cut = E.tightened(x["value"])
            return F.when(fits & (F.length(cut["core"]) > 0), F.struct(F.lit("claimed_source").alias("type"), (base + x["start"] + cut["lead"]).alias("start"), (base + x["start"] + cut["lead"] + F.length(cut["core"])).alias("end")))

        return F.when(part.rlike(pattern), bound(F.element_at(E.places(part, pattern), 1 if first else -1), segment))

    def either(part: Column, base: Column, first: bool) -> Column:
        q, h = found(part, base, L.SOURCE_OF_SCRIPTURE, first), found(part, base, L.SOURCE_OF_NARRATION, first)
        return F.when(scripture, F.coalesce(q, h)).otherwise(F.coalesce(h, q))

    return F.coalesce(bound(after, lambda w: either(w, end, True)), bound(before, lambda w: either(w, low, False)))


def segments(text: Column, start: Column, end: Column, scripture: Column, chapters: dict[str, int] | None = None) -> Column:
    """array<struct<type, start, end>>: a quotation (Ayah or matn), its claimed source, and the chain before a narration."""
    source, chain = source_near(text, start, end, scripture, chapters), F.when(~scripture, chain_before(text, start))
    own = F.struct(F.when(scripture, "Ayah").otherwise("matn").alias("type"), start.cast("int").alias("start"), end.cast("int").alias("end"))
    kind = "struct<type:string,start:int,end:int>"
    apart = bound(source, lambda s: F.when(~((s["start"] < end) & (start < s["end"])), s.cast(kind)))
    return F.array_compact(F.array(own.cast(kind), apart, chain.cast(kind)))


def augmented(spans: DataFrame, tags: DataFrame, anchors: DataFrame) -> DataFrame:
    """Spans (id, start, end, kind, marked) where tags replace what they overlap, and anchors fill what is free.

    A span of unknown kind that an anchor overlaps takes the kind of the first such anchor; anchors don't overlap each other.
    """
    kept = E.uncovered(spans, tags).unionByName(tags)
    free = E.uncovered(anchors, kept)
    asked = kept.select("id", F.col("start").alias("key"), F.lit(0).alias("side"), F.lit(None).cast("struct<start:int,kind:string>").alias("a"), F.struct("start", "end", "kind", "marked").alias("row"))
    there = anchors.select("id", F.col("end").alias("key"), F.lit(1).alias("side"), F.struct(F.col("start").cast("int").alias("start"), "kind").alias("a"), F.lit(None).cast(asked.schema["row"].dataType).alias("row"))
    # Backwards through a text, the last anchor seen is the first one that ends after a span's start.
    order = Window.partitionBy("id").orderBy(F.desc("key"), "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = asked.unionByName(there).withColumn("near", F.last("a", ignorenulls=True).over(order)).where("side = 0")
    told = F.when((F.col("row.kind") == "unknown") & (F.col("near.start") < F.col("row.end")), F.col("near.kind"))
    named = met.select("id", "row.start", "row.end", F.coalesce(told, "row.kind").alias("kind"), "row.marked")
    return named.unionByName(free)
