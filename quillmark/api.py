"""Batches of texts in, verdicts out: what a user calls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import english
from .functions import orthography as O
from .operators import alignment as A
from .operators import anchors as N
from .operators import decisions as D
from .operators import diffs as X
from .operators import evidence as V
from .operators import extraction as E
from .operators import index as I
from .operators import lexicon as L
from .operators import segments as G
from .operators import validation as P
from .operators.tables import Scratch


def find_spans(texts: DataFrame, records: DataFrame, arabic: bool = False, least: int = 6, proposals: DataFrame | None = None, chapters: dict[str, int] | None = None) -> DataFrame:
    """(id, start, end, kind, marked, quoted) of the quotations in ``texts`` (id, text).

    By brackets, introducing and trailing words, tags, anchors, which are long or rare stretches that stand in ``records``
    (id, corpus, book, text ..; see ``anchors.Rule``, ``least``: words of a long one), and ``proposals`` (id, start, end, kind). Overlapping spans become one; edges are tightened; labels are none. A
    span of unknown kind takes that of what introduces it or of the source it claims. The result is a table that
    stays until the application ends.
    """
    with Scratch(texts.sparkSession) as settled:
        lib = settled(V.streams(V.editions(V.completed(records), arabic)))
        return settled.kept(spans_of(texts, lib, settled, arabic, least, proposals, chapters))


def anchor_rule(arabic: bool, least: int = 6) -> N.Rule:
    """What makes an anchor: the stop words and formulas are Arabic ones."""
    return N.Rule(need=least, stop=L.ANCHOR_STOP, formal=L.ANCHOR_FORMAL, chain=L.ANCHOR_CHAIN, link=L.ANCHOR_LINK) if arabic else N.Rule(need=least)


def anchored(texts: DataFrame, lib: DataFrame, arabic: bool, least: int = 6) -> DataFrame:
    """(id, start, end, kind, marked) of what stands in either edition of ``lib``'s streams, of ``texts`` (id, text)."""
    name = lambda variant: F.struct("sid", F.lit(variant).alias("variant")).alias("id")
    editions = [(0, "loose", lib), (1, "loose_alt", lib.where("loose <> loose_alt"))]
    stream = reduce(DataFrame.unionByName, (rows.select(name(v), F.col(c).alias("loose")) for v, c, rows in editions))
    part = lambda v, rows: rows.select(name(v), "corpus", (F.col("corpus") == V.SCRIPTURE).alias("scripture"), F.explode("parts").alias("p")).select("id", "corpus", "scripture", F.col("p.open").alias("first"), F.col("p.after").alias("after"))
    parts = reduce(DataFrame.unionByName, (part(v, rows) for v, _, rows in editions))
    cut = texts.select("id", "text", O.tokens(F.col("text"), arabic).alias("t")).select("id", "text", F.col("t.loose").alias("loose"), F.transform("t", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("places"))
    found = N.spans(N.detected(cut.select("id", "loose"), stream, parts, anchor_rule(arabic, least)), cut, "[ء-ي]" if arabic else "\\p{L}")
    return found.select("id", "start", "end", F.when(F.col("corpus") == V.SCRIPTURE, "quran").otherwise("hadith_matn").alias("kind"), F.lit(False).alias("marked"))


def spans_of(texts: DataFrame, lib: DataFrame, settled: Scratch, arabic: bool = False, least: int = 6, proposals: DataFrame | None = None, chapters: dict[str, int] | None = None) -> DataFrame:
    """The spans of ``find_spans``; ``lib``: the records' streams."""
    texts = texts.where("text is not null")
    marked = E.bracketed(texts).unionByName(E.introduced(texts))
    told = settled(marked.unionByName(E.uncovered(E.trailed(texts), marked)))
    told = settled(E.merged(told.unionByName(E.uncovered(E.introduced_english(texts), told))))
    spoken = told.join(texts, "id").where(~E.is_noise(_cut(), F.col("marked")))
    claim = E.claimed_around(F.col("text"), F.col("start"), F.col("end"), chapters)
    before = F.substring("text", F.greatest(F.col("start") - 120, F.lit(0)) + 1, F.least(F.col("start"), F.lit(120)))
    kinded = spoken.select("id", "start", "end", F.when(F.col("kind") == "unknown", E.kind_from_context(before, claim)).otherwise(F.col("kind")).alias("kind"), "marked")
    spans = settled(G.augmented(kinded, E.tagged(texts), settled(E.merged(anchored(texts, lib, arabic, least)))))
    if proposals is not None:
        spans = spans.unionByName(proposals.select("id", "start", "end", "kind", F.lit(False).alias("marked")))
    cut = spans.join(texts, "id").withColumn("x", E.tightened(_cut())).where(F.length("x.core") > 0)
    tight = cut.select("id", (F.col("start") + F.col("x.lead")).alias("start"), (F.col("start") + F.col("x.lead") + F.length("x.core")).alias("end"), "kind", "marked")
    return E.merged(settled(tight)).join(texts, "id").withColumn("quoted", _cut()).drop("text")


def _cut() -> Column:
    return F.expr("substring(text, start + 1, end - start)")


_MATCH = f"array<struct<ord:int,rec:bigint,corpus:string,book:string,tier:string,score:double,start:int,n:int,continues_to:bigint,source_text:string,source_range:array<int>,kinds:array<string>,diff:{A.OPS}>>"


def check(texts: DataFrame, records: DataFrame, arabic: bool = False, most_quotes: int = 30, shown: int = 3, image: bool = False, spans: DataFrame | None = None, proposals: DataFrame | None = None, chapters: dict[str, int] | None = None) -> DataFrame:
    """A row for each quotation in ``texts`` (id, text): its place, verdict, and the matches that the verdict rests on.

    ``records``: (id, corpus, book, text) and, where a corpus has them, ``evidence.OPTIONAL``: a second edition, chapter and
    verse (a chapter's records are searched as one stream), vocalised text, grade. ``spans``: quotations that are known
    already (id, start, end, kind, marked, quoted). Columns: id, start, end, quoted, kind, repeats, truncated, status, score,
    message, scope, reason, notices, mismatch, total, segments and matches. Texts without quotations have no row; null texts
    neither. Equal characters get one verdict.

    A verdict that its own proof doesn't confirm is lowered: verbatim words must stand in a record again, a completed
    spelling must be the only one again, and a quotation that only names its source or narrators is none.

    The result is a table in the shared folder that stays until the application ends; what it took to make it is deleted.
    """
    with Scratch(texts.sparkSession) as settled:
        return settled.kept(_checked(texts, records, settled, arabic, most_quotes, shown, image, spans, proposals, chapters))


def _checked(texts: DataFrame, records: DataFrame, settled: Scratch, arabic: bool, most_quotes: int, shown: int, image: bool, spans: DataFrame | None, proposals: DataFrame | None, chapters: dict[str, int] | None) -> DataFrame:
    records, texts = V.completed(records), texts.where("text is not null")
    own = settled(V.editions(records, arabic))
    lib = settled(V.streams(own))
    spans = settled(spans_of(texts, lib, settled, arabic, proposals=proposals, chapters=chapters) if spans is None else spans)
    one = E.deduplicated(G.prepared(spans, arabic).select("id", "start", "quoted"), most_quotes)
    quotes = settled(one.join(spans, ["id", "start", "quoted"]).join(texts, "id").withColumn("q", F.xxhash64("id", "start")))
    asked = settled(quotes.select("q", "quoted", O.loose_tokens(F.col("quoted"), arabic).alias("loose"), O.strict_tokens(F.col("quoted"), arabic).alias("strict")))
    claim = E.claimed_around(F.col("text"), F.col("start"), F.col("end"), chapters)
    language = O.language(F.col("quoted")) if arabic else F.lit("ar")
    facts = settled(quotes.join(asked.select("q", F.size("loose").alias("n_tokens")), "q").withColumn("c", claim).select(
        "q", "n_tokens", language.alias("language"), "kind", "marked", E.asserted_kind(F.col("text"), F.col("start"), F.col("end")).alias("asserted"), F.coalesce("c.books", F.array().cast("array<string>")).alias("books"),
        F.col("c.surah").alias("ref_surah"), "c.surah", "c.ayah", "c.ayah_to",
    ))
    searched = asked.join(facts.where("language = 'ar' and n_tokens > 0"), "q", "left_semi")
    evidence = V.gathered(searched.select("q", "loose", "strict"), records, own, lib, settled)
    decided = settled(D.decide(facts, evidence))
    won = settled(D.winners(decided, evidence))

    verse = V.matched_verse(evidence, records, facts.select("q", "surah", "ayah", "ayah_to"))
    books = won.groupBy("q").agg(F.array_distinct(F.array_compact(F.collect_list("book"))).alias("found_books"))
    claims = facts.select("q", "surah", "ayah", "ayah_to", "books").join(verse, "q", "left").join(books, "q", "left")
    decided = D.apply_claims(decided, claims.withColumn("found_books", F.coalesce("found_books", F.array().cast("array<string>"))))
    mismatch = settled(decided.select("q", "mismatch"))
    diffs = None
    runs = E.foreign_runs(F.col("quoted")) if arabic else F.array()
    decided = settled(D.foreign_gate(decided.drop("mismatch"), asked.select("q", (F.size(runs) > 0).alias("foreign"))))
    if arabic:
        diffs = settled(V.vowel_diffs(settled(V.compared(won.where("is_exact"), asked.where(O.vocalised(F.col("quoted"))), records, lib, arabic))))
        kinds = diffs.select("q", "id", F.array_sort(F.array_distinct(F.transform("found", lambda d: d["kind"]))).alias("kinds"))
        decided, won = (settled(x) for x in D.vowel_gate(decided, won, kinds, asked.where(O.vocalised(F.col("quoted")))))
    decided = D.image_gate(decided) if image else decided
    decided = settled(_noted(decided, facts, evidence, won, records, lib, shown))
    decided = settled(_validated(decided, won, asked, records, lib, arabic))

    matches = _matches(won.where(F.col("ord") <= shown), asked, records, lib, decided, diffs, settled, arabic)
    total = won.groupBy("q").agg(F.count("*").cast("int").alias("total"))
    rows = quotes.join(decided, "q").join(mismatch, "q").join(matches, "q", "left").join(total, "q", "left")
    parts = G.segments(F.col("text"), F.col("start"), F.col("end"), (F.col("scope") == "quran") | (F.col("kind") == "quran"), chapters)
    return rows.select("id", "start", "end", "quoted", "kind", "repeats", "truncated", "status", "score", "message", "scope", "reason", "notices", "mismatch", F.coalesce("total", F.lit(0)).alias("total"), parts.alias("segments"), F.coalesce("matches", F.array().cast(_MATCH)).alias("matches"))


def _noted(decided: DataFrame, facts: DataFrame, evidence: DataFrame, won: DataFrame, records: DataFrame, lib: DataFrame, shown: int) -> DataFrame:
    """Verdicts with the notices that describe them and change none; each notice once, in order."""
    verses = records.where("chapter is not null").groupBy(F.col("chapter").alias("surah")).agg(F.max("verse").alias("verses"))
    impossible = facts.where("surah is not null").join(F.broadcast(verses) if verses.limit(1001).count() <= 1000 else verses, "surah", "left").select("q", (~P.possible_reference(F.col("surah"), F.col("ayah"), F.col("ayah_to"), F.col("verses"))).alias("impossible"))
    whole = V.fragments(won, lib)
    told = won.join(records.select("id", "chapter", "verse", "grade"), "id").groupBy("q").agg(
        F.count("*").alias("total"), F.bool_or("first_edition").alias("reading"), F.array_sort(F.collect_set(F.struct("chapter", "verse"))).alias("refs"),
        F.collect_set(F.when(F.col("ord") <= shown, D.tier(F.col("corpus"), F.col("book")))).alias("tiers"), F.bool_or(F.col("grade").isNotNull()).alias("graded"),
    )
    rows = decided.join(impossible, "q", "left").join(whole, "q", "left").join(told, "q", "left")
    basmala = F.to_json("refs") == '[{"chapter":1,"verse":1},{"chapter":27,"verse":30}]'
    found = (F.col("status") == "found") & (F.col("scope") == "quran")
    own = F.array_compact(F.array(
        F.when(F.col("impossible"), "claimed_ref_invalid"), F.when(found & F.col("reading"), "qiraah_note"), F.when(found & basmala, "basmala_note"), F.when(F.col("total") > shown, "many_positions"), F.when(found & F.col("fragment"), "quran_fragment"),
    ))
    source = D.source_notices(F.coalesce("tiers", F.array().cast("array<string>")), F.coalesce("graded", F.lit(False)), F.col("status"), F.col("scope"))
    message = F.when((F.col("status") == "found") & (F.col("total") > 1), "found_multi").otherwise(F.col("message"))
    return rows.select("q", "status", F.round("score", 4).alias("score"), message.alias("message"), "scope", "reason", F.array_distinct(F.concat("notices", own, source)).alias("notices"))


def _validated(decided: DataFrame, won: DataFrame, asked: DataFrame, records: DataFrame, lib: DataFrame, arabic: bool) -> DataFrame:
    """Verdicts that stand their own proof; others are lowered to needs_review, never raised."""
    found = decided.where("status = 'found'").select("q", F.array_contains("notices", "rasm_completed").alias("completed"))
    strict = won.join(found.where("not completed"), "q", "left_semi").join(asked.select("q", F.col("strict").alias("needle")), "q").select("q", F.col("id").alias("rec"), "needle")
    exact = P.stands_again(strict, P.open_streams(lib)).groupBy("q").agg(F.bool_or("ok").alias("ok"))
    tokens = records.select("id", O.strict_tokens(F.col("text"), arabic).alias("tokens"))
    completed = P.completed_again(asked.join(found.where("completed"), "q", "left_semi").select("q", F.col("strict").alias("user")), tokens).select("q", "ok")
    rows = decided.join(exact.unionByName(completed), "q", "left").join(asked.select("q", G.attribution_only(F.col("quoted")).alias("only")), "q")
    failed, only = F.col("status").isin("found", "partial_match") & ~F.coalesce("ok", F.lit(True)), F.col("only").isNotNull() & F.col("status").isin("found", "partial_match")
    lowered = D._lowered(D._lowered(rows, failed, F.lit("validator_rejected")), only & ~failed, F.lit("attribution_only"), F.lit("needs_review_attribution_only"))
    return lowered.drop("ok", "only")


def _matches(won: DataFrame, asked: DataFrame, records: DataFrame, lib: DataFrame, decided: DataFrame, vowels: DataFrame | None, settled: Scratch, arabic: bool) -> DataFrame:
    """(q, matches): what is shown of each record a verdict rests on. The encyclopedia's texts are linked, not shown.

    ``diff`` has the places in which quotation and record differ, of one of three families: vowel signs, where the verdict
    speaks of them; foreign matter, where that is the reason; else words, and the letters of single ones that were replaced.
    """
    last = V.covered(won, lib).groupBy("q", "id").agg(F.max_by("rec", "ord").alias("last"), F.count("*").alias("n"))
    link = F.col("corpus") == V.ENCYCLOPEDIA
    told = decided.select("q", F.when(F.coalesce(F.col("reason") == "diacritic_difference", F.lit(False)) | F.arrays_overlap("notices", F.array(F.lit("harakat_incomplete"), F.lit("waqf_note"))), "vowels").when(F.col("reason") == "foreign_material", "foreign").alias("family"), (F.col("status") == "found").alias("is_found"))
    rows = V.compared(won, asked, records, lib, arabic).join(told, "q").join(won.select("q", "id", "ord", "corpus", "book", "score", "strict_ok"), ["q", "id"])
    family = F.when(link, "none").otherwise(F.coalesce("family", F.when(F.col("is_found") & F.col("strict_ok"), "none").otherwise("words")))
    rows = rows.withColumn("family", family)
    rows = rows.join(vowels, ["q", "id"], "left") if vowels is not None else rows.withColumn("found", F.lit(None).cast("array<struct<k:int,kind:string,quote_chars:array<int>,source_chars:array<int>>>"))
    strict = lambda w: F.struct(w["strict"].alias("strict"), w["start"].cast("int").alias("start"), w["end"].cast("int").alias("end"))
    rows = settled(rows.withColumns({"words": F.transform("words", strict), "window": F.transform("window", strict), "other": F.when(link | (F.col("corpus") != V.SCRIPTURE), F.lit(None)).otherwise(F.col("other"))}))
    by_words = rows.where("family = 'words'").withColumn("diff", A.word_ops(F.col("quoted"), F.col("words"), F.col("text"), F.col("window"), F.col("other"), arabic))
    ways = {"vowels": X.vowel_ops(F.col("words"), F.col("window"), F.coalesce("found", F.array().cast("array<struct<k:int,kind:string,quote_chars:array<int>,source_chars:array<int>>>")))}
    ways["foreign"] = X.foreign_ops(F.col("words"), F.col("window"), E.foreign_runs(F.col("quoted"))) if arabic else F.array().cast(A.OPS)
    others = rows.where("family <> 'words'").withColumn("diff", F.when(F.col("family") == "vowels", ways["vowels"]).when(F.col("family") == "foreign", ways["foreign"]).otherwise(F.array()).cast(A.OPS))
    kinds = F.when(F.col("family") == "words", X.diff_kinds(F.col("diff"))).when(F.col("family") == "vowels", X.vowel_kinds(F.col("found"))).when(F.col("family") == "foreign", F.array(F.lit("foreign_material"))).otherwise(F.array().cast("array<string>"))
    placed = F.filter("window", lambda t: t["start"] >= 0)
    range_ = F.when(~link & (F.size(placed) > 0), F.array(F.get(placed, F.lit(0))["start"], F.element_at(placed, -1)["end"]))
    shown = by_words.unionByName(others).join(last.select("q", "id", F.when(F.col("n") > 1, F.col("last")).alias("continues_to")), ["q", "id"], "left")
    match = F.struct(F.col("ord").cast("int").alias("ord"), F.col("id").alias("rec"), "corpus", "book", D.tier(F.col("corpus"), F.col("book")).alias("tier"), F.round("score", 4).alias("score"), F.col("start").cast("int").alias("start"), F.col("w").cast("int").alias("n"), "continues_to", F.when(~link, F.col("text")).alias("source_text"), range_.alias("source_range"), F.coalesce(kinds, F.array().cast("array<string>")).alias("kinds"), F.coalesce("diff", F.array().cast(A.OPS)).alias("diff"))
    return shown.groupBy("q").agg(F.array_sort(F.collect_list(match)).cast(_MATCH).alias("matches"))


def guard(texts: DataFrame, records: DataFrame, arabic: bool = False) -> DataFrame:
    """A verdict for each text as a whole: no_quotes, clear or flagged, with counts."""
    return D.guard(texts, check(texts, records, arabic))


def compact_check(verdicts: DataFrame, sentences: DataFrame, display_only: tuple[str, ...] = ("ohd_display_note", "ohd_numbering", "many_positions", "no_grade", "hadeethenc_link_only")) -> DataFrame:
    """(id, start, status, reason, quoted, ref, said) of ``check``'s rows: the best match and the sentences of notices that aren't for display alone.

    ``sentences``: (notice, said).
    """
    keyed = verdicts.select("id", "start", "status", "reason", "quoted", F.get("matches", F.lit(0))["rec"].alias("ref"), F.posexplode_outer(F.filter("notices", lambda n: ~n.isin(*display_only))).alias("k", "notice"))
    said = keyed.join(sentences, "notice", "left")
    return said.groupBy("id", "start", "status", "reason", "quoted", "ref").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("said").isNotNull(), F.struct("k", "said")))), lambda x: x["said"]).alias("said"))


def hashes(texts: DataFrame, verdicts: DataFrame, corpus_digest: str, arabic: bool = False) -> DataFrame:
    """(id, hash) of each text's verdicts, which changes only if the corpus, the folded text or a verdict does."""
    quotes = verdicts.select("id", "start", "end", "status", "message", F.transform("matches", lambda m: F.concat(m["corpus"], F.lit(":"), m["rec"].cast("string"))).alias("matches"))
    return D.determinism_hash(texts.select("id", O.joined(O.loose_tokens(F.col("text"), arabic)).alias("folded")), quotes, corpus_digest)


def verify_quotes(quotes: DataFrame, records: DataFrame, arabic: bool = False) -> DataFrame:
    """Verdicts of texts (id, quoted) that are quotations as a whole, as if they stood in quotation marks."""
    return check(quotes.select("id", F.concat(F.lit("«"), F.col("quoted"), F.lit("»")).alias("text")), records, arabic)


def candidates(texts: DataFrame, translations: DataFrame, k: int = 5) -> DataFrame:
    """(q, id, score, rank): for each text (q, text) the translations (id, text) nearest to it by words and word pairs."""
    asked = texts.select("q", english.english_tokens(F.col("text")).alias("t"))
    docs = translations.select("id", english.english_tokens(F.col("text")).alias("t"))
    return I.top_k(I.words_and_pairs(asked, docs), k)


def to_json(rows: DataFrame, path: str) -> None:
    """Verdicts as JSON lines."""
    rows.write.mode("overwrite").json(path)
