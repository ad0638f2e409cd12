"""From evidence to one verdict for each quotation, and from verdicts to guards, hashes and reports.

found: verbatim; partial_match: a near wording, never of scripture; needs_review: a person should look; not_found.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Thresholds:
    """Window scores from which a verdict follows, and tokens under which a quotation is short."""

    partial: float = 0.75
    review: float = 0.70
    scripture_review: float = 0.60
    short_review: float = 0.75
    short_tokens: int = 5


# The two collections that are one tier of their own.
SAHIHAIN = ("sahih_al-bukhari", "sahih_muslim")
STATUSES = ("found", "partial_match", "needs_review", "not_found")


def _verdict(status: str, score: Column, message: Column | str, scope: str, reason: Column | str | None = None, *notices: Column) -> Column:
    message = F.lit(message) if isinstance(message, str) else message
    reason = F.lit(reason).cast("string") if reason is None or isinstance(reason, str) else reason
    kept = F.filter(F.array(*notices) if notices else F.array().cast("array<string>"), lambda n: n.isNotNull())
    return F.struct(F.lit(status).alias("status"), score.cast("double").alias("score"), message.alias("message"), F.lit(scope).alias("scope"), reason.alias("reason"), kept.alias("notices"))


def decide(facts: DataFrame, evidence: DataFrame, th: Thresholds | None = None) -> DataFrame:
    """facts (q, n_tokens, language, kind, marked, asserted, books, ref_surah) and evidence (q, corpus, score, is_exact, strict_ok, rasm).

    Gives (q, status, score, message, scope, reason, notices). Scripture that is exact wins; then other exact hits;
    then spellings that the corpus proves; then differences of spelling; then near wordings, the better side first and
    the other if that one says nothing. What isn't found is reported as what the text claims it to be.
    """
    th = th or Thresholds()
    scripture, exact = F.col("corpus") == "quran", F.col("is_exact")
    strict, loose = exact & F.col("strict_ok"), exact & ~F.col("strict_ok")
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    sides = evidence.groupBy("q").agg(
        *(some(side & kind).alias(name + key) for side, name in ((scripture, "q"), (~scripture, "h")) for kind, key in ((strict, "s"), (loose, "l"), (loose & (F.col("rasm") == "ambiguous"), "amb"), (loose & (F.col("rasm") != "unique"), "other"))),
        F.max(F.when(scripture, F.col("score"))).alias("bq"), F.max(F.when(~scripture, F.col("score"))).alias("bh"), F.max("score").alias("best"),
    )
    rows = facts.join(sides, "q", "left").fillna(False, [a + b for a in "qh" for b in ("s", "l", "amb", "other")])
    one, claims_books = F.lit(1.0), F.size("books") > 0
    as_hadith = F.when(F.col("asserted") == "hadith", "attribution_quran_not_hadith")
    as_quran = F.when(F.col("asserted") == "quran", "attribution_hadith_not_quran")
    wins = F.when(~F.col("kind").isin("quran", "unknown") | claims_books, "quran_wins")
    completed, wording = F.lit("rasm_completed"), F.lit("matched_other_wording")
    short = (F.col("n_tokens") < th.short_tokens) & ~F.col("marked")
    enough = F.col("bq") >= F.when(short, th.short_review).otherwise(th.scripture_review)
    q_side = F.when(enough, _verdict("needs_review", F.col("bq"), F.when(short, "needs_review_short").otherwise("needs_review_quran"), "quran", F.when(short, "short_quote").otherwise("near_miss")))
    h_side = (
        F.when(short & (F.col("bh") >= th.short_review), _verdict("needs_review", F.col("bh"), "needs_review_short", "hadith", "short_quote"))
        .when(~short & (F.col("bh") >= th.partial), _verdict("partial_match", F.col("bh"), "partial_match", "hadith", None, F.lit("hadith_variant")))
        .when(~short & (F.col("bh") >= th.review), _verdict("needs_review", F.col("bh"), "needs_review", "hadith", "near_miss"))
    )
    first = F.col("bq").isNotNull() & (F.col("bh").isNull() | (F.col("bq") >= F.col("bh")))
    near = F.when(first, F.coalesce(q_side, h_side)).otherwise(F.coalesce(h_side, q_side))
    best = F.coalesce("best", F.lit(0.0))
    none = (
        F.when((F.col("kind") == "quran") | ((F.col("kind") == "unknown") & F.col("ref_surah").isNotNull()), _verdict("not_found", best, "not_found_quran", "quran"))
        .when((F.col("kind") == "unknown") & ~claims_books, _verdict("not_found", best, "not_found_any", "both"))
        .otherwise(_verdict("not_found", best, "not_found", "hadith"))
    )
    verdict = (
        F.when(F.col("language") != "ar", _verdict("needs_review", F.lit(0.0), "needs_review_non_arabic", "none", "non_arabic", F.when(F.col("ref_surah").isNotNull(), "arabic_text_at_ref")))
        .when(F.col("qs"), _verdict("found", one, "found", "quran", None, wins, as_hadith))
        .when(F.col("hs"), _verdict("found", one, "found", "hadith", None, as_quran))
        .when(F.col("ql") & ~F.col("qother"), _verdict("found", one, "found", "quran", None, completed, as_hadith))
        .when(F.col("ql") & F.col("qamb"), _verdict("needs_review", one, "needs_review_rasm_ambiguous", "quran", "rasm_ambiguous"))
        .when(F.col("hl") & ~F.col("hother"), _verdict("found", one, "found", "hadith", None, completed, as_quran))
        .when(F.col("hl") & F.col("hamb"), _verdict("needs_review", one, "needs_review_rasm_ambiguous", "hadith", "rasm_ambiguous"))
        .when(F.col("ql"), _verdict("needs_review", one, "needs_review_quran", "quran", "orthographic_difference"))
        .when(F.col("hl"), _verdict("needs_review", one, "needs_review", "hadith", "orthographic_difference", wording))
        .otherwise(F.coalesce(near, none))
    )
    return rows.select("q", verdict.alias("v")).select("q", "v.*")


def apply_claims(decisions: DataFrame, claims: DataFrame) -> DataFrame:
    """Adds mismatch and its notice, and changes no status.

    ``claims``: (q, surah, ayah, ayah_to, m_surah, m_ayah, books, found_books). A verse is consistent if the matched
    one lies in the claimed range; books, if one of the found ones was claimed.
    """
    rows = decisions.join(claims, "q", "left")
    won = F.col("status").isin("found", "partial_match") | ((F.col("status") == "needs_review") & (F.col("scope") != "none"))
    inside = (F.col("surah") == F.col("m_surah")) & F.col("m_ayah").between(F.col("ayah"), F.coalesce("ayah_to", "ayah"))
    verse = won & (F.col("scope") == "quran") & F.col("surah").isNotNull() & F.col("m_surah").isNotNull() & ~inside
    book = won & (F.col("scope") == "hadith") & (F.size("books") > 0) & (F.size("found_books") > 0) & ~F.arrays_overlap("books", "found_books")
    notice = F.when(verse, "claimed_ayah_mismatch").when(book, "claimed_source_mismatch")
    return rows.select("q", "status", "score", "message", "scope", "reason", F.when(notice.isNotNull(), F.concat("notices", F.array(notice))).otherwise(F.col("notices")).alias("notices"), F.coalesce(verse | book, F.lit(False)).alias("mismatch"))


def tier(corpus: Column, book: Column) -> Column:
    return F.when(corpus == "quran", "quran").when(corpus == "encyclopedia", "encyclopedia").when(book.isin(*SAHIHAIN), "sahihain").otherwise("other_nine")


def ordered_evidence(evidence: DataFrame, most: int = 5) -> DataFrame:
    """The strongest records of each quote: score, scripture first, linked-only last, the two first collections, record."""
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("corpus") != "quran", F.col("corpus") == "encyclopedia", ~F.coalesce(F.col("book").isin(*SAHIHAIN), F.lit(False)), "id")
    return evidence.withColumn("ord", F.row_number().over(order)).where(F.col("ord") <= most)


def guard(texts: DataFrame, decisions: DataFrame) -> DataFrame:
    """(id, verdict, quotes, found, flagged, by_status): no_quotes; clear if all are found; else flagged."""
    counts = decisions.groupBy("id").agg(F.count("*").alias("quotes"), F.count_if(F.col("status") == "found").alias("found"), *(F.count_if(F.col("status") == s).alias(s + "_n") for s in STATUSES))
    by = F.array_join(F.array_compact(F.array(*(F.when(F.col(s + "_n") > 0, F.concat(F.lit(s + "="), F.col(s + "_n").cast("string"))) for s in STATUSES))), ",")
    rows = texts.select("id").join(counts, "id", "left").fillna(0)
    verdict = F.when(F.col("quotes") == 0, "no_quotes").when(F.col("quotes") == F.col("found"), "clear").otherwise("flagged")
    return rows.select("id", verdict.alias("verdict"), "quotes", "found", (F.col("quotes") - F.col("found")).alias("flagged"), by.alias("by_status"))


def winners(decisions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Rows of ``evidence`` on which each verdict rests, with ord: exact ones of its side, or the best near one (three of a narration under review)."""
    rows = ordered_evidence(evidence, 1 << 30).join(decisions.select("q", "status", "scope", "reason", "notices"), "q")
    side = rows.where(((F.col("corpus") == "quran") == (F.col("scope") == "quran")) & F.col("scope").isin("quran", "hadith") & (F.col("status") != "not_found"))
    unproved = F.array_contains("notices", "rasm_completed") | F.coalesce(F.col("reason").isin("rasm_ambiguous", "orthographic_difference"), F.lit(False))
    near = (F.col("status") == "partial_match") | F.coalesce(F.col("reason").isin("near_miss", "short_quote"), F.lit(False))
    most = F.when((F.col("reason") == "near_miss") & (F.col("scope") == "hadith"), 3).otherwise(1)
    kept = side.withColumn("ord", F.row_number().over(Window.partitionBy("q").orderBy("ord")))
    kept = kept.where(F.when(near, F.col("ord") <= most).when(unproved, F.col("is_exact") & ~F.col("strict_ok")).otherwise(F.col("is_exact") & F.col("strict_ok")))
    return kept.drop("status", "scope", "reason", "notices")


def foreign_gate(decisions: DataFrame, foreign: DataFrame) -> DataFrame:
    """found becomes needs_review where foreign matter stands between a quotation's words; ``foreign``: (q, foreign)."""
    hit = (F.col("status") == "found") & F.coalesce("foreign", F.lit(False))
    return _lowered(decisions.join(foreign, "q", "left"), hit, F.lit("foreign_material")).drop("foreign")


def _lowered(rows: DataFrame, hit: Column, why: Column, message: Column | None = None) -> DataFrame:
    """Rows that ``hit`` as needs_review for a reason, which is their notice too."""
    review = F.when(F.col("scope") == "quran", "needs_review_quran").otherwise("needs_review")
    return rows.withColumns({
        "status": F.when(hit, "needs_review").otherwise(F.col("status")), "reason": F.when(hit, why).otherwise(F.col("reason")), "message": F.when(hit, review if message is None else message).otherwise(F.col("message")),
        "notices": F.when(hit, F.concat("notices", F.array(why))).otherwise(F.col("notices")),
    })


def vowel_gate(decisions: DataFrame, won: DataFrame, diffs: DataFrame, vocalised: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verdicts and winners after vowels were compared: ``diffs`` (q, id, kinds), ``vocalised`` (q) the quotes that write any.

    Of scripture that was found, records without a conflict stay; marks left out and pauses are noted. If all conflict, or
    none can be aligned, a person should look.
    """
    asked = decisions.where("status = 'found' and scope = 'quran'").select("q").join(vocalised.select("q"), "q", "left_semi")
    rows = won.join(asked, "q", "left_semi").join(diffs, ["q", "id"], "left").withColumn("state", F.when(F.col("kinds").isNull(), "unverified").when(F.array_contains("kinds", "conflict"), "conflict").otherwise("verified"))
    said = lambda kind: F.bool_or((F.col("state") == "verified") & F.array_contains("kinds", kind))
    states = rows.groupBy("q").agg(F.bool_or(F.col("state") == "verified").alias("fine"), F.bool_or(F.col("state") == "conflict").alias("against"), said("missing").alias("missing"), said("waqf").alias("waqf"))
    joined = decisions.join(states, "q", "left")
    bad = F.coalesce(~F.col("fine"), F.lit(False))
    lowered = _lowered(joined, bad, F.when(F.col("against"), "diacritic_difference").otherwise("diacritic_unverified"))
    more = F.array_compact(F.array(F.when(F.col("missing"), "harakat_incomplete"), F.when(F.col("waqf"), "waqf_note")))
    out = lowered.withColumn("notices", F.concat("notices", F.when(F.col("fine"), more).otherwise(F.array().cast("array<string>")))).drop("fine", "against", "missing", "waqf")
    kept = F.when(F.col("fine"), F.col("state") == "verified").when(F.col("against"), F.col("state") == "conflict").otherwise(F.col("state") == "unverified")
    dropped = rows.join(states.select("q", "fine", "against"), "q").where(~kept).select("q", "id")
    return out, won.join(dropped, ["q", "id"], "left_anti")


def image_gate(decisions: DataFrame) -> DataFrame:
    """Of text read from an image nothing is found for sure: the reader may have put it right."""
    hit = F.col("status") == "found"
    noted = decisions.withColumn("notices", F.concat("notices", F.array(F.lit("image_extracted"))))
    return noted.withColumns({"status": F.when(hit, "needs_review").otherwise(F.col("status")), "reason": F.when(hit, "image_unconfirmed").otherwise(F.col("reason")), "message": F.when(hit, "needs_review_image").otherwise(F.col("message"))})


def source_notices(tiers: Column, graded: Column, status: Column, scope: Column) -> Column:
    """What is told about the sources of a narration, never about its standing. ``tiers``: of the shown matches."""
    has = lambda t: F.array_contains(tiers, t)
    narrated, encyclopedia = has("sahihain") | has("other_nine"), has("encyclopedia")
    notices = F.array_compact(F.array(
        F.when(narrated, "ohd_numbering"), F.when(narrated, "ohd_display_note"), F.when(has("other_nine"), "other_nine_referral"), F.when(encyclopedia & graded, "grade_line"),
        F.when(encyclopedia, "hadeethenc_link_only"), F.when(~encyclopedia & status.isin("found", "partial_match"), "no_grade"),
    ))
    return F.when((scope == "hadith") & (F.size(tiers) > 0), notices).otherwise(F.array().cast("array<string>"))


def receipt_state(then: DataFrame, now: DataFrame) -> DataFrame:
    """(id, state): whether a stored determinism hash is that of today: current, stale or unknown."""
    rows = then.select("id", F.col("hash").alias("old")).join(now.select("id", F.col("hash").alias("new")), "id", "left")
    return rows.select("id", F.when(F.col("new").isNull(), "unknown").when(F.col("old") == F.col("new"), "current").otherwise("stale").alias("state"))


def determinism_hash(texts: DataFrame, quotes: DataFrame, corpus_digest: str) -> DataFrame:
    """(id, hash): SHA-256 over the corpus digest, the folded text and each quote's place, verdict, message and matches.

    ``texts``: (id, folded); ``quotes``: (id, start, end, status, message, matches array<string>), in order of start.
    """
    part = F.concat(F.lit("\x00"), F.concat_ws(":", F.col("start").cast("string"), F.col("end").cast("string"), "status", "message"), F.array_join(F.transform("matches", lambda m: F.concat(F.lit("|"), m)), ""))
    parts = quotes.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", part.alias("p")))).alias("parts"))
    rows = texts.join(parts, "id", "left")
    said = F.coalesce(F.array_join(F.transform("parts", lambda p: p["p"]), ""), F.lit(""))
    return rows.select("id", F.sha2(F.concat(F.lit(corpus_digest + "\x00"), F.coalesce("folded", F.lit("")), said), 256).alias("hash"))


def agree(n: Column, forms: tuple[str, str, str, str]) -> Column:
    """Arabic number agreement: the forms for one, two, three to ten, and more."""
    return F.when(n == 1, forms[0]).when(n == 2, forms[1]).when(n.between(3, 10), F.concat(n.cast("string"), F.lit(" " + forms[2]))).otherwise(F.concat(n.cast("string"), F.lit(" " + forms[3])))


def filled(template: Column, values: dict[str, Column]) -> Column:
    """A template with its {names} replaced; with a name that has no value it stays as it is."""
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return F.when(out.rlike(r"\{\w+\}") | out.isNull(), template).otherwise(out)


def percent_encoded(text: Column, most: int = 120) -> Column:
    return F.replace(F.url_encode(F.substring(text, 1, most)), F.lit("+"), F.lit("%20"))
