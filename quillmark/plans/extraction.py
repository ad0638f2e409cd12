"""Spans, claims and flags of free text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diffs as X
from ..operators import extraction as E
from ..operators import lexicon as L
from ..operators import proposals as P
from ..sources import corpus as S
from .common import ITEMS, Query, spread, table


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text")).where("text is not null").select(F.col("doc_id").alias("id"), "text")


def _placed_sql(name: str, source: str, pattern: str) -> str:
    """A common table (id, k, value, start) of a pattern's matches, from what stands between them."""
    return f"""{name}_m AS (SELECT id, regexp_extract_all(text, '{pattern}') AS m, regexp_split_to_array(text, '{pattern}') AS g FROM {source}),
{name} AS (SELECT id, m[k] AS value, CAST(list_sum([length(x) FOR x IN g[1:k]]) + coalesce(list_sum([length(x) FOR x IN m[1:k - 1]]), 0) AS BIGINT) AS start FROM (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM {name}_m))"""


def spans_bracketed(spark: SparkSession, d: str) -> DataFrame:
    s = E.bracketed(_texts(spark, d))
    return s.select("id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "kind", "marked")


_BRACKET_PARTS = [(f"b{k}", f"{E._quoted(a)}[^{E._quoted(b)}]*{E._quoted(b)}") for k, (a, b) in enumerate(L.BRACKETS)]
_BRACKETED = (
    "WITH t AS (SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL), "
    + ", ".join(_placed_sql(name, "t", pattern) for name, pattern in _BRACKET_PARTS)
    + ", every AS ("
    + " UNION ALL ".join(f"SELECT *, {str(name == 'b0').lower()} AS scripture FROM {name}" for name, _ in _BRACKET_PARTS)
    + r"""), inside AS (SELECT *, substring(value, 2, length(value) - 2) AS body FROM every)
SELECT id, start + 1 AS start, start + length(value) - 1 AS "end", CASE WHEN scripture THEN 'quran' ELSE 'unknown' END AS kind, true AS marked FROM inside
WHERE len(regexp_extract_all(body, '[A-Za-z]{2,}')) >= 3 AND NOT regexp_matches(trim(body), '^[\d\s:/\-–،,]+$')"""
)


def spans_introduced(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations after three introducing phrases."""
    c = table(spark, d, "conversations").where("text is not null").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    lead = F.element_at(F.array(F.lit("The Prophet said: "), F.lit("Allah says, "), F.lit("plainly ")), (F.col("id") % 3 + 1).cast("int"))
    s = E.introduced_english(c.select("id", F.concat(lead, F.regexp_replace("text", "[\"(\\[{]", " ")).alias("text")))
    return s.select("id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "kind", "marked")


_INTRODUCED = r"""
WITH t AS (SELECT conv_id * 1000 + turn AS id, regexp_replace(text, '["(\[{]', ' ', 'g') AS body FROM conversations WHERE text IS NOT NULL),
r AS (SELECT id, CASE id % 3 WHEN 0 THEN 18 ELSE 12 END + length(body) - length(ltrim(body, E' \n\t')) AS start, id % 3 AS k, rtrim(regexp_extract(ltrim(body, E' \n\t'), '^[^.!?\n]*')) AS said FROM t WHERE id % 3 < 2)
SELECT id, start, start + length(said) AS "end", CASE WHEN k = 0 THEN 'hadith_matn' ELSE 'quran' END AS kind, false AS marked FROM r WHERE len(regexp_extract_all(said, '[A-Za-z]{2,}')) >= 3
"""


def spans_merged(spark: SparkSession, d: str) -> DataFrame:
    """Three spans of each document: an unmarked one, one inside or across its end, one apart."""
    i = F.col("doc_id")
    span = lambda a, b, kind, marked: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), F.lit(kind).alias("kind"), marked.alias("marked"))
    rows = table(spark, d, "documents").where("doc_id is not null").select(i.alias("id"), F.explode(F.array(span(F.lit(0) + i % 3, F.lit(50) + i % 3, "unknown", F.lit(False)), span(F.lit(10) + i % 50, F.lit(40) + i % 50, "quran", i % 2 == 0), span(F.lit(120) + i % 3, F.lit(130) + i % 3, "hadith_matn", F.lit(True)))).alias("s"))
    return E.merged(rows.select("id", "s.*")).select("id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "kind", "marked")


_MERGED = """
WITH r AS (SELECT doc_id AS id, doc_id % 3 AS a, 50 + doc_id % 3 AS b, 10 + doc_id % 50 AS c, 40 + doc_id % 50 AS e, doc_id % 2 = 0 AS m FROM documents WHERE doc_id IS NOT NULL)
SELECT id, unnest(CASE WHEN c >= b THEN [{s: a, e: b, k: 'unknown', m: false}, {s: c, e: e, k: 'quran', m: m}, {s: 120 + a, e: 130 + a, k: 'hadith_matn', m: true}] WHEN m AND e <= b THEN [{s: c, e: e, k: 'quran', m: true}, {s: 120 + a, e: 130 + a, k: 'hadith_matn', m: true}]
    ELSE [{s: a, e: greatest(b, e), k: 'quran', m: false}, {s: 120 + a, e: 130 + a, k: 'hadith_matn', m: true}] END) AS x FROM r
"""
_MERGED = f'SELECT id, x.s AS start, x.e AS "end", x.k AS kind, x.m AS marked FROM ({_MERGED})'


def detect_pii(spark: SparkSession, d: str) -> DataFrame:
    return E.detectors(_texts(spark, d)).select("id", "private")


_PRIVATE = "SELECT doc_id AS id, " + " OR ".join(f"regexp_matches(text, '{p.replace('(?<!\\d)', '(?:^|[^0-9])').replace('(?!\\d)', '(?:[^0-9]|$)')}')" for p in L.PRIVATE) + " AS private FROM documents WHERE text IS NOT NULL"


def detect_flags(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(F.coalesce("text", F.lit("")), F.when(F.col("turn") % 3 == 0, " What is the ruling?").when(F.col("turn") % 3 == 1, " FORWARD THIS TO all").otherwise("")).alias("text"))
    return E.detectors(c).select("id", "chain_message", "refusal")


_FLAGS = (
    "WITH c AS (SELECT conv_id * 1000 + turn AS id, lower(coalesce(text, '') || CASE turn % 3 WHEN 0 THEN ' What is the ruling?' WHEN 1 THEN ' FORWARD THIS TO all' ELSE '' END) AS t FROM conversations) SELECT id, "
    + " OR ".join(f"contains(t, '{p}')" for p in L.CHAIN_MESSAGES if p.isascii()) + " AS chain_message, " + " OR ".join(f"contains(t, '{p}')" for p in L.RULINGS if p.isascii()) + " AS refusal FROM c"
)


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents as quotes."""
    t = _texts(spark, d).select("id", F.posexplode(F.split("text", "\n")).alias("start", "quoted"))
    return t.where("quoted <> ''")


_LINES = "SELECT id, k - 1 AS start, l[k] AS quoted FROM (SELECT doc_id AS id, string_split(text, E'\\n') AS l, unnest(range(1, len(string_split(text, E'\\n')) + 1)) AS k FROM documents WHERE text IS NOT NULL) WHERE l[k] <> ''"


def dedup_quotes(spark: SparkSession, d: str) -> DataFrame:
    q = E.deduplicated(_lines(spark, d))
    return q.select("id", F.col("ord").cast("long").alias("ord"), F.col("start").cast("long").alias("start"), F.size("repeats").cast("long").alias("repeats"), "truncated")


_DEDUP = f"""
WITH q AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY start) AS k, count(*) OVER (PARTITION BY id) > 30 AS truncated FROM ({_LINES})), g AS (SELECT id, quoted, truncated, min(start) AS start, count(*) - 1 AS repeats FROM q WHERE k <= 30 GROUP BY id, quoted, truncated)
SELECT id, row_number() OVER (PARTITION BY id ORDER BY start) AS ord, start, repeats, truncated FROM g
"""


def cap_quotes(spark: SparkSession, d: str) -> DataFrame:
    q = E.deduplicated(_lines(spark, d), most=5)
    return q.groupBy("truncated").agg(F.count("*").alias("quotes"), F.count_distinct("id").alias("texts"))


def relocated(spark: SparkSession, d: str) -> DataFrame:
    """The third word of each document: where does it stand nearest to the middle?"""
    t = _texts(spark, d).withColumn("word", F.try_element_at(F.split("text", " "), F.lit(3)))
    return t.where("word <> ''").select("id", E.relocate(F.col("text"), F.col("word"), F.floor(F.length("text") / 2)).cast("long").alias("start"))


_RELOCATED = """
WITH t AS (SELECT doc_id AS id, text, string_split(text, ' ')[3] AS word FROM documents WHERE text IS NOT NULL), g AS (SELECT id, length(text) // 2 AS middle, length(word) AS n, string_split(text, word) AS g FROM t WHERE word <> ''),
s AS (SELECT id, middle, n, length(g[k]) AS size, k FROM (SELECT *, unnest(range(1, len(g))) AS k FROM g)),
p AS (SELECT id, middle, CAST(sum(size + n) OVER (PARTITION BY id ORDER BY k) - n AS BIGINT) AS start FROM s) SELECT id, min_by(start, abs(start - middle) * 1000000 + start) AS start FROM p GROUP BY id
"""


def receipt_token(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", X.receipt_payload(X.receipt_token(F.col("text"))).alias("text"))


def matn_start(spark: SparkSession, d: str) -> DataFrame:
    """Items whose words stand after the last "the" or "of the" with three more to come."""
    from .common import items

    s = items(spark, d)
    return s.select("id", S.body_start(F.col("loose"), [["the"], ["of", "the"]]).cast("long").alias("start"))


_MATN = f"""
WITH {ITEMS}, k AS (SELECT id, loose, unnest(range(1, len(loose) + 1)) AS k FROM items),
hits AS (SELECT id, CASE WHEN loose[k] = 'the' AND len(loose) - k >= 3 THEN k WHEN loose[k:k + 1] = ['of', 'the'] AND len(loose) - k - 1 >= 3 THEN k + 1 ELSE 0 END AS after FROM k)
SELECT id, max(after) AS start FROM hits GROUP BY id
"""

#: Words that stand in for markers of a quotation in the documents.
_MARKERS = ("the", "que", "die", "los")


def proposals(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of documents that hold a marker and lie beside all bracketed spans."""
    t = _texts(spark, d)
    found = P.proposed(t, E.bracketed(t), _MARKERS, arabic=False)
    return found.select("id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def _words_sql(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}]+'))"


def _after_sql(marker: str) -> str:
    """Where a marker ends for the last time in s, if four words follow; else 0."""
    back = f"strpos(reverse(s), reverse('{marker}'))"
    return f"CASE WHEN contains(s, '{marker}') AND {_words_sql(f'right(s, {back} - 1)')} >= 4 THEN length(s) - {back} + 1 ELSE 0 END"


_PROPOSALS = f"""
WITH t AS (SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL), known AS ({_BRACKETED}),
parts AS (SELECT id, regexp_extract_all(text, '\\s+') AS m, regexp_split_to_array(text, '\\s+') AS g FROM t),
masked AS (SELECT id, array_to_string([g[k] || CASE WHEN k > len(m) THEN '' WHEN right(g[k], 1) IN ('.', '!', '?', '؟', '؛') THEN repeat(chr(1), length(m[k])) WHEN contains(m[k], chr(10)) THEN left(m[k], strpos(m[k], chr(10)) - 1) || repeat(chr(1), length(m[k]) - strpos(m[k], chr(10)) + 1) ELSE m[k] END FOR k IN range(1, len(g) + 1)], '') AS text FROM parts),
{_placed_sql('sentences', 'masked', '[^' + chr(1) + ']+')},
free AS (SELECT s.id, s.start, s.value AS s FROM sentences s WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.id = s.id AND k.start < s.start + length(s.value) AND s.start < k."end")),
told AS (SELECT id, start, s, greatest({', '.join(map(_after_sql, _MARKERS))}) AS rel FROM free WHERE ({' OR '.join(f"contains(s, '{m}')" for m in _MARKERS)}) AND {_words_sql('s')} >= 4),
bodies AS (SELECT id, start + rel + length(b) - length(ltrim(b, ' :،,-–' || chr(9))) AS start, b, trim(b, ' :،,-–.' || chr(9)) AS body FROM (SELECT *, substring(s, rel + 1) AS b FROM told))
SELECT id, start, start + length(body) AS "end" FROM bodies WHERE body <> '' AND starts_with(ltrim(b, ' :،,-–' || chr(9)), body) AND {_words_sql('body')} >= 4
"""

QUERIES = {
    "proposals": Query(proposals, _PROPOSALS), "spans_bracketed": Query(spans_bracketed, _BRACKETED), "spans_introduced": Query(spans_introduced, _INTRODUCED), "spans_merged": Query(spans_merged, _MERGED),
    "detect_pii": Query(detect_pii, _PRIVATE), "detect_flags": Query(detect_flags, _FLAGS), "dedup_quotes": Query(dedup_quotes, _DEDUP),
    "cap_quotes": Query(cap_quotes, f"WITH q AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY start) AS k, count(*) OVER (PARTITION BY id) > 5 AS truncated FROM ({_LINES})) SELECT truncated, count(*) AS quotes, count(DISTINCT id) AS texts FROM (SELECT DISTINCT id, quoted, truncated FROM q WHERE k <= 5) GROUP BY truncated"),
    "relocated": Query(relocated, _RELOCATED),
    "receipt_token": Query(receipt_token, "SELECT item_id, text FROM benchmark"),
    "matn_start": Query(matn_start, _MATN),
}
