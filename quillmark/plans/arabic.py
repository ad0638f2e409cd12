"""Arabic rules over whole tables: Latin texts in Arabic letters, in both engines, so that letters carry marks.

Vowels become vowel signs, doubling, silence or long vowels, consonants become letters, some of them with several forms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import orthography as O
from ..operators import alignment as A
from ..operators import extraction as E
from ..operators import messages as G
from ..operators import validation as P
from ..operators.extraction import places
from .common import Query, spread, table

LATIN = "abcdefghijklmnopqrstuvwxyzéèàçêñü"
ARABIC = "َبكدِغأهيجقلمنوؤإرستُةىّئْآٱزضظعص"


def arabised(text: Column) -> Column:
    return F.translate(F.lower(text), LATIN, ARABIC)


def arabised_sql(x: str) -> str:
    return f"translate(lower({x}), '{LATIN}', '{ARABIC}')"


def blocks_sql(name: str, pairs: str) -> str:
    """Common tables down to ``name`` (id, i, j, n): the matching blocks of lists a and b of ``pairs`` (id, a, b), found by
    the longest common run, the earliest of equal ones, and then to its left and right; neighbouring blocks are one."""
    none = "'i': NULL, 'j': NULL, 'n': NULL"
    return f"""
{name}_same AS (SELECT id, i, j FROM (SELECT id, a, b, unnest(range(0, len(a))) AS i FROM {pairs}), LATERAL (SELECT unnest(range(0, len(b))) AS j) WHERE a[i + 1] = b[j + 1]),
{name}_runs AS MATERIALIZED (SELECT id, i, j, count(*) OVER (PARTITION BY id, i - j, g ORDER BY i DESC) AS n FROM (SELECT id, i, j, i - row_number() OVER (PARTITION BY id, i - j ORDER BY i) AS g FROM {name}_same)),
{name}_cut AS (
    SELECT id, 0 AS alo, len(a) AS ahi, 0 AS blo, len(b) AS bhi, CAST(NULL AS BIGINT) AS i, CAST(NULL AS BIGINT) AS j, CAST(NULL AS BIGINT) AS n FROM {pairs}
    UNION ALL
    SELECT id, s.alo, s.ahi, s.blo, s.bhi, s.i, s.j, s.n FROM (
        SELECT c.id, c.alo, c.ahi, c.blo, c.bhi, min({{'k': -least(r.n, c.ahi - r.i, c.bhi - r.j), 'i': r.i, 'j': r.j}}) AS m
        FROM (SELECT * FROM {name}_cut WHERE n IS NULL) AS c JOIN {name}_runs AS r ON r.id = c.id AND r.i >= c.alo AND r.i < c.ahi AND r.j >= c.blo AND r.j < c.bhi GROUP BY ALL),
    LATERAL (SELECT unnest([{{'alo': alo, 'ahi': m.i, 'blo': blo, 'bhi': m.j, {none}}}, {{'alo': m.i - m.k, 'ahi': ahi, 'blo': m.j - m.k, 'bhi': bhi, {none}}}, {{'alo': alo, 'ahi': ahi, 'blo': blo, 'bhi': bhi, 'i': m.i, 'j': m.j, 'n': -m.k}}], recursive := true)) AS s(alo, ahi, blo, bhi, i, j, n)),
{name}_found AS (SELECT id, i, j, n, coalesce(lag(i + n) OVER w = i AND lag(j + n) OVER w = j, false) AS goes_on FROM {name}_cut WHERE n IS NOT NULL WINDOW w AS (PARTITION BY id ORDER BY i)),
{name}_whole AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY i) AS g FROM {name}_found),
{name} AS (SELECT id, min(i) AS i, min(j) AS j, CAST(sum(n) AS BIGINT) AS n FROM {name}_whole GROUP BY id, g)"""


def opcodes_sql(name: str, blocks: str, pairs: str) -> str:
    """A common table ``name`` (id, op, i, i2, j, j2) of stretches between and in blocks, and ``name``_ratio (id, ratio)."""
    return f"""
{name}_all AS (SELECT id, i, j, n FROM {blocks} UNION ALL SELECT id, len(a), len(b), 0 FROM {pairs}),
{name}_gaps AS (SELECT id, i, j, n, coalesce(lag(i + n) OVER w, 0) AS pi, coalesce(lag(j + n) OVER w, 0) AS pj FROM {name}_all WINDOW w AS (PARTITION BY id ORDER BY i, j, n)),
{name} AS (
    SELECT id, CASE WHEN pi < i AND pj < j THEN 'replace' WHEN pi < i THEN 'delete' ELSE 'insert' END AS op, pi AS i, i AS i2, pj AS j, j AS j2 FROM {name}_gaps WHERE pi < i OR pj < j
    UNION ALL SELECT id, 'equal', i, i + n, j, j + n FROM {name}_all WHERE n > 0),
{name}_ratio AS (SELECT p.id, CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE 2.0 * coalesce(sum(n), 0) / (len(a) + len(b)) END AS ratio FROM {pairs} AS p LEFT JOIN {blocks} AS k ON k.id = p.id GROUP BY p.id, len(a), len(b))"""


def _range(r: Column) -> Column:
    return F.array_join(r.cast("array<string>"), "-")


def _ranges(r: Column) -> Column:
    return F.array_join(F.transform(r, _range), ",")


def told(ops: Column) -> Column:
    """Stretches as text."""
    one = lambda o: F.concat_ws(" ", o["op"], *(_range(o[n]) for n in A._SIDES), F.concat(F.lit("("), _ranges(o["quote_letters"]), F.lit("|"), _ranges(o["source_letters"]), F.lit(")")))
    return F.array_join(F.transform(ops, one), "; ")


def word_diff(spark: SparkSession, d: str) -> DataFrame:
    """Each item with some words changed, some left out, and the next item's first words added: against the item itself."""
    items = table(spark, d, "benchmark").where("text is not null").select(F.col("item_id").alias("id"), "text", O.tokens(F.col("text"), False).alias("s"))
    after = items.select((F.col("id") - 1).alias("id"), F.slice("s", F.lit(1), F.lit(3)).alias("more"))
    n = (F.col("id") % 7).cast("int")
    changed = F.transform("s", lambda t, k: F.when(k % 7 == n, F.concat(F.substring(t["strict"], 2, 1), F.substring(t["strict"], 1, 1), F.substring(t["strict"], 3, 1000))).when(k % 11 != n, t["strict"]))
    words = F.concat(F.array_compact(changed), F.coalesce(F.transform("more", lambda t: t["strict"]), F.array().cast("array<string>")))
    rows = items.join(after, "id", "left").select("id", "text", "s", F.array_join(words, " ").alias("quoted"))
    part = lambda w: F.struct(w["strict"].alias("strict"), w["start"].cast("int").alias("start"), w["end"].cast("int").alias("end"))
    rows = rows.select("id", "text", "quoted", F.transform("s", part).alias("s"), F.transform(O.tokens(F.col("quoted"), False), part).alias("q")).repartition(spark.sparkContext.defaultParallelism, "id")
    ops = rows.select("id", A.word_ops(F.col("quoted"), F.col("q"), F.col("text"), F.col("s")).alias("ops"))
    return ops.select("id", told(F.col("ops")).alias("ops"))


def _between(spans: str, a: str, b: str) -> str:
    """SQL for where words a to b stand, ends of spans as a list of {s, e}."""
    return f"CASE WHEN {a} < {b} THEN {spans}[{a} + 1].s || '-' || {spans}[{b}].e WHEN {a} > 0 THEN {spans}[{a}].e || '-' || {spans}[{a}].e WHEN len({spans}) > 0 THEN {spans}[1].s || '-' || {spans}[1].s ELSE '-1--1' END"


def _spans(text: str) -> str:
    """SQL for the Latin words of a text and their places, as lists."""
    p = r"'[\p{L}\p{N}]+'"
    m, g = f"regexp_extract_all({text}, {p})", f"regexp_split_to_array({text}, {p})"
    start = f"list_sum([length(x) FOR x IN {g}[1:k]]) + coalesce(list_sum([length(x) FOR x IN {m}[1:k - 1]]), 0)"
    return f"[{{'w': {m}[k], 's': CAST({start} AS BIGINT), 'e': CAST({start} + length({m}[k]) AS BIGINT)}} FOR k IN range(1, len({m}) + 1)]"


_WORD_DIFF = f"""
WITH RECURSIVE src AS (SELECT item_id AS id, text, {_spans('text')} AS s FROM benchmark WHERE text IS NOT NULL),
made AS (SELECT x.id, x.text, x.s, array_to_string(list_filter([CASE WHEN (k - 1) % 7 = x.id % 7 THEN x.s[k].w[2] || x.s[k].w[1] || x.s[k].w[3:] WHEN (k - 1) % 11 <> x.id % 7 THEN x.s[k].w END FOR k IN range(1, len(x.s) + 1)], lambda w: w IS NOT NULL)
    || coalesce([t.w FOR t IN y.s[1:3]], []), ' ') AS quoted FROM src AS x LEFT JOIN src AS y ON y.id - 1 = x.id),
two AS MATERIALIZED (SELECT id, text, s, quoted, {_spans('quoted')} AS q FROM made),
pairs AS MATERIALIZED (SELECT id, [t.w FOR t IN q] AS a, [t.w FOR t IN s] AS b FROM two),
{blocks_sql('word_blocks', 'pairs')}, {opcodes_sql('word_ops', 'word_blocks', 'pairs')},
single AS MATERIALIZED (SELECT row_number() OVER () AS id, word_ops.id AS item, i, j, q[i + 1] AS qw, s[j + 1] AS sw FROM word_ops JOIN two USING (id) WHERE op = 'replace' AND i2 - i = 1 AND j2 - j = 1),
chars AS MATERIALIZED (SELECT id, string_split(qw.w, '') AS a, string_split(sw.w, '') AS b FROM single),
{blocks_sql('char_blocks', 'chars')}, {opcodes_sql('char_ops', 'char_blocks', 'chars')},
marked AS (
    SELECT item AS id, single.i, coalesce(string_agg((qw.s + c.i) || '-' || (qw.s + c.i2), ',' ORDER BY c.i) FILTER (c.i < c.i2), '') AS ql, coalesce(string_agg((sw.s + c.j) || '-' || (sw.s + c.j2), ',' ORDER BY c.j) FILTER (c.j < c.j2), '') AS sl
    FROM single JOIN char_ops_ratio AS r USING (id) JOIN char_ops AS c ON c.id = single.id WHERE ratio >= 0.5 AND c.op <> 'equal' GROUP BY ALL),
said AS (
    SELECT o.id, o.i, o.j, op || ' ' || o.i || '-' || i2 || ' ' || j || '-' || j2 || ' ' || {_between('q', 'o.i', 'i2')} || ' ' || {_between('s', 'j', 'j2')} || ' (' || coalesce(ql, '') || '|' || coalesce(sl, '') || ')' AS said
    FROM word_ops AS o JOIN two ON two.id = o.id LEFT JOIN marked AS m ON m.id = o.id AND m.i = o.i AND o.op = 'replace' AND o.i2 - o.i = 1 AND o.j2 - o.j = 1)
SELECT id, string_agg(said, '; ' ORDER BY i, j) AS ops FROM said GROUP BY id
"""


def _neighbours(spark: SparkSession, d: str) -> DataFrame:
    """(id, quote, source): neighbouring words of conversations in Arabic letters, each pair once."""
    turns = spread(table(spark, d, "conversations").where("text is not null").select("text"))
    words = turns.select(F.regexp_extract_all(arabised(F.col("text")), F.lit(f"[{ARABIC}]+"), F.lit(0)).alias("w"))
    pairs = F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), F.size("w")).alias("b"))
    return words.where("size(w) > 1").select(F.explode(pairs).alias("p")).where("p.b is not null").select(F.col("p.a").alias("quote"), F.col("p.b").alias("source")).distinct()


_NEIGHBOURS = f"""words AS (SELECT regexp_extract_all({arabised_sql('text')}, '[{ARABIC}]+') AS w FROM conversations WHERE text IS NOT NULL),
neighbours AS MATERIALIZED (SELECT row_number() OVER () AS id, quote, source FROM (SELECT DISTINCT w[k] AS quote, w[k + 1] AS source FROM (SELECT w, unnest(range(1, len(w))) AS k FROM words)))"""


def letter_diff(spark: SparkSession, d: str) -> DataFrame:
    """The letters, with their marks, in which neighbouring words differ."""
    rows = _neighbours(spark, d).select("quote", "source", A.letter_diff(F.col("quote"), F.col("source")).alias("x"))
    return rows.select("quote", "source", _ranges(F.col("x.quote")).alias("quote_letters"), _ranges(F.col("x.source")).alias("source_letters"))


_BASES = "".join(c for c in ARABIC if c not in O.VOWELS + O.SHADDA + O.SUKUN)


def _clusters(word: str) -> str:
    """SQL for the letters of a word and the places of them and their marks."""
    p = f"'[{_BASES}][^{_BASES}]*'"
    m, g = f"regexp_extract_all({word}, {p})", f"regexp_split_to_array({word}, {p})"
    start = f"list_sum([length(x) FOR x IN {g}[1:k]]) + coalesce(list_sum([length(x) FOR x IN {m}[1:k - 1]]), 0)"
    return f"[{{'w': {m}[k], 's': CAST({start} AS BIGINT), 'e': CAST({start} + length({m}[k]) AS BIGINT)}} FOR k IN range(1, len({m}) + 1)]"


_LETTER_DIFF = f"""
WITH RECURSIVE {_NEIGHBOURS}, two AS MATERIALIZED (SELECT id, quote, source, {_clusters('quote')} AS q, {_clusters('source')} AS s FROM neighbours),
pairs AS MATERIALIZED (SELECT id, [translate(t.w[1], 'ٱ', 'ا') FOR t IN q] AS a, [translate(t.w[1], 'ٱ', 'ا') FOR t IN s] AS b FROM two WHERE len(q) > 0 AND len(s) > 0),
{blocks_sql('char_blocks', 'pairs')}, {opcodes_sql('char_ops', 'char_blocks', 'pairs')},
marked AS (
    SELECT o.id, string_agg(q[i + 1].s || '-' || q[i2].e, ',' ORDER BY i) FILTER (i < i2) AS ql, string_agg(s[j + 1].s || '-' || s[j2].e, ',' ORDER BY j) FILTER (j < j2) AS sl
    FROM char_ops AS o JOIN char_ops_ratio AS r USING (id) JOIN two ON two.id = o.id WHERE op <> 'equal' AND ratio >= 0.5 GROUP BY o.id)
SELECT quote, source, coalesce(ql, '') AS quote_letters, coalesce(sl, '') AS source_letters FROM two LEFT JOIN marked USING (id)
"""

def _vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """(w): the distinct words of documents in small letters.

    Counted rather than ``distinct``, and the count is used: Spark merges a distinct into one that follows, and what is
    made of a word would be made at each of its places.
    """
    words = spread(table(spark, d, "documents").where("text is not null").select("text")).select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("w"))
    return words.groupBy("w").agg(F.count("*").alias("n")).where("n > 0").select("w")


#: Of a word, by its length: what is written as a quotation and as its source.
_WRITTEN = {0: ("e", ""), 1: ("", ""), 2: ("eu", "ue")}


def vowel_diffs(spark: SparkSession, d: str) -> DataFrame:
    """Distinct words of documents with some vowels left out or changed, against themselves; the conflicts alone, too."""
    words = _vocabulary(spark, d)
    n = F.length("w")
    user = F.translate("w", *_WRITTEN[1])
    for k, (a, b) in _WRITTEN.items():
        user = F.when(n % 3 == k, F.translate("w", a, b)).otherwise(user) if a else user
    rows = words.select(arabised(user).alias("quote"), arabised(F.when(n % 5 == 0, F.translate("w", "u", "x")).otherwise(F.col("w"))).alias("source"), (n % 2 == 0).alias("last")).distinct()
    found = O.compare_vowels(F.col("quote"), F.col("source"), F.col("last"))
    said = lambda x: F.array_join(F.transform(x, lambda f: F.concat_ws(" ", f["kind"], *(F.concat_ws("-", f[a + "_start"].cast("string"), f[a + "_end"].cast("string")) for a in "ur"))), ";")
    return rows.select("quote", "source", "last", said(found).alias("found"), said(O.vowel_conflicts(F.col("quote"), F.col("source"))).alias("conflicts"))


def _skeleton(word: str) -> str:
    p = f"'[{_BASES}][^{_BASES}]*'"
    m, g, v = f"regexp_extract_all({word}, {p})", f"regexp_split_to_array({word}, {p})", f"regexp_extract_all(m[k][2:], '[{O.VOWELS}]')"
    start = "list_sum([length(x) FOR x IN g[1:k]]) + coalesce(list_sum([length(x) FOR x IN m[1:k - 1]]), 0)"
    one = f"{{'l': translate(m[k][1], '{O.CARRIERS[0]}', '{O.CARRIERS[1]}'), 'v': CASE WHEN len({v}) > 0 THEN {v}[-1] WHEN contains(m[k][2:], '{O.SUKUN}') THEN '' END, 'd': contains(m[k][2:], '{O.SHADDA}'), 's': CAST({start} AS BIGINT), 'e': CAST({start} + length(m[k]) AS BIGINT)}}"
    return f"(SELECT [{one} FOR k IN range(1, len(m) + 1)] FROM (SELECT {m} AS m, {g} AS g))"


_KIND = """CASE WHEN a.v IS NULL AND NOT a.d THEN CASE WHEN coalesce(b.v <> '', false) OR b.d THEN 'missing' END WHEN a.v IS NULL THEN CASE WHEN NOT b.d THEN 'conflict' WHEN coalesce(b.v <> '', false) THEN 'missing' END
    WHEN a.v = '' AND {last} AND k = n AND coalesce(b.v <> '', false) THEN 'waqf' WHEN coalesce(a.v <> b.v, false) OR (b.v IS NULL AND a.v <> '') OR (a.d AND NOT b.d) THEN 'conflict' WHEN NOT a.d AND b.d THEN 'missing' END"""
_SAID = "string_agg({kind} || ' ' || a.s || '-' || a.e || ' ' || b.s || '-' || b.e, ';' ORDER BY k) FILTER ({where})"
_VOWEL_DIFFS = f"""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents WHERE text IS NOT NULL),
rows AS (SELECT DISTINCT {arabised_sql("CASE WHEN length(w) % 3 = 0 THEN replace(w, 'e', '') WHEN length(w) % 3 = 2 THEN translate(w, 'eu', 'ue') ELSE w END")} AS quote, {arabised_sql("CASE WHEN length(w) % 5 = 0 THEN translate(w, 'u', 'x') ELSE w END")} AS source, length(w) % 2 = 0 AS last FROM w),
two AS MATERIALIZED (SELECT row_number() OVER () AS id, quote, source, last, {_skeleton('quote')} AS q, {_skeleton('source')} AS s FROM rows),
fit AS (SELECT id, last, q, s, len(q) AS n FROM two WHERE len(q) > 0 AND [x.l FOR x IN q] = [x.l FOR x IN s]),
each AS (SELECT id, last, n, k, q[k] AS a, s[k] AS b FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM fit)),
judged AS (SELECT *, {_KIND.format(last='last')} AS kind, {_KIND.format(last='false')} AS bare FROM each),
told AS (SELECT id, coalesce({_SAID.format(kind='kind', where='kind IS NOT NULL')}, '') AS found, coalesce({_SAID.format(kind='bare', where="bare = 'conflict'")}, '') AS conflicts FROM judged GROUP BY id)
SELECT quote, source, last, found, coalesce(conflicts, '') AS conflicts FROM two LEFT JOIN told USING (id)
"""

def message_runs(spark: SparkSession, d: str) -> DataFrame:
    """Conversations in Arabic letters: marks on one letter and on one vowel sign, widened to whole letters."""
    texts = spread(table(spark, d, "conversations").where("text is not null")).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), arabised(F.col("text")).alias("text"))
    marks = texts.select("id", F.explode(places(F.col("text"), "[َك]")).alias("m")).select("id", "m.start", "m.end")
    return G.marked_runs(texts, marks).select("id", F.col("ord").cast("long").alias("ord"), "marked", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


_SIGNS = O.VOWELS + O.SHADDA + O.SUKUN
_MESSAGE_RUNS = f"""
WITH t AS (SELECT conv_id * 1000 + turn AS id, {arabised_sql('text')} AS text FROM conversations WHERE text IS NOT NULL),
c AS (SELECT id, regexp_extract_all(text, '(?s).[{_SIGNS}]*') AS c FROM t),
k AS (SELECT id, k, c[k] AS c, regexp_matches(c[k], '^ك|َ') AS marked, regexp_matches(c[k], '^[كَ]') AS opens, regexp_matches(c[k], '^ك$|َ$') AS closes FROM (SELECT id, c, unnest(range(1, len(c) + 1)) AS k FROM c)),
b AS (SELECT *, CASE WHEN lag(marked) OVER w = marked AND (NOT marked OR (opens AND lag(closes) OVER w)) THEN 0 ELSE 1 END AS fresh, sum(length(c)) OVER w AS upto FROM k WINDOW w AS (PARTITION BY id ORDER BY k)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY k) AS run FROM b)
SELECT id, run - 1 AS ord, bool_or(marked) AS marked, CAST(min(upto - length(c)) AS BIGINT) AS start, CAST(max(upto) AS BIGINT) AS "end" FROM g GROUP BY id, run
"""


def messages(spark: SparkSession, d: str) -> DataFrame:
    """Turns of a conversation, their words as blocks, packed into messages of 150 units."""
    turns = table(spark, d, "conversations").where("text is not null").select(F.col("conv_id").alias("id"), F.col("turn").alias("grp"), F.posexplode(F.regexp_extract_all("text", F.lit("[^ \n\t]+"), F.lit(0))).alias("ord", "w"))
    blocks = turns.select("id", "grp", "ord", F.array(F.struct(F.col("w").alias("text"), (F.col("ord") % 5 == 0).alias("marked"))).alias("runs"), F.lit("").alias("wrap"), F.lit("").alias("prefix"))
    return G.messages(G.packed(blocks, 150)).select("id", F.col("message").cast("long").alias("message"), "html")


_MESSAGES = r"""
WITH RECURSIVE w AS (SELECT conv_id AS id, turn, regexp_extract_all(text, '[^ \n\t]+') AS w FROM conversations WHERE text IS NOT NULL),
b AS (SELECT id, turn, k, replace(replace(replace(w[k], '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS h FROM (SELECT *, unnest(range(1, len(w) + 1)) AS k FROM w)),
s AS (SELECT id, turn, k, CASE WHEN (k - 1) % 5 = 0 THEN '<b>' || h || '</b>' ELSE h END AS h FROM b),
sized AS (SELECT *, length(h) + length(regexp_replace(h, '[^\x{10000}-\x{10FFFF}]', '', 'g')) AS n FROM s),
rows AS MATERIALIZED (SELECT id, h, n, k = 1 AS opens, CAST(sum(n) OVER g + count(*) OVER g - 1 AS BIGINT) AS whole, row_number() OVER (PARTITION BY id ORDER BY turn, k) AS r FROM sized WINDOW g AS (PARTITION BY id, turn)),
walk AS (
    SELECT id, r, n AS used, CAST(0 AS BIGINT) AS message, h AS html FROM rows WHERE r = 1
    UNION ALL SELECT x.id, x.r, CASE WHEN fresh THEN x.n ELSE used + gap + x.n END, message + CASE WHEN fresh THEN 1 ELSE 0 END, CASE WHEN fresh THEN x.h ELSE repeat(chr(10), gap) || x.h END
    FROM (SELECT rows.id, rows.r, rows.n, rows.h, used, message, CASE WHEN opens AND whole <= 150 THEN 2 ELSE 1 END AS gap, CASE WHEN opens THEN whole > 150 OR used + 2 + whole > 150 ELSE whole > 150 AND used + 1 + n > 150 END AS fresh FROM walk JOIN rows ON rows.id = walk.id AND rows.r = walk.r + 1) AS x)
SELECT id, message, string_agg(html, '' ORDER BY r) AS html FROM walk GROUP BY id, message
"""

def _turns(spark: SparkSession, d: str) -> DataFrame:
    """(id, text): conversations in Arabic letters."""
    t = spread(table(spark, d, "conversations").where("text is not null"))
    return t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), arabised(F.col("text")).alias("text"))


_TURNS = f"turns AS (SELECT conv_id * 1000 + turn AS id, {arabised_sql('text')} AS text FROM conversations WHERE text IS NOT NULL)"
_TOKEN = f"'[{_BASES}](?:[{_SIGNS}]*[{_BASES}])*'"


def _form_sql(x: str, pair: tuple[str, str]) -> str:
    return f"translate(regexp_replace({x}, '[{_SIGNS}]', '', 'g'), '{pair[0]}', '{pair[1]}')"


def ar_fold(spark: SparkSession, d: str) -> DataFrame:
    """Both tiers of conversations in Arabic letters."""
    t = _turns(spark, d)
    return t.select("id", O.joined(O.loose_tokens(F.col("text"))).alias("loose"), O.joined(O.strict_tokens(F.col("text"))).alias("strict"))


_AR_FOLD = f"WITH {_TURNS}, w AS (SELECT id, regexp_extract_all(text, {_TOKEN}) AS w FROM turns) SELECT id, array_to_string([{_form_sql('x', O.LOOSE)} FOR x IN w], ' ') AS loose, array_to_string([{_form_sql('x', O.STRICT)} FOR x IN w], ' ') AS strict FROM w"

#: Letters and signs above or below them that make other letters.
_PARTS = ("aoiyeuxbcdfghjklmnpqrstvwz", "اويىٕٔٓبجدفغهزكلمنةقرستحشع")


def ar_compose(spark: SparkSession, d: str) -> DataFrame:
    """Conversations in letters that are composed with the signs after them."""
    t = spread(table(spark, d, "conversations").where("text is not null")).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.translate(F.lower("text"), *_PARTS).alias("text"))
    return t.select("id", O.joined(O.loose_tokens(F.col("text"))).alias("loose"), O.joined(O.strict_tokens(F.col("text"))).alias("strict"))


def _composed_sql(x: str) -> str:
    for pair, letter in O.COMPOSED:
        x = f"replace({x}, '{pair}', '{letter}')"
    return x


_HAMZAS = "ٕٔٓ"
_COMPOSED_LETTERS = "".join(c for c in _PARTS[1] if c not in _HAMZAS) + "".join(b for _, b in O.COMPOSED)
_AR_COMPOSE = f"""
WITH t AS (SELECT conv_id * 1000 + turn AS id, {_composed_sql(f"translate(lower(text), '{_PARTS[0]}', '{_PARTS[1]}')")} AS text FROM conversations WHERE text IS NOT NULL),
w AS (SELECT id, [regexp_replace(x, '[{_HAMZAS}]', '', 'g') FOR x IN regexp_extract_all(text, '[{_COMPOSED_LETTERS}](?:[{_HAMZAS}]*[{_COMPOSED_LETTERS}])*')] AS w FROM t)
SELECT id, array_to_string([translate(x, '{O.LOOSE[0]}', '{O.LOOSE[1]}') FOR x IN w], ' ') AS loose, array_to_string([translate(x, '{O.STRICT[0]}', '{O.STRICT[1]}') FOR x IN w], ' ') AS strict FROM w
"""


def ar_spans(spark: SparkSession, d: str) -> DataFrame:
    t = _turns(spark, d).select("id", F.posexplode(O.tokens(F.col("text"))).alias("pos", "t"))
    return t.select("id", F.col("pos").cast("long").alias("pos"), F.col("t.loose").alias("loose"), F.col("t.start").cast("long").alias("start"), F.col("t.end").cast("long").alias("end"))


_AR_SPANS = f"""
WITH {_TURNS}, m AS (SELECT id, regexp_extract_all(text, {_TOKEN}) AS m, regexp_split_to_array(text, {_TOKEN}) AS g FROM turns),
k AS (SELECT id, k, m[k] AS w, length(g[k]) AS gap FROM (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM m)),
p AS (SELECT *, CAST(sum(gap + length(w)) OVER (PARTITION BY id ORDER BY k) AS BIGINT) AS upto FROM k)
SELECT id, k - 1 AS pos, {_form_sql('w', O.LOOSE)} AS loose, upto - length(w) AS start, upto AS "end" FROM p
"""


def ar_bare_class(spark: SparkSession, d: str) -> DataFrame:
    """Words of documents against themselves with some forms of letters changed."""
    words = _vocabulary(spark, d)
    other = F.when(F.length("w") % 3 == 0, F.translate("w", "gvwh", "qhiv")).when(F.length("w") % 3 == 1, F.translate("w", "pyq", "oig")).otherwise(F.translate("w", "bd", "db"))
    rows = words.select(O.strict_form(arabised(F.col("w"))).alias("written"), O.strict_form(arabised(other)).alias("corpus")).distinct()
    return rows.select("written", "corpus", O.classify(F.col("written"), F.col("corpus")).alias("class"))


_AR_CLASS = f"""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents WHERE text IS NOT NULL),
p AS (SELECT DISTINCT {_form_sql(arabised_sql('w'), O.STRICT)} AS written, {_form_sql(arabised_sql("CASE length(w) % 3 WHEN 0 THEN translate(w, 'gvwh', 'qhiv') WHEN 1 THEN translate(w, 'pyq', 'oig') ELSE translate(w, 'bd', 'db') END"), O.STRICT)} AS corpus FROM w)
SELECT written, corpus, CASE WHEN written = corpus THEN 'equal' WHEN translate(written, '{O.BARE[0]}', '{O.BARE[1]}') <> translate(corpus, '{O.BARE[0]}', '{O.BARE[1]}') THEN 'other'
    WHEN len([k FOR k IN range(1, length(written) + 1) IF written[k] <> corpus[k] AND contains('{O.MARKED}', written[k])]) > 0 THEN 'swap' ELSE 'completion' END AS class FROM p
"""


def foreign_runs(spark: SparkSession, d: str) -> DataFrame:
    """What is foreign in conversations whose small letters alone are Arabic."""
    t = spread(table(spark, d, "conversations").where("text is not null")).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.translate("text", LATIN, ARABIC).alias("text"))
    runs = E.foreign_runs(F.col("text"))
    return t.select("id", F.array_join(F.transform(runs, lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))), ",").alias("runs"))


_FOREIGN_RUN = "[^\\p{Mn}\\p{Me}\\p{Cf}\\s.,،؛;:!?؟*_`>#\\-–—…\"''“”«»﴾﴿()\\[\\]{}/\\\\|~^+=<·•ﷺﷻ۞۝۩ـ" + O.LETTERS + O.PERSIAN[0] + "]+"
_FOREIGN = rf"""
WITH t AS (SELECT conv_id * 1000 + turn AS id, translate(text, '{LATIN}', '{ARABIC}') AS text FROM conversations WHERE text IS NOT NULL),
s AS (SELECT id, text, regexp_replace(regexp_replace(regexp_replace(text, '[(\[](\s*)[0-9](\s*)[)\]]', '   ', 'g'), '[(\[][0-9]{{2}}[)\]]', '    ', 'g'), '[(\[][0-9]{{3}}[)\]]', '     ', 'g') AS clean FROM t),
p AS (SELECT id, regexp_extract_all(text, {_TOKEN}) AS w, regexp_split_to_array(text, {_TOKEN}) AS g, length(text) AS n, regexp_extract_all(clean, 'FOREIGN') AS m, regexp_split_to_array(clean, 'FOREIGN') AS h FROM s),
r AS (SELECT id, w, length(g[1]) + length(w[1]) AS first, n - length(g[-1]) - length(w[-1]) AS last, [{{'s': list_sum([length(x) FOR x IN h[1:k]]) + coalesce(list_sum([length(x) FOR x IN m[1:k - 1]]), 0), 'n': length(m[k])}} FOR k IN range(1, len(m) + 1)] AS runs FROM p)
SELECT id, CASE WHEN len(w) > 1 THEN array_to_string([CAST(x.s AS BIGINT) || '-' || CAST(x.s + x.n AS BIGINT) FOR x IN runs IF x.s >= first AND x.s + x.n <= last], ',') END AS runs FROM r
""".replace("FOREIGN", _FOREIGN_RUN)


#: Phrases after a turn, and what they claim: books, chapter, verse.
_CLAIMS = (
    ("رواه البخاري ومسلم", "sahih_al-bukhari,sahih_muslim", None, None), ("متفق عليه", "sahih_al-bukhari,sahih_muslim", None, None), ("see Muslim", "sahih_muslim", None, None), ("Malik said", None, None, None),
    ("Muwatta of Malik", "maliks_muwataa", None, None), ("(Quran 2:255)", "", 2, 255), ("12:5", "", 12, 5), ("Q 115:1", None, None, None), ("nothing", None, None, None),
)


def _cleaned(text: Column) -> Column:
    """Words of a text in Arabic letters alone."""
    return F.trim(F.regexp_replace(text, f"[^{O.ranges_of(ARABIC)}]+", " "))


def claimed_source(spark: SparkSession, d: str) -> DataFrame:
    """What the phrase after each turn claims."""
    t = _turns(spark, d).select("id", F.concat(_cleaned(F.col("text")), F.lit(" "), F.get(F.array(*(F.lit(c[0]) for c in _CLAIMS)), (F.col("id") % 9).cast("int"))).alias("text"))
    c = E.claimed_source(F.col("text"))
    return t.select("id", F.array_join(c["books"], ",").alias("books"), c["surah"].alias("surah"), c["ayah"].alias("ayah"))


def _value(x: object) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else f"'{x}'"


_CLAIMED = f"WITH {_TURNS}, c(k, books, surah, ayah) AS (VALUES {', '.join(f'({k}, {_value(c[1])}, {_value(c[2])}, {_value(c[3])})' for k, c in enumerate(_CLAIMS))}) SELECT id, books, surah, ayah FROM turns JOIN c ON k = id % 9"


def _spanned(make, find):
    def run(spark: SparkSession, d: str) -> DataFrame:
        t = _turns(spark, d).select("id", _cleaned(F.col("text")).alias("a")).where(F.col("a").rlike(f"^[{_BASES}]"))
        s = find(t.select("id", make(F.col("id"), F.col("a")).alias("text")))
        return s.select("id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "kind")

    return run


_CLEAN = f"WITH {_TURNS}, c AS (SELECT id, trim(regexp_replace(text, '[^{ARABIC}]+', ' ', 'g')) AS a FROM turns), t AS (SELECT id, a, length(a) AS n, len(regexp_extract_all(a, {_TOKEN})) AS w FROM c WHERE regexp_matches(a, '^[{_BASES}]'))"
_text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
spans_tagged = _spanned(lambda i, a: F.when(i % 2 == 0, _text("x <aya_start> «", a, "» <aya_end> y")).otherwise(_text(a, " <hadith_start>", a, "<hadith_end>")), E.tagged)
_TAGGED = f"""{_CLEAN} SELECT id, CASE id % 2 WHEN 0 THEN 15 ELSE n + 15 END AS start, CASE id % 2 WHEN 0 THEN 15 ELSE n + 15 END + n AS "end", CASE id % 2 WHEN 0 THEN 'quran' ELSE 'hadith_matn' END AS kind FROM t"""
spans_trailed = _spanned(lambda i, a: _text("قلت. ", a, "، رواه مسلم"), E.trailed)
_TRAILED = f"""{_CLEAN} SELECT id, 5 AS start, 5 + n AS "end", 'hadith_matn' AS kind FROM t WHERE w >= 3"""
spans_after = _spanned(lambda i, a: F.when(i % 2 == 0, _text("وقال تعالى: ", a, ". نعم")).otherwise(_text("قال رسول الله صلى الله عليه وسلم ", a, "؟ لا")), E.introduced)
_AFTER = f"""{_CLEAN} SELECT id, CASE id % 2 WHEN 0 THEN 12 ELSE 33 END AS start, CASE id % 2 WHEN 0 THEN 12 ELSE 33 END + n AS "end", CASE id % 2 WHEN 0 THEN 'quran' ELSE 'hadith_matn' END AS kind FROM t WHERE w >= 3"""


def ref_possible(spark: SparkSession, d: str) -> DataFrame:
    """References made of the numbers of orders."""
    o = table(spark, d, "orders").select("o_orderkey", *(F.expr(x).cast("int").alias(n) for n, x in _REFERENCE.items()))
    return o.select("o_orderkey", P.possible_reference(F.col("surah"), F.col("ayah"), F.col("ayah_to"), F.col("verses")).alias("possible"))


_REFERENCE = {"surah": "o_orderkey % 120", "ayah": "o_custkey % 90", "ayah_to": "CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 100 END", "verses": "CASE WHEN o_orderkey % 120 BETWEEN 1 AND 114 THEN o_orderkey % 61 + 3 END"}
_POSSIBLE = f"SELECT o_orderkey, verses IS NOT NULL AND ayah BETWEEN 1 AND coalesce(verses, 0) AND (ayah_to IS NULL OR ayah_to BETWEEN ayah AND coalesce(verses, 0)) AS possible FROM (SELECT o_orderkey, {', '.join(f'{x} AS {n}' for n, x in _REFERENCE.items())} FROM orders)"

QUERIES = {
    "ar_fold": Query(ar_fold, _AR_FOLD), "ar_compose": Query(ar_compose, _AR_COMPOSE), "ar_spans": Query(ar_spans, _AR_SPANS), "ar_bare_class": Query(ar_bare_class, _AR_CLASS), "foreign_runs": Query(foreign_runs, _FOREIGN), "claimed_source": Query(claimed_source, _CLAIMED),
    "spans_tagged": Query(spans_tagged, _TAGGED), "spans_trailed": Query(spans_trailed, _TRAILED), "spans_after_introducers": Query(spans_after, _AFTER), "ref_possible": Query(ref_possible, _POSSIBLE),
    "message_runs": Query(message_runs, _MESSAGE_RUNS), "messages": Query(messages, _MESSAGES), "vowel_diffs": Query(vowel_diffs, _VOWEL_DIFFS), "word_diff": Query(word_diff, _WORD_DIFF), "letter_diff": Query(letter_diff, _LETTER_DIFF),
}
