"""Index tables over a corpus of records: token streams, postings, term statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import orthography as O

# BM25, and the shares of documents above which a word or a gram counts as a stop term.
K1, B = 1.2, 0.75
WORD_CUTOFF, GRAM_CUTOFF = 0.20, 0.30


def streams(rows: DataFrame, id_col: str, text_col: str = "text", arabic: bool = False) -> DataFrame:
    """(id, loose, strict, text): token arrays of each row, and its text; null texts have no tokens.

    Who joins only few rows takes the text along and finds the tokens afterwards, see ``tokens_of``.
    """
    text = F.col(text_col)
    return rows.select(F.col(id_col).alias("id"), O.loose_tokens(text, arabic).alias("loose"), O.strict_tokens(text, arabic).alias("strict"), text.alias("text"))


def lines(rows: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, loose, strict, text, n) of Latin texts: the tokens of each as one string, and their number. A table of these is written
    at a fraction of what lists of tokens cost. The pattern is tried once; the loose tokens are the strict ones folded, place by place."""
    found = rows.select(F.col(id_col).alias("id"), O.strict_tokens(F.col(text_col), False).alias("found"), F.col(text_col).alias("text"))
    strict = found.select("id", O.joined(F.col("found")).alias("strict"), "text", F.size("found").alias("n"))
    return strict.select("id", O.latin_loose(F.col("strict")).alias("loose"), "strict", "text", "n")


def tokenised(lines_: DataFrame) -> DataFrame:
    """The token arrays of ``lines``: what ``streams`` gives."""
    return lines_.select("id", O.words(F.col("loose")).alias("loose"), O.words(F.col("strict")).alias("strict"), "text")


#: Rows up to which a side of a join is sent to every executor: some tens of megabytes of hashes and places.
BROADCAST_ROWS = 500_000


def bounded(df: DataFrame) -> DataFrame:
    """Marked for broadcast if it is counted to have at most BROADCAST_ROWS rows; otherwise left to an ordinary join."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def texts_of(stream: DataFrame) -> DataFrame:
    """A stream without its tokens, where it has the texts to find them again."""
    return stream.select("id", "text") if "text" in stream.columns else stream.select("id", "loose", "strict")


def tokens_of(rows: DataFrame, arabic: bool = False) -> DataFrame:
    """The tokens of joined texts; they are found after the join, in the rows that it left."""
    if "text" not in rows.columns:
        return rows
    return rows.withColumns({"loose": O.loose_tokens(F.col("text"), arabic), "strict": O.strict_tokens(F.col("text"), arabic)}).drop("text")


def postings(stream: DataFrame, offset: Column | None = None) -> DataFrame:
    """(token, id, pos, strict) of each indexed place; places before ``offset`` are shown but can't be searched."""
    rows = stream.select("id", F.posexplode(F.arrays_zip("loose", "strict")).alias("pos", "t"), (F.lit(0) if offset is None else offset).alias("o"))
    return rows.where("pos >= o").select(F.col("t.loose").alias("token"), "id", "pos", F.col("t.strict").alias("strict"))


def term_tables(terms: DataFrame, cutoff: float | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From (id, terms): (id, term, tf), (term, df, idf) and (id, len); terms of too many documents get idf 0.

    The number of documents is joined as a table of one row, so that nothing waits for an action.
    """
    lengths = terms.select("id", F.size("terms").alias("len"))
    tf = terms.select("id", F.explode("terms").alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    total = terms.agg(F.count("*").alias("n"))
    df = tf.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total))
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    if cutoff is not None:
        idf = F.when(F.col("df") > cutoff * F.col("n"), 0.0).otherwise(idf)
    return tf, df.select("term", "df", idf.alias("idf")), lengths


def bm25(queries: DataFrame, terms: DataFrame | None, cutoff: float | None = WORD_CUTOFF, normalised: bool = False, tables: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """(q, id, score) of ``queries`` (q, terms) over documents ``terms`` (id, terms); a query's terms count once.

    ``normalised``: divided by the idf of the query's known terms. Stop terms are gone before the join; both sides meet
    on the term, the query side being broadcast only where Spark's own threshold allows it. ``tables``: those of
    ``term_tables``, where they are kept; then queries are look-ups.
    """
    tf, stats, lengths = tables or term_tables(terms, cutoff)
    average = lengths.agg(F.avg("len").alias("avg_len"))
    wanted = queries.select("q", F.explode(F.array_distinct("terms")).alias("term"))
    known = stats.where("idf > 0")
    asked = wanted.join(bounded(known) if normalised else known, "term")
    normed = lengths.crossJoin(F.broadcast(average)).select("id", (K1 * (1 - B + B * F.col("len") / F.col("avg_len"))).alias("norm"))
    met = tf.join(bounded(asked), "term") if tables else asked.join(tf, "term")  # kept tables are many times the queries: they stay where they are
    hits = met.join(normed, "id")
    scores = hits.groupBy("q", "id").agg(F.sum(F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + F.col("norm"))).alias("score"))
    if not normalised:
        return scores
    mass = asked.groupBy("q").agg(F.sum("idf").alias("mass"))
    return scores.join(mass, "q").select("q", "id", (F.col("score") / F.col("mass")).alias("score"))


def words_and_pairs(asked: DataFrame, docs: DataFrame, pairs: float = 0.2) -> DataFrame:
    """(q, id, score) of (q, t) over (id, t): words and word pairs as one channel each, relative to the query's idf mass, and added.

    Both channels go through one pass: a term with a space is a pair, and words have none. What a text's own terms weigh
    comes with its hits, from rows of the index that stand for no record, so texts are read, counted and joined once. If they
    are dealt by ``q``, nothing of theirs is shuffled.
    """
    terms = lambda t: F.concat(t, _pairs(t))
    tf = docs.select("id", F.size("t").alias("len"), F.explode(terms("t")).alias("term")).groupBy("id", "len", "term").agg(F.count("*").alias("tf"))
    size = docs.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("a1"), F.avg(F.greatest(F.size("t") - 1, F.lit(0))).alias("a2"))
    df = tf.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(size))
    known = df.select("term", F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    pair = F.col("term").contains(" ")
    relative = F.when(pair, B * (F.col("len") - 1) / F.col("a2")).otherwise(B * F.col("len") / F.col("a1"))
    normed = tf.crossJoin(F.broadcast(size)).select("id", "term", "tf", (K1 * (1 - B + relative)).alias("norm")).join(known, "term")
    hits = normed.select("term", F.lit(False).alias("own"), "id", (F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + F.col("norm"))).alias("part"))
    index = hits.unionByName(known.select("term", F.lit(True).alias("own"), F.lit(None).cast(docs.schema["id"].dataType).alias("id"), F.col("idf").alias("part"))).where("part > 0").withColumn("pair", pair)
    met = asked.select("q", F.explode(F.array_distinct(terms("t"))).alias("term")).join(bounded(index), "term")
    of = lambda second: F.sum(F.when(F.col("pair") == second, F.col("part")))
    sums = met.groupBy("q", "own", "id").agg(of(False).alias("words"), of(True).alias("pairs"))
    mass = lambda c: F.max(F.when(F.col("own"), F.col(c))).over(Window.partitionBy("q"))
    parts = sums.select("q", "own", "id", *(F.coalesce(weight * F.col(c) / mass(c), F.lit(0.0)).alias(c) for c, weight in (("words", 1 - pairs), ("pairs", pairs))))
    return parts.where("not own").select("q", "id", (F.col("words") + F.col("pairs")).alias("score"))


def _pairs(tokens: str) -> Column:
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(F.slice(tokens, F.lit(1), n), F.slice(tokens, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))


def top_k(scores: DataFrame, k: int = 50, decimals: int = 6) -> DataFrame:
    """The k best of each query by rounded score, ties to the smaller id: (q, id, score, rank)."""
    rounded = scores.where("score > 0").withColumn("score", F.round("score", decimals))
    return rounded.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def fused(channels: list[DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of ranked channels: (q, id, score)."""
    rows = channels[0].select("q", "id", "rank")
    for c in channels[1:]:
        rows = rows.unionByName(c.select("q", "id", "rank"))
    return rows.groupBy("q", "id").agg(F.sum(F.lit(1.0) / (k + F.col("rank"))).alias("score"))
