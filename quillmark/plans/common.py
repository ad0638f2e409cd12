"""Tables and SQL that the queries share: texts are documents, the corpus is the benchmark's items, in the Latin profile."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.orthography import ACCENTS
from ..operators.index import lines, streams, term_tables, tokenised
from ..operators.tables import stored


@dataclass(frozen=True)
class Query:
    """A query, and SQL for the same rows where there is any."""

    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deals rows out where the files give fewer tasks than there are cores, as a single row group does; large inputs stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores) if tasks < cores else df


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """The token streams of the documents, an index table: texts are tokenised once for all queries of an application."""
    return tokenised(kept_lines(spark, folder))


def kept_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``document_lines`` as the index table that it is kept in."""
    return stored(spark, f"{folder}/documents.parquet", "document-lines", lambda: document_lines(spark, folder))


def document_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(id, loose, strict, text, n) of the documents, tokens joined by spaces: what ``documents`` keeps. Who wants all lines once has them from here, and no table is written."""
    return lines(spread(table(spark, folder, "documents").select("doc_id", "text")), "doc_id")


def items(spark: SparkSession, folder: str) -> DataFrame:
    return stored(spark, f"{folder}/benchmark.parquet", "item-streams", lambda: streams(table(spark, folder, "benchmark"), "item_id"))


def document_terms(spark: SparkSession, folder: str, cutoff: float | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The term tables of the documents' words, which are index tables too."""
    made = term_tables(documents(spark, folder).select("id", F.col("loose").alias("terms")), cutoff)
    return tuple(stored(spark, f"{folder}/documents.parquet", f"document-{name}-{cutoff}", lambda t=t: t) for name, t in zip(("tf", "idf", "lengths"), made, strict=True))


def fold_sql(x: str) -> str:
    return f"translate(replace(lower({x}), 'ß', 'ss'), '{ACCENTS[0]}', '{ACCENTS[1]}')"


def stream_sql(name: str, source: str, key: str) -> str:
    """A common table (id, loose, strict)."""
    words = "regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}]+')"
    return f"{name} AS (SELECT id, [{fold_sql('x')} FOR x IN strict] AS loose, strict FROM (SELECT {key} AS id, {words} AS strict FROM {source}))"


DOCS, ITEMS = stream_sql("docs", "documents", "doc_id"), stream_sql("items", "benchmark", "item_id")


def grams_sql(tokens: str, n: int) -> str:
    """The runs of n tokens of a list."""
    return f"[array_to_string({tokens}[k:k + {n - 1}], ' ') FOR k IN range(1, greatest(len({tokens}) - {n - 2}, 1))]"
