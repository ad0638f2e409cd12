"""Corpus pipeline: from documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns a DataFrame; all but the
last return the columns of ``documents``. A driver may write and reread the tables between stages, as the check does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from quillmark.llm.decontamination import decontaminate
from quillmark.llm.languages import fit, keep_identified
from quillmark.llm.near_copies import drop_near_copies
from quillmark.llm.packing import pack_pieces, pieces
from quillmark.llm.privacy import pseudonymise
from quillmark.llm.queries import tokenizer_path

#: No stage but the first can be told in SQL, and that one neither; the tests hold them against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and those that no language scores well on; fitted on the labelled documents."""
    return keep_identified(docs, fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies stays."""
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold half of a benchmark item or more, in any order, go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms; n_chars is that of the new text."""
    from pyspark.sql import functions as F

    new = pseudonymise(docs)
    return new.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else new


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the texts, placed in sequences of 2048 tokens."""
    return pack_pieces(pieces(docs, tokenizer_path()))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("private_data", private_data), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; a table in the shared folder ends the lineage of each stage."""
    from quillmark.llm.storage import materialize

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
