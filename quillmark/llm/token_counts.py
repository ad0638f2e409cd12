"""Token counts through a cache of digests: only content that the cache has not seen is encoded, once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import materialize, new_path, small_batches
from .tokens import encoder, version

CACHE = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("tokenizer", T.StringType())])


#: Misses up to which they are broadcast to find their texts: some megabytes of digests.
FEW = 100_000


def _first_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops repeats within a task, so that a text copied everywhere reaches the shuffle once from each task."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for digest in batch.column(0).to_pylist():
            keep.append(digest not in seen)
            seen.add(digest)
        yield batch.filter(pa.array(keep))


def read_cache(spark, path: str, tokenizer: str) -> DataFrame | None:
    """What a cache holds for a tokenizer version, a row for each digest; None where there is no cache yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    held = spark.read.schema(CACHE).parquet(path).where(F.col("tokenizer") == tokenizer)
    return held.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))  # two runs may have added the same digest


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``).

    Content is normalised only where that cannot change its tokens: null becomes the empty text. Digest (SHA-256) and
    tokenizer version are joined to the cache at ``cache_path``; distinct misses are encoded and appended to it. Without
    a path the cache is new and lives as long as the driver. A version covers the tokenizer file and its library, so a
    changed tokenizer finds nothing of the old one.

    Null or empty text: 0 bytes, 0 tokens. Null ids stay null, repeated rows give a row each and are encoded once, other
    columns are left out whatever their names, and an empty table gives an empty one. Digests meet the cache without the
    texts; only texts that it lacks are shuffled, once, by digest and after repeats within a task are gone. Where it
    lacks none, no text moves.
    """
    spark = small_batches(docs).sparkSession
    cache_path, tokenizer = cache_path or new_path(spark, "token-cache"), version(tokenizer_path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.sha2(text, 256))
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), digest.alias("digest"))
    wanted = docs.select(digest.alias("digest"), text.alias("text")).mapInArrow(_first_seen, "digest binary, text string")
    held, missing = read_cache(spark, cache_path, tokenizer), True
    if held is not None:
        rows = materialize(rows, "digests")
        misses = materialize(rows.select("digest").distinct().join(held, "digest", "left_anti"), "misses")
        many = misses.count()
        missing = many > 0
        wanted = wanted.join(F.broadcast(misses) if many <= FEW else misses.hint("shuffle_hash"), "digest", "left_semi")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _first_seen(batches):
            counts = [x.counts for x in encoder(tokenizer_path).batch(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([np.zeros(0, np.int64), *counts]))], names=["digest", "n_tokens"])

    if missing:
        fresh = wanted.repartition("digest").mapInArrow(encode, "digest binary, n_tokens long")
        fresh.withColumn("tokenizer", F.lit(tokenizer)).write.mode("append").parquet(cache_path)
    counts = materialize(read_cache(spark, cache_path, tokenizer), "counts")  # a table, so that Spark can split a digest that many rows share
    return rows.join(counts, "digest", "left").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
