"""Token ids as Parquet: list columns in delta or dictionary encoding, with set row groups, pages and page indexes.

Files hold documents in ascending id order, so that a range of ids is read from few pages, and counts without ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import small_batches
from .tokens import encoder


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, dictionary: bool = True, row_group_bytes: int = 8 << 20, page_bytes: int = 64 << 10, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes (id, n_tokens, ids array<int>) of whole texts, each ended by ``end_id``, in ascending id order.

    ``dictionary``: ids as dictionary numbers; otherwise delta-packed (Parquet's version 2 pages). Column and offset
    indexes are always written. Files follow each other in id order; null ids come first, and rows of the same id are
    ordered by a hash of their texts, so that an id that many rows share spans files. Null or empty text: the end id alone.
    An empty table gives files without rows; other columns are left out. Texts are shuffled once, by id range.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in encoder(tokenizer_path).batch(batch.column(1)):
                own = own.ended(end_id)
                lists = pa.ListArray.from_arrays(pa.array(own.bounds.astype(np.int32)), pa.array(own.flat.view(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(own.first, len(lists)), pa.array(own.counts), lists], names=["id", "n_tokens", "ids"])

    rows = small_batches(docs).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    tokens = ordered.mapInArrow(encode, f"id {kind}, n_tokens long, ids array<int>").withColumnRenamed("id", id_col)
    options = {
        "compression": "zstd", "parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.page.row.count.limit": 20_000,
        "parquet.enable.dictionary": str(dictionary).lower(), "parquet.writer.version": "PARQUET_1_0" if dictionary else "PARQUET_2_0", "parquet.dictionary.page.size": 1 << 20,
    }
    tokens.write.options(**{k: str(v) for k, v in options.items()}).parquet(path)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """Ids and token counts alone; the token pages are not read."""
    return spark.read.parquet(path).drop("ids")


def read_range(spark: SparkSession, path: str, first: int, last: int, id_col: str = "doc_id") -> DataFrame:
    """The documents of an id range; row groups and pages outside it are skipped by their statistics and indexes."""
    return spark.read.parquet(path).where(F.col(id_col).between(first, last))


def file_digests(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Reads the files back: id, start (ids in all rows before it), n_tokens and ids_crc32, a row per written row.

    Rows are numbered as they stand in the files, repeated ids too, files in the order of their ids; what is brought
    together is a number per file, and a few numbers per row within a file.
    """
    files = spark.read.parquet(path)
    kind = files.schema[id_col].dataType.simpleString()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            flat, ends = np.asarray(ids.values).astype("<u4", copy=False), np.asarray(ids.offsets).tolist()
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())], names=["file", "row", "id", "n_tokens", "ids_crc32"])

    # A number for each file: that of its part, which follows the id ranges, and its own among the files of a part.
    number = lambda pattern: F.regexp_extract(F.col("_metadata.file_name"), pattern, 1).cast("long")
    file = number(r"part-(\d+)") * (1 << 31) + number(r"-c(\d+)\.")
    rows = files.select(file.alias("file"), F.col("_metadata.row_index").alias("row"), F.col(id_col).alias("id"), "ids").mapInArrow(check, f"file long, row long, id {kind}, n_tokens long, ids_crc32 long")
    counted = files.select(file.alias("file"), "n_tokens").groupBy("file").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # over one row per file
    files_before = counted.select("file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("files_before"))
    inside = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("rows_before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return placed.join(files_before, "file").select(F.col("id").alias(id_col), (F.col("files_before") + F.col("rows_before")).alias("start"), "n_tokens", "ids_crc32")
