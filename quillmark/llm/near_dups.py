"""SimHash near-duplicates by multi-index hashing.

A fingerprint is split into segments; a table for each segment holds the fingerprints by their segment's value. Of two
fingerprints that differ in few bits some segment differs in fewer, so a small Hamming ball around each segment's value
is enumerated, the table's matches are fetched and complete distances verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graphs import connected
from .storage import materialize, small_batches

SEED = 42

#: Fingerprints in a bucket up to which its members are compared one by one; larger ones are indexed again.
BUCKET = 64


def shingles(text: str, size: int) -> list[bytes]:
    """Runs of ``size`` words of a text with A-Z lower-cased; the whole sequence if it is shorter; none without words."""
    words = text.encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False)))


def simhash(hashes: np.ndarray) -> int:
    """The bits set in over half of the 64-bit hashes; zero for none."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle_words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint long) of each row's whole text: SimHash over XXH64 of its word shingles, repeats included.

    Null, empty and wordless texts have fingerprint zero.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            out = [simhash(np.array([digest(s, SEED) for s in shingles(t.as_py() or "", shingle_words)], np.uint64)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(out, np.uint64).view(np.int64))], names=[id_col, "fingerprint"])

    return small_batches(docs).select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, fingerprint long")


def _segment(half: int) -> Column:
    """The value of a 32-bit segment of ``f`` as a key: the segment's number above it."""
    value = F.shiftrightunsigned("f", 32) if half else F.col("f").bitwiseAND(F.lit(0xFFFFFFFF))
    return value + F.lit(half << 32)


def links_within_two(distinct: DataFrame) -> DataFrame:
    """Links (a, b) that connect exactly the fingerprints ``f`` (distinct longs) which differ in one or two bits.

    Two 32-bit segments: one of them differs in at most one bit. Each fingerprint probes its own value and those with
    one zero bit set, so one of any two sides finds the other. Buckets of up to BUCKET members are compared one by one.
    A larger bucket would give the square of its members; instead whoever probes it is keyed by the ball of radius
    one in either segment together with the other segment's value. Two fingerprints share such a key if and only if
    they differ in at most two bits, and at most 65 share one, so a key's members are linked to its smallest.
    """
    table = distinct.select(F.explode(F.array(_segment(0), _segment(1))).alias("key"), "f")
    bits = F.sequence(F.lit(0), F.lit(31))

    def ball(half: int) -> Column:
        own = _segment(half)
        unset = F.filter(bits, lambda b: F.call_function("getbit", own, b) == 0)
        return F.concat(F.array(own), F.transform(unset, lambda b: own + F.call_function("shiftleft", F.lit(1).cast("long"), b)))

    probes = distinct.select(F.explode(F.concat(ball(0), ball(1))).alias("key"), F.col("f").alias("p"))
    large = table.groupBy("key").count().where(F.col("count") > BUCKET).select("key")
    found = materialize(probes.join(table.join(large, "key", "left_anti"), "key").where((F.col("p") != F.col("f")) & (F.bit_count(F.col("p").bitwiseXOR(F.col("f"))) <= 2)).select(F.col("p").alias("a"), F.col("f").alias("b")), "light-links")
    crowded = probes.join(large, "key", "left_semi").select(F.col("p").alias("f")).distinct()
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.col("f").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)))
    keyed = crowded.select(F.explode(F.concat(F.array("f"), flips)).alias("key"), "f")
    groups = keyed.groupBy("key").agg(F.min("f").alias("a"), F.collect_list("f").alias("all")).where(F.size("all") > 1)
    stars = groups.select("a", F.explode("all").alias("b")).where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2))
    return found.unionByName(stars.distinct())


def components(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``rows`` (id, fingerprint) with component_id: the smallest id reachable over links of at most two differing bits.

    Rows of equal fingerprint are one node, so copies make no links. A null id is nobody's smallest; where all ids of a
    component are null, so is component_id. Repeated rows stay repeated; an empty table gives an empty one.
    """
    rows = materialize(rows.select(id_col, "fingerprint"), "fingerprints")
    distinct = materialize(rows.groupBy(F.col("fingerprint").alias("f")).agg(F.min(id_col).alias("least")), "distinct")
    labels = connected(links_within_two(distinct.select("f")))
    own = distinct.join(labels.withColumnRenamed("node", "f"), "f", "left").select("f", F.coalesce("label", "f").alias("label"), "least")
    least = own.groupBy("label").agg(F.min("least").alias("component_id"))
    named = own.join(least, "label").select(F.col("f").alias("fingerprint"), "component_id")
    return rows.join(named, "fingerprint").select(id_col, "fingerprint", "component_id")
