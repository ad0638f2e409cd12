"""Near copies of documents: SimHash links by multi-index hashing, verified by shingle sets, and completed exactly.

Each distinct text is a node. Fingerprints over a text's distinct words (a changed word moves few bits) are linked by the
operator's own tables and Hamming balls; the sets of word shingles then decide. What fingerprints miss, prefix_join brings
together: first a star for each shingle, which joins large groups at the cost of their size, then all pairs that are still
in different groups. A pair of nodes counts as linked only after its whole shingle sets were compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import prefix_join as P
from . import words as W
from .graphs import connected
from .near_dups import links_within_two, simhash
from .storage import discard, materialize, small_batches

#: Rows up to which nodes whose texts are wanted, or verdicts, are broadcast with their digests and ids: some megabytes.
FEW = 200_000


def word_fingerprints(column: pa.Array) -> np.ndarray:
    """SimHash of each text over its distinct words of more than four bytes, or over all if it has none; no words: zero."""
    out = []
    for scan in W.scans(column, W.INK):
        keys, long = scan.keys(), scan.ends - scan.starts > 4
        for a, b in zip(scan.bounds.tolist(), scan.bounds[1:].tolist(), strict=False):
            own = keys[a:b][long[a:b]]
            out.append(simhash(np.unique(own if len(own) else keys[a:b])))
    return np.array(out, np.uint64)


def _sets(texts: DataFrame, size: int) -> DataFrame:
    """(node, set array<long>): the sorted shingle keys of (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in P.slices(batches):
            own = list(P.shingle_sets(batch.column(1), size))
            yield pa.RecordBatch.from_arrays([batch.column(0), P.lists(own)], names=["node", "set"])

    return texts.mapInArrow(run, "node long, `set` array<long>")


def _similar(pairs: DataFrame, at_least: float) -> DataFrame:
    """The pairs (a, b, x, y) whose sets x and y have a Jaccard similarity of ``at_least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.asarray(x.values), np.asarray(y.values)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and both >= at_least * (len(x) + len(y) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    return pairs.mapInArrow(run, "a long, b long")


def _light_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (node, f): each with the least of its fingerprint, and the least of two linked fingerprints."""
    known = nodes.where("f <> 0")
    least = materialize(known.groupBy("f").agg(F.min("node").alias("least")), "fingerprints")
    same = known.join(least, "f").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    links = links_within_two(least.select("f")).select(F.col("a").alias("x"), F.col("b").alias("y"))
    one, other = least.select(F.col("f").alias("x"), F.col("least").alias("a")), least.select(F.col("f").alias("y"), F.col("least").alias("b"))
    near = links.join(one, "x").join(other, "y").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return same.unionByName(near).distinct()


def drop_near_copies(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with one row left of each group of copies: that of the smallest id, null ids last.

    Texts are linked if their sets of ``shingle_words``-word shingles (A-Z lower-cased) have a Jaccard similarity of
    ``similarity`` or more; groups are what is reachable over links, and no link is missed. Equal texts (by their whole
    SHA-256) are always a group, with null and empty as one text; texts without words are similar to nothing else. Of rows
    equal in id and text one stays. Texts of any length are compared whole; columns may have any names; an empty table
    gives an empty one.

    Keys, fingerprints and shingle prefixes are shuffled, and the sets of texts that some candidate names. Rows themselves
    move only where more than FEW texts are in groups.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = small_batches(docs).select(F.col(id_col).alias("id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))
    kind = docs.schema[id_col].dataType.simpleString()

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(word_fingerprints(batch.column(1)).view(np.int64))], names=["id", "digest", "f"])

    rows = texts.mapInArrow(prints, f"id {kind}, digest binary, f long").groupBy("digest", "f", "id").agg(F.count("*").alias("n"))
    least = rows.groupBy("digest", "f").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "n")).alias("k"), F.sum("n").alias("rows"))
    nodes = materialize(least.select(F.monotonically_increasing_id().alias("node"), "digest", "f", "k", "rows"), "nodes")

    def verified(pairs: DataFrame) -> DataFrame:
        wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node").select("node", "digest", F.col("k.id").alias("first")), "wanted")
        few = F.broadcast(wanted) if wanted.count() <= FEW else wanted.hint("shuffle_hash")
        chosen = texts.join(few, (texts["digest"] == few["digest"]) & texts["id"].eqNullSafe(few["first"])).select("node", "text")
        sets = materialize(_sets(chosen, shingle_words).dropDuplicates(["node"]), "sets")
        x, y = sets.select(F.col("node").alias("a"), F.col("set").alias("x")), sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
        links = materialize(_similar(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y"), similarity), "links")
        discard(wanted, sets)
        return links

    def grouped(links: DataFrame) -> DataFrame:
        return materialize(connected(links).select("node", "label"), "labels")

    prefixes = P.prefixes(texts.select("digest", "text"), nodes.select("node", "digest"), shingle_words, similarity)
    met = P.stars(prefixes, similarity)
    counts = P.counted(met)
    candidates = materialize(_light_pairs(nodes.select("node", "f")).unionByName(counts.where("shared >= need").select("a", "b")).distinct(), "candidates")
    links = verified(candidates)
    labels = materialize(connected(links).select("node", "label"), "labels")
    rest = P.unlinked_pairs(met.where("key is not null"), labels, counts, similarity).join(candidates, ["a", "b"], "left_anti")
    rest = materialize(rest, "candidates")
    more = verified(rest)
    if not more.isEmpty():
        labels = materialize(connected(links.unionByName(more)).select("node", "label"), "labels")
    discard(met, counts, candidates, rest)

    groups = nodes.join(labels, "node", "left").select("digest", "k", "rows", F.coalesce("label", "node").alias("label"))
    keeper = groups.groupBy("label").agg(F.min(F.struct("k", "digest")).alias("best"), F.sum("rows").alias("rows")).where("rows > 1")
    verdicts = materialize(groups.drop("rows").join(keeper, "label").select("digest", (F.col("digest") == F.col("best.digest")).alias("stays"), "best.k.id", "best.k.n"), "verdicts")
    few = F.broadcast(verdicts) if verdicts.count() <= FEW else verdicts
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("own"), F.unhex(F.sha2(text, 256)).alias("digest"))
    judged = whole.join(few, "digest", "left").where(F.col("stays").isNull() | (F.col("stays") & F.col("own").eqNullSafe(F.col("id"))))
    left = judged.select("row", "own", "digest")
    if not verdicts.where("stays and n > 1").isEmpty():  # rows equal in id and text
        left = left.dropDuplicates(["digest", "own"])
    return left.select("row.*")
