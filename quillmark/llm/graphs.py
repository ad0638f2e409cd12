"""Connected components of links that may have no bound: nothing is gathered, every round is a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize


def connected(links: DataFrame) -> DataFrame:
    """(node, label) of every node with a link; label: the smallest node of its component. ``links``: longs a, b.

    Alternates two star operations until nothing changes: each node hands its larger neighbours, then its smaller
    neighbours and itself, to the smallest one it knows. Rounds grow with the logarithm of a component's size. A node
    with very many neighbours takes part in a minimum, which is pre-aggregated, and in a join, which Spark splits.
    Loops and repeated links are harmless, null ends are dropped.
    """
    edges = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    state = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("b"), F.col("m").alias("a")).distinct()
        large = materialize(large, "large-star")
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.explode(F.array(F.struct(F.col("a").alias("b"), F.col("m").alias("a")), F.struct(F.col("b"), F.col("m").alias("a")))).alias("e")).select("e.a", "e.b")
        before, edges = edges, materialize(small.where("a < b").distinct(), "small-star")
        discard(before, large)
        new = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if new == state:
            break
        state = new
    roots = edges.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()
    return edges.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(roots)
