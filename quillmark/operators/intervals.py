"""Intervals within a text or a user's time line."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merged(ranges: DataFrame) -> DataFrame:
    """(id, start, end): the union of ranges; ranges that touch become one."""
    before = Window.partitionBy("id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    rows = ranges.where("end > start").withColumn("reach", F.max("end").over(before))
    rows = rows.withColumn("part", F.sum(F.when(F.col("reach") >= F.col("start"), 0).otherwise(1)).over(Window.partitionBy("id").orderBy("start", "end")))
    return rows.groupBy("id", "part").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("id", "start", "end")


def annotation_runs(lengths: DataFrame, marks: DataFrame) -> DataFrame:
    """(id, ord, kind, start, end): a text as runs with and without a mark. Of overlapping marks the earlier, then the
    longer one keeps its place and the next begins where it ends. ``lengths``: (id, n); ``marks``: (id, start, end, kind).

    A text's end streams by after its marks, so that both are read once.
    """
    some = marks.where("id is not null").select("id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "kind", F.lit(False).alias("last"))
    ends = lengths.select("id", F.col("n").cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.lit("text").alias("kind"), F.lit(True).alias("last"))
    by = Window.partitionBy("id").orderBy("last", "start", F.desc("end"), "kind")
    before = F.coalesce(F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = some.unionByName(ends).withColumn("at", F.greatest(before, F.lit(0))).withColumn("known", F.bool_or("last").over(Window.partitionBy("id"))).where("known")
    placed = placed.select("id", "kind", "at", F.greatest("start", "at").alias("start"), "end", "last")
    run = lambda kind, a, b: F.struct(kind.alias("kind"), a.cast("int").alias("start"), b.cast("int").alias("end"))
    taken = placed.where("last or end > start").select("id", F.explode(F.array(run(F.lit("text"), F.col("at"), F.col("start")), run(F.col("kind"), F.col("start"), F.coalesce("end", "start")))).alias("r"))
    runs = taken.where("r.end > r.start").select("id", "r.*")
    return runs.select("id", (F.row_number().over(Window.partitionBy("id").orderBy("start")) - 1).alias("ord"), "kind", "start", "end")


def rate_limited(requests: DataFrame, most: int = 30, seconds: int = 60) -> DataFrame:
    """(key, at, request, allowed): a request is let through if fewer than ``most`` were let through in the last ``seconds``.

    Refused requests don't count, so the answer depends on order. Each key's requests stream by in order, and only the
    times let through lately are held, however busy a key is.
    """
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, recent = None, deque()
        for batch in batches:
            allowed = []
            for k, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != key:
                    key, recent = k, deque()
                while recent and recent[0] <= at - seconds:
                    recent.popleft()
                allowed.append(len(recent) < most)
                if allowed[-1]:
                    recent.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(allowed, pa.bool_())], names=["key", "at", "request", "allowed"])

    ordered = requests.select("key", "at", "request").repartition("key").sortWithinPartitions("key", "at", "request")
    return ordered.mapInArrow(run, f"key {kinds['key']}, at {kinds['at']}, request {kinds['request']}, allowed boolean")
