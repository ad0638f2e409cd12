"""Messages of limited size: marked runs that never split a letter from its marks, and blocks packed into messages.

Sizes are counted in UTF-16 units of the markup, as clients count them.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text_tools import html_escaped, utf16_length
from . import intervals as N

#: Units of a message at most.
BUDGET = 3800


def _combining() -> str:
    """A pattern's class of the characters that combine with the one before them, by the Unicode property.

    They are marks, or unassigned where the virtual machine's tables are older: other characters are told by that alone,
    and the commonest marks by their own ranges, before the hundreds of others are tried one after another.
    """
    ranges: list[list[int]] = []
    for point in range(0x300, 0x1F000):
        if unicodedata.combining(chr(point)):
            if ranges and ranges[-1][1] == point - 1:
                ranges[-1][1] = point
            else:
                ranges.append([point, point])
    told = lambda some: "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" if b > a else f"\\x{{{a:x}}}" for a, b in some)
    return "[" + told(r for r in ranges if r[0] in (0x300, 0x64B)) + "[[\\p{M}\\p{Cn}]&&[" + told(ranges) + "]]]"


MARKS = _combining()

#: Characters before a place that are looked at first; longer runs of marks are looked at as a whole.
_NEAR = 64


def cluster_start(text: Column, place: Column, n: Column | None = None) -> Column:
    """A place, or that of the character which the marks at it combine with. ``n``: the text's length, where it is known."""
    n = F.length(text) if n is None else n

    def back(part: Column) -> Column:
        return F.length(F.regexp_extract(part, f"{MARKS}+$", 0))

    near = back(F.substring(text, F.greatest(place + 1 - _NEAR, F.lit(0)) + 1, F.least(place + 1, F.lit(_NEAR))))
    run = F.when(near < _NEAR, near).otherwise(back(F.substring(text, F.lit(1), place + 1)))
    return F.when((place > 0) & (place < n), F.greatest(place - run, F.lit(0))).otherwise(place)


def cluster_end(text: Column, place: Column) -> Column:
    """A place, or the end of the marks that stand at it."""
    ahead = lambda part: F.length(F.regexp_extract(part, f"^{MARKS}+", 0))
    near = ahead(F.substring(text, place + 1, F.lit(_NEAR)))
    return place + F.when(near < _NEAR, near).otherwise(ahead(F.substring(text, place + 1, F.length(text))))


def marked_runs(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """(id, ord, marked, start, end): texts (id, text) as runs in and out of marks (id, start, end), edges at whole letters.

    Marks that touch or overlap are one; of those that meet once widened the earlier one keeps its place. Characters are
    never added, left out or moved; marks beyond a text are cut.
    """
    sound = N.merged(marks.where("start >= 0").select("id", "start", "end"))
    known = sound.join(texts.select("id", "text", F.length("text").alias("n")), "id").where("start < n")
    wide = known.select("id", cluster_start(F.col("text"), F.col("start"), F.col("n")).alias("start"), cluster_end(F.col("text"), F.least("end", "n")).alias("end"), F.lit("mark").alias("kind"))
    runs = N.annotation_runs(texts.select("id", F.length("text").alias("n")), wide)
    return runs.select("id", "ord", (F.col("kind") == "mark").alias("marked"), "start", "end")


_RUN = T.StructType([T.StructField("text", T.StringType()), T.StructField("marked", T.BooleanType())])
_PIECES = T.ArrayType(T.ArrayType(_RUN))
_MARKUP = len("<b></b>")
_ESCAPED = {"&": len("&amp;"), "<": len("&lt;"), ">": len("&gt;")}


def rendered(runs: Column, wrap: Column, prefix: Column) -> Column:
    """Markup of runs array<struct<text,marked>>: escaped, marked ones bold, after a prefix and in a tag (``wrap``, empty for none)."""
    body = F.array_join(F.transform(F.filter(runs, lambda r: r["text"] != ""), lambda r: F.when(r["marked"], F.concat(F.lit("<b>"), html_escaped(r["text"]), F.lit("</b>"))).otherwise(html_escaped(r["text"]))), "")
    return F.when(wrap == "", F.concat(prefix, body)).otherwise(F.concat(F.lit("<"), wrap, F.lit(">"), prefix, body, F.lit("</"), F.substring_index(wrap, " ", 1), F.lit(">")))


@F.arrow_udf(_PIECES)
def _cut(runs: pa.Array, around: pa.Array, budget: pa.Array) -> pa.Array:
    """Runs in pieces whose markup fits a budget with ``around`` units beside it; cuts come after a space in the later half of
    what fits, if there is one. Each run's sizes are summed once, so the work grows with its length."""
    out = []
    for row, extra, most in zip(runs.to_pylist(), around.to_pylist(), budget.to_pylist(), strict=True):
        pieces: list[list[dict]] = []
        current: list[dict] = []
        used = extra
        for run in row or []:
            text, tag, at = run["text"], _MARKUP if run["marked"] else 0, 0
            sizes = np.cumsum([0, *(_ESCAPED.get(c) or 1 + (c > "￿") for c in text)]).tolist()
            while at < len(text):
                room = most - used - tag
                fits = max(0, bisect_right(sizes, sizes[at] + room, lo=at) - 1 - at) if room >= 0 else 0
                if not fits:
                    if current:
                        pieces.append(current)
                        current, used = [], extra
                        continue
                    fits = 1  # a single character is a piece, however small the budget
                if at + fits < len(text):
                    space = text.rfind(" ", at, at + fits) - at
                    fits = space + 1 if space > fits // 2 else fits
                current.append({"text": text[at : at + fits], "marked": run["marked"]})
                used += sizes[at + fits] - sizes[at] + tag
                at += fits
                if at < len(text):
                    pieces.append(current)
                    current, used = [], extra
        out.append([*pieces, current] if current else pieces)
    return pa.array(out, pa.list_(pa.list_(pa.struct([("text", pa.string()), ("marked", pa.bool_())]))))


def packed(blocks: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(id, message, grp, ord, piece, joint, html): in which message of an id each piece of a block stands, and what joins it
    to the one before it there.

    ``blocks``: (id, grp, ord, runs array<struct<text,marked>>, wrap, prefix), those without text are left out. A group starts
    a new message where it doesn't fit whole into the current one. One that is larger than a message is dealt out block by
    block, and a block that is larger in pieces, each with its tag and prefix. An id's blocks stream by in order, and nothing
    but the size of the current message is held.
    """
    kind = {f.name: f.dataType.simpleString() for f in blocks.schema}
    full = blocks.where(F.exists("runs", lambda r: r["text"] != "")).withColumn("html", rendered(F.col("runs"), F.col("wrap"), F.col("prefix"))).withColumn("size", utf16_length(F.col("html")))
    group = Window.partitionBy("id", "grp")
    sized = full.withColumn("whole", (F.sum("size").over(group) + F.count("*").over(group) - 1).cast("long"))
    around = utf16_length(rendered(F.array().cast("array<struct<text:string,marked:boolean>>"), F.col("wrap"), F.col("prefix")))
    large = sized.where((F.col("whole") > budget) & (F.col("size") > budget)).withColumn("around", around)
    cut = large.withColumn("pieces", _cut("runs", "around", F.lit(budget))).select("id", "grp", "ord", F.posexplode("pieces").alias("piece", "runs"), "wrap", "prefix", "whole")
    pieces = cut.select("id", "grp", "ord", "piece", "whole", rendered(F.col("runs"), F.col("wrap"), F.col("prefix")).alias("html"))
    rows = sized.where((F.col("whole") <= budget) | (F.col("size") <= budget)).select("id", "grp", "ord", F.lit(0).alias("piece"), "whole", "html").unionByName(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, current, message, inside = None, 0, 0, None
        started = False
        for batch in batches:
            numbers, joints = [], []
            for id_, grp, whole, size in zip(*(batch.column(n).to_pylist() for n in ("id", "grp", "whole", "size")), strict=True):
                if not started or id_ != now:
                    now, current, message, inside, started = id_, 0, 0, None, True
                joint = "\n" if current else ""
                if inside is None or inside[0] != grp:
                    inside = (grp,)
                    fits = whole <= budget
                    joint = "\n\n" if current and fits else ""
                    if current and (not fits or current + len(joint) + whole > budget):
                        message, current, joint = message + 1, 0, ""
                elif current + len(joint) + size > budget and whole > budget:
                    message, current, joint = message + 1, 0, ""
                current += len(joint) + size
                numbers.append(message)
                joints.append(joint)
            kept = [batch.column(n) for n in ("id", "grp", "ord", "piece", "html")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(numbers, pa.int32()), pa.array(joints, pa.string())], names=["id", "grp", "ord", "piece", "html", "message", "joint"])

    ordered = rows.withColumn("size", utf16_length(F.col("html"))).repartition("id").sortWithinPartitions("id", "grp", "ord", "piece")
    told = ordered.mapInArrow(run, f"id {kind['id']}, grp {kind['grp']}, ord {kind['ord']}, piece int, html string, message int, joint string")
    return told.select("id", "message", "grp", "ord", "piece", "joint", "html")


def messages(pieces: DataFrame) -> DataFrame:
    """(id, message, html) of ``packed`` pieces."""
    parts = F.array_sort(F.collect_list(F.struct("grp", "ord", "piece", "joint", "html")))
    return pieces.groupBy("id", "message").agg(F.array_join(F.transform(parts, lambda p: F.concat(p["joint"], p["html"])), "").alias("html"))
