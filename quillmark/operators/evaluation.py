"""Metrics, and test cases made by construction."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """struct<low, high>: the score interval of a share; 0 to 0 without trials."""
    p = k / n
    centre, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    d = 1 + z * z / n
    return F.when(n == 0, F.struct(F.lit(0.0).alias("low"), F.lit(0.0).alias("high"))).otherwise(F.struct(((centre - spread) / d).alias("low"), ((centre + spread) / d).alias("high")))


def precision_recall(rows: DataFrame, *by: str) -> DataFrame:
    """Of rows (predicted, truth): counts, precision and recall to four decimals, and the interval of the precision from 30 on."""
    hit = F.count_if(F.col("predicted") & F.col("truth"))
    counted = rows.groupBy(*by).agg(hit.alias("hits"), F.count_if("predicted").alias("positives"), F.count_if("truth").alias("truths"))
    share = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 4))
    interval = F.when(F.col("positives") >= 30, wilson(F.col("hits"), F.col("positives")))
    return counted.select(*by, "hits", "positives", "truths", share("hits", "positives").alias("precision"), share("hits", "truths").alias("recall"), F.round(interval["low"], 4).alias("low"), F.round(interval["high"], 4).alias("high"))


#: Parts into which a round cuts the values that are left, and distinct values that one task sorts at last.
PARTS, SORTED = 256, 1_000_000


def quantile_table(rows: DataFrame, value: str, qs: tuple[float, ...], most: int = SORTED) -> DataFrame:
    """(q, value) at the same places over any number of rows, of a number; no rows without a value.

    Selection in rounds: the distinct values around a rank are cut at their own quantiles, so that parts hold equally many
    of them however the values are spread, and the part that holds the rank is what is left. At ``most`` values it is sorted.
    """
    spark, kind = rows.sparkSession, rows.schema[value].dataType.simpleString()
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = spark.createDataFrame([], f"q double, value {kind}")
    for q in qs if total else ():
        place, low, high, before = min(total - 1, int(total * q)), None, None, 0
        while True:
            left = counts if low is None else counts.where(F.col("v") > low)
            left = left if high is None else left.where(F.col("v") <= high)
            if left.limit(most + 1).count() <= most:
                break
            cuts = sorted(set(left.agg(F.percentile_approx("v", [k / PARTS for k in range(1, PARTS)], 10_000)).first()[0]))
            part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("v")))  # number of the first cut at or above a value
            held = {r.part: r.n for r in left.groupBy(part.alias("part")).agg(F.sum("n").alias("n")).collect()}  # PARTS rows
            for k in sorted(held):
                if before + held[k] > place:
                    break
                before += held[k]
            low, high = cuts[k - 1] if k else low, cuts[k] if k < len(cuts) else high
        upto = F.lit(before) + F.sum("n").over(Window.orderBy("v"))  # over ``most`` rows at most
        found = found.unionByName(left.withColumn("upto", upto).where(F.col("upto") > place).agg(F.lit(float(q)).alias("q"), F.min("v").alias("value")))
    return found


def macro_f1(rows: DataFrame, by: str) -> DataFrame:
    """(by, f1): the mean F1 over labels that truth or prediction has, of rows (truth, predicted, n)."""
    cells = rows.groupBy(by, "truth", "predicted").agg(F.sum("n").alias("n"))
    part = lambda label, t, g, hit: F.struct(F.col(label).alias("label"), t.alias("t"), g.alias("g"), hit.alias("hit"))
    n, none = F.col("n"), F.lit(0).cast(cells.schema["n"].dataType)
    parts = F.array(part("truth", n, none, F.when(F.col("truth") == F.col("predicted"), n).otherwise(none)), part("predicted", none, n, none))
    counted = cells.select(by, F.explode(parts).alias("c")).groupBy(by, "c.label").agg(*(F.sum(f"c.{x}").alias(x) for x in ("t", "g", "hit")))
    return counted.groupBy(by).agg(F.round(F.avg(F.when(F.col("label").isNotNull(), 2 * F.col("hit") / (F.col("t") + F.col("g")))), 6).alias("f1"))


#: Label of characters that no span covers.
UNLABELLED = ""


def swept(truth: DataFrame, guess: DataFrame, lengths: DataFrame) -> DataFrame:
    """(id, truth, predicted, n): how many characters of each text have which labels under two sets of spans.

    ``truth``, ``guess``: (id, ord, start, end, label), later ones lie over earlier ones; ``lengths``: (id, n). Ends of spans
    stream by in the order of their places; between two of them all characters are alike and count as one stretch, so the
    work grows with spans and not with characters. What lies outside a text is cut off; texts without a span have one row.
    """
    kind = lengths.schema["id"].dataType.simpleString()
    place = lambda at, opens: F.struct(at.cast("long").alias("at"), F.lit(opens).alias("opens"))
    ends = lengths.select("id", F.col("n").cast("long").alias("at"), F.lit(-1).alias("side"), F.lit(0).cast("long").alias("ord"), F.lit(None).cast("string").alias("label"), F.lit(True).alias("opens"))
    events = ends
    for side, spans in enumerate((truth, guess)):
        first = F.greatest(F.col("start"), F.lit(0))
        both = spans.where(F.col("id").isNotNull() & (F.col("end") > first)).select("id", F.lit(side).alias("side"), F.col("ord").cast("long").alias("ord"), "label", F.explode(F.array(place(first, True), place(F.col("end"), False))).alias("e"))
        events = events.unionByName(both.select("id", "e.at", "side", "ord", "label", "e.opens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, place, counts, ahead = None, 0, Counter(), Counter()  # ahead: since the last end of the text, beyond it if none follows
        open_: list[dict] = [{}, {}]
        tops: list[list] = [[], []]

        def top(side: int) -> str:
            heap, live = tops[side], open_[side]
            while heap and -heap[0][0] not in live:
                heapq.heappop(heap)
            return live[-heap[0][0]][1] if heap else UNLABELLED

        def told(id_: object) -> Iterator[dict]:
            return ({"id": id_, "truth": t, "predicted": p, "n": n} for (t, p), n in sorted(counts.items()))

        schema, first = None, True
        for batch in batches:
            schema, done = pa.schema([batch.schema.field("id"), ("truth", pa.string()), ("predicted", pa.string()), ("n", pa.int64())]), []
            for id_, at, side, ord_, label, opens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if first or id_ != now:
                    if not first:
                        done += told(now)
                    now, place, counts, ahead, open_, tops, first = id_, 0, Counter(), Counter(), [{}, {}], [[], []], False
                if at > place:
                    ahead[top(0), top(1)] += at - place
                    place = at
                if side < 0:
                    counts.update(ahead)
                    ahead.clear()
                    continue
                held = open_[side].get(ord_, (0, label))[0] + (1 if opens else -1)
                if held:
                    open_[side][ord_] = (held, label)
                    if opens:
                        heapq.heappush(tops[side], (-ord_, at))
                else:
                    open_[side].pop(ord_, None)
            yield pa.RecordBatch.from_pylist(done, schema)
        if not first:
            yield pa.RecordBatch.from_pylist(list(told(now)), schema)

    ordered = events.repartition("id").sortWithinPartitions("id", "at", "opens")
    return ordered.mapInArrow(run, f"id {kind}, truth string, predicted string, n long")


def painted(texts: DataFrame, truth: dict[str, str], guess: dict[str, str]) -> DataFrame:
    """``swept`` for spans that stand beside their text: (id, truth, predicted, n) of each row.

    ``texts``: id, n, and columns array<struct<start,end>> of non-empty spans in order, within the text, that don't overlap in a
    column; ``truth``, ``guess``: column to label, later columns lie over earlier ones. Nothing is exploded, shuffled or sorted.
    """
    kind = texts.schema["id"].dataType.simpleString()
    names = [UNLABELLED, *dict.fromkeys([*truth.values(), *guess.values()])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done: tuple[list, ...] = ([], [], [], [])
            sizes = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
            spans = {}
            for c in (*truth, *guess):
                values, upto = batch.column(c).flatten(), np.cumsum([0, *(x or 0 for x in pc.list_value_length(batch.column(c)).to_pylist())])
                spans[c] = values.field("start").to_numpy(zero_copy_only=False), values.field("end").to_numpy(zero_copy_only=False), upto

            def side(columns: dict[str, str], row: int, size: int) -> np.ndarray:
                labels = np.zeros(size, np.int8)
                for c, label in columns.items():
                    starts, ends, upto = spans[c]
                    edges = np.zeros(size + 1, np.int8)
                    edges[starts[upto[row] : upto[row + 1]]] += 1
                    edges[ends[upto[row] : upto[row + 1]]] -= 1
                    labels[np.cumsum(edges[:-1], dtype=np.int8) > 0] = names.index(label)
                return labels

            for row, (id_, size) in enumerate(zip(batch.column("id").to_pylist(), sizes.tolist(), strict=True)):
                t, p = side(truth, row, size), side(guess, row, size)
                for i in range(len(names)):
                    counts = np.bincount(p[t == i], minlength=len(names))
                    for j in np.flatnonzero(counts).tolist():
                        for out, x in zip(done, (id_, names[i], names[j], int(counts[j])), strict=True):
                            out.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(done[0], batch.schema.field("id").type), pa.array(done[1], pa.string()), pa.array(done[2], pa.string()), pa.array(done[3], pa.int64())], names=["id", "truth", "predicted", "n"])

    return texts.select("id", "n", *truth, *guess).mapInArrow(run, f"id {kind}, truth string, predicted string, n long")


def character_scores(cells: DataFrame, unannotated: DataFrame | None = None) -> DataFrame:
    """(id, f1) of each text: the mean F1 over the labels that its characters have, characters without one included.

    ``cells``: of ``swept``. ``unannotated`` (id): texts without a true span; one scores 1 if nothing is predicted there, else 0.
    """
    scores = macro_f1(cells, "id")
    if unannotated is None:
        return scores
    said = cells.groupBy("id").agg(F.bool_or(F.col("predicted") != UNLABELLED).alias("said"))
    bare = unannotated.select("id").distinct().join(said, "id", "left").select("id", F.when(F.coalesce("said", F.lit(False)), 0.0).otherwise(1.0).alias("f1"))
    return scores.join(bare.select("id"), "id", "left_anti").unionByName(bare)


def class_f1(cells: DataFrame, labels: list[str]) -> DataFrame:
    """(label, f1) over all texts' characters together, a row for each label; 0 where neither side has it."""
    total = cells.groupBy("truth", "predicted").agg(F.sum("n").alias("n"))
    asked = cells.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    counted = asked.join(total, (F.col("label") == F.col("truth")) | (F.col("label") == F.col("predicted")), "left").groupBy("label").agg(
        F.sum(F.when((F.col("truth") == F.col("label")) & (F.col("predicted") == F.col("label")), F.col("n")).otherwise(0)).alias("hit"),
        F.sum(F.when(F.col("truth") == F.col("label"), F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("predicted") == F.col("label"), F.col("n")).otherwise(0)).alias("g"),
    )
    return counted.select("label", F.when(F.col("t") + F.col("g") > 0, F.round(2 * F.col("hit") / (F.col("t") + F.col("g")), 6)).otherwise(0.0).alias("f1"))


def confusion(cells: DataFrame, labels: list[str]) -> DataFrame:
    """Truth by prediction, a row and a column for each label, of cells (truth, predicted, n)."""
    rows = cells.sparkSession.createDataFrame([(x,) for x in labels], "truth string")
    found = cells.groupBy("truth").pivot("predicted", labels).agg(F.sum("n"))
    return rows.join(found, "truth", "left").fillna(0)


def retrieval_quality(ranked: DataFrame, truth: DataFrame, k: int = 5) -> DataFrame:
    """(queries, recall, mrr) of (q, id, rank) against (q, id): the first right answer within k."""
    best = truth.join(ranked.where(F.col("rank") <= k), ["q", "id"], "left").groupBy("q").agg(F.min("rank").alias("rank"))
    return best.agg(F.count("*").alias("queries"), F.round(F.avg(F.col("rank").isNotNull().cast("int")), 4).alias("recall"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 4).alias("mrr"))


def unstable(runs: DataFrame) -> DataFrame:
    """Cases (case_id, output) whose outputs differ between repeats."""
    return runs.groupBy("case_id").agg(F.count_distinct(F.sha2("output", 256)).alias("variants")).where("variants > 1")


def judged(got: DataFrame, expected: DataFrame) -> DataFrame:
    """(case_id, passed, unsafe, reasons) of results (case_id, status, reason, corpora, notices) against expectations
    (case_id, status, never, reason, corpus, notice_any); a null expectation asks for nothing. Without a result only not_found passes."""
    rows = expected.select("case_id", *(F.col(c).alias("x_" + c) for c in ("status", "never", "reason", "corpus", "notice_any"))).join(got, "case_id", "left")
    none = F.col("status").isNull()
    unsafe = F.coalesce(F.array_contains("x_never", F.col("status")), F.lit(False))
    reasons = F.array_compact(F.array(
        F.when(none & (F.coalesce("x_status", F.lit("")) != "not_found"), "nothing extracted"),
        F.when(~none & (F.col("status") != F.col("x_status")), "status"), F.when(unsafe, "unsafe"),
        F.when(~none & F.col("x_reason").isNotNull() & ~F.col("reason").eqNullSafe(F.col("x_reason")), "reason"),
        F.when(~none & F.col("x_corpus").isNotNull() & (F.size("corpora") > 0) & ~F.array_contains("corpora", F.col("x_corpus")), "corpus"),
        F.when(~none & (F.size("x_notice_any") > 0) & ~F.arrays_overlap("x_notice_any", "notices"), "notice"),
    ))
    return rows.select("case_id", (F.size(reasons) == 0).alias("passed"), unsafe.alias("unsafe"), reasons.alias("reasons"))


def mutated(tokens: Column, kind: str, k: Column, other: Column | None = None) -> Column:
    """A copy with one change at place k: drop, dup, swap with the next, or subst by another token; none leaves it."""
    head, tail = F.slice(tokens, F.lit(1), k), F.slice(tokens, k + 2, F.size(tokens))
    here = F.slice(tokens, k + 1, F.lit(1))
    if kind == "none":
        return tokens
    changed = {
        "drop": lambda: F.concat(head, tail), "dup": lambda: F.concat(head, here, here, tail),
        "swap": lambda: F.concat(head, F.slice(tokens, k + 2, F.lit(1)), here, F.slice(tokens, k + 3, F.size(tokens))), "subst": lambda: F.concat(head, F.array(other), tail),
    }[kind]()
    return F.when(k < F.size(tokens) - (1 if kind == "swap" else 0), changed).otherwise(tokens)


def sampled(rows: DataFrame, id_col: str, n: int, seed: str) -> DataFrame:
    """n rows, chosen by a digest of their id: the same ones on any engine and in any partitioning. A sampling operator."""
    return rows.withColumn("key", F.md5(F.concat(F.lit(seed), F.col(id_col).cast("string")))).orderBy("key").limit(n).drop("key")
