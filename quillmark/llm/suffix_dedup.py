"""Repeated byte strings by a distributed sparse suffix array.

Every string of ``span`` bytes has an anchor within it, the place of the least hash among its grams of ``lead`` bytes, and
equal strings have it at the same offset. So the suffixes at anchors, a thirtieth of all, are enough: the strings that
share an anchor, a few dozen neighbours, travel as one suffix with its context.

1. Suffixes are range-partitioned by their leading bytes: splitters come from a bounded sample, a bucket lies between two.
   A bucket is sorted by lead and context digest (128 bits together). Of equal contexts all but the earliest are repeats as
   a whole, which is told within tasks first, so what a third of all rows share is one suffix for each task. A lead with
   one context is done; a lead that a splitter cuts reaches over a boundary and counts as having several.
2. The contexts that are left, edges of passages, fetch their bytes. Their strings are sorted in buckets by multikey
   quicksort, eight bytes at a time, so equality is that of bytes; of a class all but the earliest are repeats. Leads of
   very many contexts aren't sorted in one task: their strings are told apart by 128-bit digests in an aggregation.
3. Repeats join the texts, overlapping ones merge, and the rest of each text is what is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize, small_batches
from .words import utf8

#: Bytes whose windows are hashed at a time: temporary arrays of some megabytes, which a processor's cache holds.
BLOCK = 1 << 18

#: Suffixes that a task combines before it hands them on, some 40 bytes each.
FLUSH = 1 << 18

#: Distinct contexts of a lead above which its strings are told apart by digests.
HOT = 200_000

#: Sampled texts, and suffixes of each, from which splitters are chosen; they bear on the sizes of buckets only.
SAMPLE_TEXTS, SAMPLE_SUFFIXES = 2_000, 32

#: Stands for a null id: below all others.
NONE = -(1 << 63)

_U = np.uint64
_ORDERED = "S24"


@dataclass(frozen=True)
class Anchors:
    """Finds anchors; ``lead`` is a power of two."""

    span: int
    lead: int

    @staticmethod
    def of(span: int) -> Anchors:
        if span < 4:
            raise ValueError("spans have four bytes at least")
        return Anchors(span, 1 << (span // 3).bit_length() - 1)

    def grams(self, data: np.ndarray) -> np.ndarray:
        """Hashes of the runs of ``lead`` bytes."""
        h, m, n = data.astype(_U) + _U(1), 0x9E3779B97F4A7C15, 1
        while n < self.lead:
            h = h[:-n] * _U(m) + h[n:]
            m, n = m * m & (1 << 64) - 1, 2 * n
        h ^= h >> _U(32)
        h *= _U(0xD6E8FEB86659FD93)
        return h ^ (h >> _U(32))

    def find(self, data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For runs of neighbouring strings with one anchor: start of the first, their number, the anchor's offset from the
        start, hash and rank (first eight bytes, or all) of its gram. Places are those in ``data``; no string crosses ``bounds``."""
        width, limit = self.span - self.lead + 1, np.repeat(bounds[1:] - self.span, np.diff(bounds))
        for c in range(0, len(data) - self.span + 1, BLOCK):
            piece = data[c : c + BLOCK + self.span - 1]
            hashes = self.grams(piece)
            least, n = (hashes & _U(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=_U), 1
            while 2 * n <= width:
                least, n = np.minimum(least[:-n], least[n:]), 2 * n
            if width > n:
                least = np.minimum(least[: n - width], least[width - n :])
            starts = np.flatnonzero(np.arange(c, c + len(least)) <= limit[c : c + len(least)])
            if not len(starts):
                continue
            at = (least[starts] & _U(0xFFFFFFFF)).astype(np.int64)
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            count, start, anchor = np.diff(np.append(first, len(at))), starts[first], at[first]
            eight = np.lib.stride_tricks.sliding_window_view(np.append(piece, np.zeros(8, np.uint8)), 8)
            rank = np.ascontiguousarray(eight[anchor]).view(">u8").ravel().astype(_U) & _head(self.lead)
            yield start + c, count, anchor - start, hashes[anchor], rank


def _head(size: int) -> np.uint64:
    """Keeps the first bytes of eight, or all."""
    return _U((1 << 64) - (1 << 8 * max(0, 8 - size)))


def _ordered(*columns: np.ndarray) -> np.ndarray:
    """Rows of unsigned numbers as byte strings that sort as the rows do."""
    out = np.zeros((len(columns[0]), 3), ">u8")
    for k, c in enumerate(columns):
        out[:, k] = c
    return out.view(_ORDERED).ravel()


def _before(doc: np.ndarray, place: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Whether the row numbered by ``least`` stands earlier than the own one."""
    return (doc[least] < doc) | ((doc[least] == doc) & (place[least] < place))


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin, in sorted rows."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


class Suffixes:
    """Columns of suffixes that gather until they are handed on."""

    NAMES = {"lead": _U, "digest": _U, "doc": np.int64, "h": np.int64, "start": np.int32, "off": np.int16, "count": np.int16}

    def __init__(self) -> None:
        self.parts: list[dict[str, np.ndarray]] = []
        self.rows = 0

    def add(self, **columns: np.ndarray) -> None:
        self.parts.append({k: np.asarray(v) for k, v in columns.items()})
        self.rows += len(columns["lead"])

    def take(self) -> dict[str, np.ndarray]:
        """All rows, sorted by lead, digest and place."""
        parts, self.parts, self.rows = self.parts, [], 0
        rows = {k: np.concatenate([p.pop(k) for p in parts]) for k in list(parts[0])}
        order = np.lexsort((rows["start"], rows["doc"], rows["digest"], rows["lead"]))
        for k in rows:  # one column at a time
            rows[k] = rows[k][order]
        return rows


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, h, text): ids with the least long for null, and a hash by which texts of one id are told apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return small_batches(docs).select(F.coalesce(F.col(id_col).cast("long"), F.lit(NONE)).alias("doc"), F.xxhash64(text).alias("h"), text.alias("text"))


def _found(batch: pa.RecordBatch, anchors: Anchors) -> Iterator[dict[str, np.ndarray]]:
    """Suffixes of a batch of texts, with ranks."""
    data, bounds = utf8(batch.column("text"))
    doc, h, raw = batch.column("doc").to_numpy(), batch.column("h").to_numpy(), data.tobytes()
    hashed = xxhash.xxh3_64_intdigest
    for start, count, off, lead, rank in anchors.find(data, bounds):
        own = np.searchsorted(bounds, start, "right") - 1
        digest = np.array([hashed(raw[a:b]) for a, b in zip(start.tolist(), (start + count + (anchors.span - 1)).tolist(), strict=True)], _U)
        yield {"lead": lead, "digest": digest, "doc": doc[own], "h": h[own], "start": (start - bounds[own]).astype(np.int32), "off": off.astype(np.int16), "count": count.astype(np.int16), "rank": rank}


def _splitters(texts: DataFrame, anchors: Anchors, buckets: int) -> np.ndarray:
    """Bounds between buckets, as ordered (rank, lead, digest), from a bounded sample of suffixes."""
    every = max(1, texts.count() // SAMPLE_TEXTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _found(batch, anchors):
                own, first = rows["doc"], np.flatnonzero(_firsts(rows["doc"], rows["h"]))
                size = np.diff(np.append(first, len(own)))
                nth = np.arange(len(own)) - np.repeat(first, size)
                kept = nth % np.repeat(-(-size // SAMPLE_SUFFIXES), size) == 0
                yield pa.RecordBatch.from_pydict({k: rows[k][kept].view(np.int64) for k in ("rank", "lead", "digest")})

    sample = texts.where(F.pmod(F.xxhash64("doc", "h"), F.lit(every)) == 0).mapInArrow(run, "rank long, lead long, digest long").toPandas()
    keys = np.unique(_ordered(*(sample[k].to_numpy().astype(np.int64).view(_U) for k in ("rank", "lead", "digest"))))
    return keys[np.linspace(0, len(keys), min(buckets, max(1, len(keys) // 8)) + 1).astype(int)[1:-1]]


_BLOCKS = "bucket int, done boolean, " + ", ".join(f"{k} binary" for k in Suffixes.NAMES)
_MARKS = "kind int, doc long, h long, start int, off int, count int, lead long"

#: Kinds of marks: strings that are repeats; contexts whose strings must be compared; the same where a lead has very many.
REPEAT, EDGE, CROWD = 0, 1, 2


def _marks(texts: DataFrame, anchors: Anchors, splitters: np.ndarray, parts: int) -> DataFrame:
    """Marked suffixes: kind, text, start of the first string and their number, the anchor's offset and lead."""
    buckets = len(splitters) + 1
    leads, times = np.unique(splitters.view(">u8").reshape(-1, 3)[:, 1].astype(_U) if len(splitters) else np.zeros(0, _U), return_counts=True)

    def block(bucket: int, done: bool, rows: dict[str, np.ndarray]) -> dict:
        return {"bucket": bucket, "done": done, **{k: rows[k].astype(t, copy=False).tobytes() for k, t in Suffixes.NAMES.items()}}

    def hand_on(gathered: Suffixes, turn: int) -> Iterator[pa.RecordBatch]:
        rows = gathered.take()
        first = _firsts(rows["lead"], rows["digest"])
        later = _before(rows["doc"], rows["start"], np.flatnonzero(first)[np.cumsum(first) - 1])
        schema = pa.schema([("bucket", pa.int32()), ("done", pa.bool_()), *((k, pa.binary()) for k in Suffixes.NAMES)])
        if later.any():
            yield pa.RecordBatch.from_pylist([block(turn % buckets, True, {k: v[later] for k, v in rows.items()})], schema)
        rows = {k: v[~later] for k, v in rows.items()}
        bucket = np.searchsorted(splitters, _ordered(rows["rank"], rows["lead"], rows["digest"]), "right")
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(_firsts(bucket[order]))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
            yield pa.RecordBatch.from_pylist([block(int(bucket[order[a]]), False, {k: v[order[a:b]] for k, v in rows.items()})], schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, turn = Suffixes(), 0
        for batch in batches:
            for rows in _found(batch, anchors):
                gathered.add(**rows)
                if gathered.rows >= FLUSH:
                    turn += int(rows["lead"][0] % _U(1 << 20))
                    yield from hand_on(gathered, turn)
        if gathered.rows:
            yield from hand_on(gathered, turn + int(gathered.parts[0]["lead"][0] % _U(1 << 20)))

    def marks(kind: np.ndarray | int, rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        n = len(rows["lead"])
        columns = {"kind": np.broadcast_to(np.int32(kind), n) if np.isscalar(kind) else kind.astype(np.int32), **{k: rows[k] for k in ("doc", "h")}, **{k: rows[k].astype(np.int32) for k in ("start", "off", "count")}, "lead": rows["lead"].view(np.int64)}
        whole = pa.RecordBatch.from_pydict({k: np.ascontiguousarray(v) for k, v in columns.items()})
        yield from (whole.slice(k, 1 << 16) for k in range(0, n, 1 << 16))

    def told(gathered: Suffixes) -> Iterator[pa.RecordBatch]:
        """The marks of a bucket."""
        if not gathered.rows:
            return
        rows = gathered.take()
        of_lead, first = _firsts(rows["lead"]), _firsts(rows["lead"], rows["digest"])
        later = _before(rows["doc"], rows["start"], np.flatnonzero(first)[np.cumsum(first) - 1])
        yield from marks(REPEAT, {k: v[later] for k, v in rows.items()})
        number = np.cumsum(of_lead) - 1
        contexts = np.bincount(number, first)[number]
        at = np.minimum(np.searchsorted(leads, rows["lead"]), max(0, len(leads) - 1))
        cuts = np.where(leads[at] == rows["lead"], times[at], 0) if len(leads) else np.zeros(len(at), np.int64)
        edge = ~later & ((contexts > 1) | (cuts > 0))
        crowd = np.where(cuts > 0, cuts > 1, contexts > HOT)  # what lies on one boundary are two buckets' rows at most; both must say the same
        yield from marks(np.where(crowd, CROWD, EDGE)[edge], {k: v[edge] for k, v in rows.items()})

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, bucket = Suffixes(), None
        for batch in batches:
            for r in batch.to_pylist():
                rows = {k: np.frombuffer(r[k], t) for k, t in Suffixes.NAMES.items()}
                if r["done"]:
                    yield from marks(REPEAT, rows)
                    continue
                if r["bucket"] != bucket:
                    yield from told(gathered)
                    gathered, bucket = Suffixes(), r["bucket"]
                gathered.add(**rows)
        yield from told(gathered)

    return texts.mapInArrow(cut, _BLOCKS).repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(tell, _MARKS)


def same_strings(data: np.ndarray, starts: np.ndarray, span: int, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort over the strings of ``span`` bytes at ``starts``, within groups: numbers of those that have an
    equal one, in the order of their classes, and the class of each. The key of a step is the next eight bytes; strings
    that no other one equals so far drop out, all groups that are still equal go on to the next key together."""
    eight = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(8, np.uint8)), 8)
    rows, class_ = np.arange(len(starts)), groups
    for depth in [None, *range(0, span - 8, 8), max(0, span - 8)]:
        if depth is None:
            order = np.argsort(class_, kind="stable")
            new = _firsts(class_[order])
        else:
            key = np.ascontiguousarray(eight[starts[rows] + depth]).view(">u8").ravel().astype(_U) & _head(span)
            order = np.lexsort((key, class_))
            new = _firsts(class_[order], key[order])
        number = np.cumsum(new) - 1
        shared = np.bincount(number, minlength=1)[number] > 1 if len(number) else np.zeros(0, bool)
        rows, class_ = rows[order][shared], number[shared]
    return rows, class_


def _contexts(texts: DataFrame, edges: DataFrame, anchors: Anchors, splitters: np.ndarray) -> DataFrame:
    """Edges with the bytes of their strings: (bucket, lead, doc, h, start, off, count, bytes); a lead's are in one bucket."""
    bounds = np.unique(_ordered(*splitters.view(">u8").reshape(-1, 3)[:, :2].T)) if len(splitters) else splitters
    listed = edges.groupBy("doc", "h").agg(F.collect_list(F.struct("start", "off", "count", "lead")).alias("edges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts_, lists = batch.column("text"), batch.column("edges")
            flat, own = lists.flatten(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            rows = {k: flat.field(k).to_numpy() for k in ("start", "off", "count", "lead")}
            for t in range(len(lists)):
                raw, mine = texts_[t].as_py().encode(), np.flatnonzero(own == t) if len(lists) > 1 else np.arange(len(own))
                for k in range(0, len(mine), 4096):  # a long text has many
                    part = {c: v[mine[k : k + 4096]] for c, v in rows.items()}
                    cut = [raw[a : a + n + anchors.span - 1] for a, n in zip(part["start"].tolist(), part["count"].tolist(), strict=True)]
                    rank = np.array([int.from_bytes(b[o : o + 8].ljust(8, b"\0"), "big") for b, o in zip(cut, part["off"].tolist(), strict=True)], _U) & _head(anchors.lead)
                    n, bucket = len(cut), np.searchsorted(bounds, _ordered(rank, part["lead"].view(_U)), "right")
                    yield pa.RecordBatch.from_pydict({"bucket": bucket.astype(np.int32), "lead": part["lead"], "doc": np.full(n, batch.column("doc")[t].as_py(), np.int64), "h": np.full(n, batch.column("h")[t].as_py(), np.int64), **{c: part[c] for c in ("start", "off", "count")}, "bytes": pa.array(cut, pa.binary())})

    return texts.join(listed, ["doc", "h"]).select("doc", "h", "text", "edges").mapInArrow(run, "bucket int, lead long, doc long, h long, start int, off int, count int, bytes binary")


_SPANS = "doc long, h long, start int, end int"


def _compared(contexts: DataFrame, anchors: Anchors, parts: int) -> DataFrame:
    """Spans of repeated strings, of contexts that meet in buckets by their leads."""

    def told(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        column = {k: rows.column(k).to_numpy() for k in ("lead", "doc", "h", "start", "off", "count")}
        raw = rows.column("bytes").combine_chunks()
        data, begin = np.frombuffer(b"".join(raw.to_pylist()), np.uint8), np.cumsum(np.append(0, column["count"] + (anchors.span - 1)))[:-1]
        own = np.repeat(np.arange(len(begin)), column["count"])
        nth = np.arange(len(own)) - np.repeat(np.cumsum(column["count"]) - column["count"], column["count"])
        lead = np.cumsum(_firsts(column["lead"])) - 1
        found, class_ = same_strings(data, begin[own] + nth, anchors.span, lead[own] * (anchors.span + 1) + column["off"][own] - nth)
        doc, at = column["doc"][own[found]], column["start"][own[found]] + nth[found]
        order = np.lexsort((at, doc, class_))
        first = _firsts(class_[order])
        later = found[order][_before(doc[order], at[order], np.flatnonzero(first)[np.cumsum(first) - 1])]
        later.sort()
        if len(later):
            begins = np.flatnonzero(np.r_[True, (np.diff(later) > 1) | (np.diff(own[later]) > 0)])
            ends = np.append(begins[1:], len(later)) - 1
            r = own[later[begins]]
            start = column["start"][r] + nth[later[begins]]
            end = column["start"][r] + nth[later[ends]] + anchors.span
            yield pa.RecordBatch.from_pydict({"doc": column["doc"][r], "h": column["h"][r], "start": start.astype(np.int32), "end": end.astype(np.int32)})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole leads at a time: rows come sorted by bucket and lead."""
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            waiting.append(batch)
            if sum(map(len, waiting)) >= 8192:
                rows = pa.Table.from_batches(waiting)
                lead = rows.column("lead").to_numpy()
                whole = int(np.flatnonzero(_firsts(lead))[-1])  # the last lead may go on
                if whole:
                    yield from told(rows.slice(0, whole))
                    waiting = rows.slice(whole).to_batches()
        if waiting and sum(map(len, waiting)):
            yield from told(pa.Table.from_batches(waiting))

    return contexts.repartition(parts, "bucket").sortWithinPartitions("bucket", "lead").mapInArrow(compare, _SPANS)


def _aggregated(contexts: DataFrame, anchors: Anchors) -> DataFrame:
    """Spans of repeated strings among contexts of crowded leads: by 128-bit digests, no group is brought together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            count, raw = batch.column("count").to_numpy(), batch.column("bytes").to_pylist()
            own = np.repeat(np.arange(len(count)), count)
            nth = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
            told = [digest(raw[r][k : k + anchors.span]) for r, k in zip(own.tolist(), nth.tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"string": pa.array(told, pa.binary()), "doc": batch.column("doc").to_numpy()[own], "h": batch.column("h").to_numpy()[own], "start": (batch.column("start").to_numpy()[own] + nth).astype(np.int32)})

    strings = contexts.mapInArrow(run, "string binary, doc long, h long, start int")
    least = strings.groupBy("string").agg(F.min(F.struct("doc", "start")).alias("least"))
    later = strings.join(least, "string").where(F.struct("doc", "start") > F.col("least"))
    return later.select("doc", "h", "start", (F.col("start") + anchors.span).cast("int").alias("end"))


def repeated_spans(texts: DataFrame, span: int = 100) -> DataFrame:
    """Spans (doc, h, start, end), overlapping ones too, that together are all bytes which strings of ``span`` bytes cover
    that also start earlier: in a smaller doc, or before in the same one. ``texts``: doc long, h long, text."""
    anchors, spark = Anchors.of(span), texts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    splitters = _splitters(texts, anchors, 8 * parts)
    marks = materialize(_marks(texts, anchors, splitters, parts), "suffix-marks")
    repeats = marks.where(F.col("kind") == REPEAT).select("doc", "h", "start", (F.col("start") + F.col("count") + (span - 1)).cast("int").alias("end"))
    found = repeats.unionByName(_compared(_contexts(texts, marks.where(F.col("kind") == EDGE), anchors, splitters), anchors, parts))
    crowd = marks.where(F.col("kind") == CROWD)
    return found if crowd.isEmpty() else found.unionByName(_aggregated(_contexts(texts, crowd, anchors, splitters), anchors))


def remove_repeats(docs: DataFrame, span: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, spans array<struct<start,end>>, kept binary) of each row: the maximal runs of bytes that strings of
    ``span`` bytes cover which also start earlier, and the other bytes of the text in their order.

    Earlier: in a row of a smaller id, or before in the same text; strings are judged on the input. Ids are whole numbers,
    a null one is the smallest. Rows of one id are one document to each other only by place: what stands at the same place
    in two of them is in neither earlier. A null text counts as empty; texts under ``span`` bytes are kept whole; repeated
    rows stay repeated. Other columns are left out, so none can clash; an empty table gives an empty one.
    """
    texts, kind = _texts(docs, id_col, text_col), docs.schema[id_col].dataType.simpleString()
    listed = repeated_spans(texts, span).groupBy("doc", "h").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    run_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, merged, kept = [], [], []
            for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                raw = text.as_py().encode()
                runs: list[dict[str, int]] = []
                if spans.is_valid:
                    start, end = (spans.values.field(k).to_numpy() for k in ("start", "end"))
                    order = np.argsort(start)
                    start, reach = start[order], np.maximum.accumulate(end[order])
                    begins = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
                    ends = np.append(begins[1:], len(start)) - 1
                    runs = [{"start": a, "end": b} for a, b in zip(start[begins].tolist(), reach[ends].tolist(), strict=True)]
                edges = [0, *(x for r in runs for x in (r["start"], r["end"])), len(raw)]
                sizes.append(len(raw))
                merged.append(runs)
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(sizes, pa.int64()), pa.array(merged, run_type), pa.array(kept, pa.binary())], names=["doc", "n_bytes", "spans", "kept"])

    out = texts.join(listed, ["doc", "h"], "left").select("doc", "text", "spans").mapInArrow(run, "doc long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")
    return out.select(F.nullif("doc", F.lit(NONE)).cast(kind).alias(id_col), "n_bytes", "spans", "kept")
