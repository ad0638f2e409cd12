"""Best-fit packing with certified bounds.

Documents are tokenised and cut into pieces of at most a sequence. Pieces are dealt into groups; each group packs its
own by best-fit decreasing and certifies the number of its bins by dual feasible functions. Groups that stand above
their bound give their bins that aren't full to a common pool. It is dealt anew, bin by bin, so that pieces of different
groups come together; each new group keeps its packing if that has fewer bins than it was given. This goes on until a
turn gains nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize, small_batches
from .tokens import encoder

_PACKED = ["sequence_id", "offset", "fill", "gap", "group"]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits; otherwise full ones after a first that may be shorter."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of whole texts, each document ended by ``end_id``: id, piece, start, length, ids_crc32 and, if asked, ids.

    Null or empty text: a piece with the end id alone. Null ids stay null, repeated rows give their pieces each, other
    columns are left out, an empty table gives an empty one. One pass, no shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in encoder(tokenizer_path).batch(batch.column(1)):
                own = own.ended(end_id)
                cuts = [(doc, piece, start, length) for doc, n in enumerate(own.counts.tolist()) for piece, (start, length) in enumerate(cut(n, capacity))]
                doc, piece, start, length = np.array(cuts, np.int64).reshape(-1, 4).T
                begin = own.bounds[doc] + start
                sums = [zlib.crc32(own.flat[a:b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
                columns = [batch.column(0).take(pa.array(own.first + doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(sums, pa.int64())]
                if with_ids:  # pieces follow each other as the ids do
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(begin, own.bounds[-1]).astype(np.int32)), pa.array(own.flat.view(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    ddl = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return small_batches(docs).select(F.col(id_col), F.col(text_col)).mapInArrow(run, ddl)


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """The bin and the offset in it of each size, placed in the given order into the fullest bin that has room."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some, bins, offsets, n = 0, [], [], 0  # some: bit r is set if a bin has room r
    for size in sizes:
        fits = some >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                some ^= 1 << r
        else:
            r, b, n = capacity, n, n + 1
        bins.append(b)
        offsets.append(capacity - r)
        room[r - size].append(b)
        some |= 1 << (r - size)
    return bins, offsets


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """A number of bins that no packing undercuts; ``counts[s]``: pieces of size s.

    Two families of dual feasible functions: one ignores sizes under a threshold and takes those that leave less than
    it as whole bins, the other rounds (k+1)-fold sizes down to whole k-ths.
    """
    sizes = np.arange(len(counts))
    mass = counts * sizes
    below, above = np.concatenate([[0], np.cumsum(mass)]), np.concatenate([[0], np.cumsum(counts)])
    best = -(-int(mass.sum()) // capacity)
    for t in range(1, capacity // 2 + 1):
        large = int(above[-1] - above[capacity - t + 1])
        best = max(best, large + -(-int(below[capacity - t + 1] - below[t]) // capacity))
    for k in range(1, 33):
        whole = (k + 1) * sizes % capacity == 0
        a, b = int(mass[whole].sum()), int((counts * ((k + 1) * sizes // capacity))[~whole].sum())
        best = max(best, -(-(a * k + b * capacity) // (capacity * k)))
    return best


def _packed(rows: DataFrame, capacity: int, groups: int, turn: int, columns: list[str], name: str) -> DataFrame:
    """Packs ``rows`` in ``groups`` groups dealt by a hash; the result is a table in the shared folder.

    In turn 0 pieces are dealt; afterwards bins are, and stay as they are where packing them anew saves none.
    """
    key = [F.xxhash64(F.lit(turn), *columns)] if turn == 0 else [F.xxhash64(F.lit(turn), "sequence_id")]
    dealt = rows.withColumn("__deal", F.pmod(key[0], F.lit(groups)))

    def pack(table: pa.Table) -> pa.Table:
        order = [("length", "descending"), *((c, "ascending") for c in (columns[0], "piece", "start", "ids_crc32"))]
        table = table.take(pc.sort_indices(table, sort_keys=order))
        sizes, deal = table["length"].to_numpy(), table["__deal"].to_numpy()
        bins, offsets = best_fit(sizes.tolist(), capacity)
        bins, offsets = np.array(bins, np.int64), np.array(offsets, np.int64)
        bound = lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
        ids, used = (np.int64(turn) << 56) + (deal << 36) + bins, int(bins.max()) + 1
        if turn:
            old, at = np.unique(table["sequence_id"].to_numpy(), return_inverse=True)
            if len(old) <= used:
                ids, bins, offsets, used = table["sequence_id"].to_numpy(), at, table["offset"].to_numpy(), len(old)
        own = {"sequence_id": ids, "offset": offsets, "fill": np.bincount(bins, sizes).astype(np.int64)[bins], "gap": np.full(len(bins), used - bound), "group": deal}
        return pa.table({**{c: table[c] for c in columns}, **own})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    ddl = ", ".join([f"`{c}` {kinds[c]}" for c in columns] + [f"`{c}` long" for c in _PACKED])
    return materialize(dealt.groupBy("__deal").applyInArrow(pack, ddl), name)


def pack_pieces(rows: DataFrame, capacity: int = 2048, group_rows: int = 100_000) -> DataFrame:
    """``rows`` (id, piece, start, length, ids_crc32) with sequence_id and offset: pieces fill a sequence from 0 without gaps.

    ``group_rows``: pieces packed together, about; the only rows a task holds at once. Ids may be of any type that sorts.
    Ties are broken by id, piece and start; rows that are equal in all columns are interchangeable. No rows, no sequences.
    A turn moves the loose bins of the groups above their bound alone; turns end when none is above it, when a turn saves
    no bin, or when the pool was one group and so met in whole.
    """
    rows = materialize(rows, "pieces")
    columns, n, turn = rows.columns, rows.count(), 0
    state = _packed(rows, capacity, max(1, -(-n // group_rows)), 0, columns, "packed")
    settled = None
    while True:
        loose = (F.col("gap") > 0) & (F.col("fill") < capacity)
        n, before, groups = state.where(loose).agg(F.count("*"), F.count_if(F.col("offset") == 0), F.count_distinct("group")).first()
        if groups < 2:
            break
        turn += 1
        kept = state.where(~loose)
        settled = kept if settled is None else settled.unionByName(kept)
        state = _packed(state.where(loose), capacity, max(1, -(-n // group_rows)), turn, columns, "repacked")
        if state.where("offset = 0").count() == before:
            break
    return (state if settled is None else settled.unionByName(state)).select(*columns, "sequence_id", "offset")


def certificate(packed: DataFrame, capacity: int = 2048) -> tuple[int, int]:
    """Sequences used, and the bound that no packing of the same pieces undercuts; gathers a count for each size."""
    rows = packed.groupBy("length").agg(F.count("*").alias("n"), F.count_if(F.col("offset") == 0).alias("bins")).collect()
    counts = np.zeros(capacity + 1, np.int64)
    for r in rows:
        counts[r.length] = r.n
    return sum(r.bins for r in rows), lower_bound(counts, capacity)


def sequences(pieces_with_ids: DataFrame, packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, and the documents in it (id, piece, offset, length).

    Of pieces that repeat in all of id, piece, length and digest, each placed one gets the ids.
    """
    keys = [id_col, "piece", "start", "length", "ids_crc32"]
    contents = pieces_with_ids.dropDuplicates(keys)
    same = [packed[k].eqNullSafe(contents[k]) for k in keys]
    joined = packed.join(contents, same).select("sequence_id", packed["offset"], contents["ids"], packed[id_col], packed["piece"], packed["length"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", id_col, "piece", "length")))
    return joined.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.flatten(F.col("parts.ids")).alias("ids"), F.transform("parts", lambda p: F.struct(p[id_col].alias(id_col), p["piece"].alias("piece"), p["offset"].alias("offset"), p["length"].alias("length"))).alias("documents")
    )
