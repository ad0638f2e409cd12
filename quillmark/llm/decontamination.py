"""Benchmark decontamination by greedy string tiling.

Word windows of items and texts are hashed by a running Karp-Rabin hash and joined as seeds, against a table of the items
on every executor. A match begins where a seed's preceding words differ; its length follows from the same running hash by
bisection, so a phrase that repeats in both makes a match for each offset, not a seed for each pair of places. The longest
match not yet covered is marked as a tile in both, again and again; what is left of others competes on. The item's covered
share decides, so parts count in whatever order they stand.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .storage import materialize, small_batches

#: Words of items that are sent to the executors at a time; a larger benchmark takes a pass over the texts for each such block.
BLOCK_WORDS = 2_000_000

#: Pairs of a text and an item's window that are held at a time.
STEP = 4_000_000


def tile(matches: list[tuple[int, int, int]], item: list[bytes], text, size: int) -> list[tuple[int, int, int]]:
    """Tiles (item place, text place, words), by a greedy choice of the longest match, then the first in item and text.

    ``matches``: (item place, text place, words) of maximal runs whose hashes agree; ``text(a, b)``: words of the text, to
    verify them. A run whose words turn out to differ somewhere is cut there, and its parts compete again.
    """
    heap = [(-n, i, j) for i, j, n in matches]
    heapq.heapify(heap)
    marked, taken, tiles, free = np.zeros(len(item), bool), set(), [], len(item)
    while heap and free >= size:
        n, i, j = heapq.heappop(heap)
        good = [not marked[i + k] and j + k not in taken for k in range(-n)]
        if all(good):
            good = [a == b for a, b in zip(item[i : i - n], text(j, j - n), strict=True)]
            if all(good):
                marked[i : i - n] = True
                taken.update(range(j, j - n))
                tiles.append((i, j, -n))
                free += n
                continue
        start = None
        for k, ok in enumerate([*good, False]):
            if ok and start is None:
                start = k
            elif not ok and start is not None:
                if k - start >= size:
                    heapq.heappush(heap, (start - k, i + start, j + start))
                start = None
    return tiles


class Tiler:
    """Items made ready for batches of texts; ``items``: (id, text)."""

    def __init__(self, items: list[tuple[int, str]], min_match: int = 4, threshold: float = 0.5):
        self.size, self.threshold = min_match, threshold
        self.ids, self.items, keys = [], [], [np.zeros(0, np.uint64)]
        for scan in W.scans(pa.array([t or "" for _, t in items], pa.string())):
            own = scan.keys()
            for k in range(len(scan.counts)):
                a, b = int(scan.bounds[k]), int(scan.bounds[k + 1])
                keys.append(own[a:b])
                self.ids.append(items[scan.first + k][0])
                self.items.append(scan.words(a, b))
        self.keys = np.concatenate(keys)
        self.bounds = np.cumsum([0, *map(len, self.items)])
        self.running = W.Running(self.keys)
        at = np.arange(max(0, len(self.keys) - min_match + 1))
        owner = np.searchsorted(self.bounds, at, "right") - 1
        at = at[at + min_match <= self.bounds[owner + 1]] if len(at) else at  # windows inside an item
        hashes = self.running.hashes(at, min_match)
        self.lookup = W.Lookup(hashes)
        self.number = np.zeros(len(self.keys) + 1, np.int32)
        self.number[at] = self.lookup(hashes)
        order = np.argsort(self.number[at], kind="stable")
        self.places = at[order]  # of the windows, by their number
        self.first = np.searchsorted(self.number[at][order], np.arange(len(self.lookup.keys) + 1))

    def find(self, column: pa.Array) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
        """(row, item, tiles) of each text and item whose tiles cover the threshold."""
        for scan in W.scans(column):
            keys = scan.keys()
            running = W.Running(keys)
            number = self.lookup(running.windows(self.size))
            at = np.flatnonzero(number)
            doc = np.searchsorted(scan.bounds, at, "right") - 1
            inside = at + self.size <= scan.bounds[doc + 1]
            at, doc = at[inside], doc[inside]
            seeds = None
            for k, item in self._pairs(doc, number[at]):
                if seeds is None or seeds[0] != k:
                    seeds = k, *self._seeds(scan, keys, number, at[np.searchsorted(doc, k) : np.searchsorted(doc, k, "right")], k)
                base, own = int(scan.bounds[k]), self.items[item]
                matches = self._matches(running, item, *seeds[1:], base, int(scan.bounds[k + 1]))
                tiles = tile(matches, own, lambda i, j, s=scan, o=base: s.words(o + i, o + j), self.size)
                if sum(n for *_, n in tiles) >= self.threshold * len(own):
                    yield scan.first + k, item, tiles

    def _pairs(self, doc: np.ndarray, number: np.ndarray) -> Iterator[tuple[int, int]]:
        """Texts and items of which so many words stand under shared seeds that tiles can cover the threshold."""
        each = np.unique(doc.astype(np.int64) * len(self.first) + number)
        doc, number = each // len(self.first), each % len(self.first)
        many = self.first[number + 1] - self.first[number] if len(number) else number
        ends = np.flatnonzero(np.diff(doc, append=-1)) + 1  # of the texts
        upto, a = np.cumsum(many), 0
        while a < len(doc):
            before = upto[a] - many[a]
            b = int(ends[max(np.searchsorted(ends, a, "right"), np.searchsorted(upto[ends - 1], before + STEP, "right") - 1)])
            part = np.repeat(np.arange(a, b), many[a:b])
            place = self.places[self.first[number[part]] + np.arange(len(part)) - np.repeat(upto[a:b] - many[a:b] - before, many[a:b])]
            item, text = np.searchsorted(self.bounds, place, "right") - 1, doc[part]
            order = np.lexsort((place, text))  # places of an item are neighbours
            place, item, text = place[order], item[order], text[order]
            same = (item[1:] == item[:-1]) & (text[1:] == text[:-1])
            under = np.full(len(place), self.size)
            under[:-1][same] = np.minimum(np.diff(place)[same], self.size)
            starts = np.flatnonzero(np.concatenate([[True], ~same]))
            most = np.add.reduceat(under, starts)
            for s in starts[most >= self.threshold * np.diff(self.bounds)[item[starts]]].tolist():
                yield int(text[s]), int(item[s])
            a = b

    def _seeds(self, scan: W.Scan, keys: np.ndarray, number: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """A text's windows that any item has: number, key of the word before, whether there is one, and place, in that order."""
        led = at > scan.bounds[k]
        before = np.where(led, keys[at - 1], np.uint64(0))
        order = np.lexsort((at, before, led, number[at]))
        return number[at][order], before[order], led[order], at[order]

    def _matches(self, running: W.Running, item: int, number: np.ndarray, before: np.ndarray, led: np.ndarray, at: np.ndarray, base: int, end: int) -> list[tuple[int, int, int]]:
        """Maximal matches of an item and a text whose seeds are given. At most so many of one item place and one length
        are kept, the first in the text, that tiles can't have covered them all before the last one's turn comes."""
        a, b = int(self.bounds[item]), int(self.bounds[item + 1])
        found = []
        for i in range(a, b - self.size + 1):
            lo, hi = np.searchsorted(number, self.number[i], "left"), np.searchsorted(number, self.number[i], "right")
            if lo == hi:
                continue
            j = at[lo:hi]
            if i > a:  # a seed that goes on one before it begins nothing
                j = j[~led[lo:hi] | (before[lo:hi] != self.keys[i - 1])]
            low, high = np.full(len(j), self.size), np.minimum(b - i, end - j)
            while (open_ := np.flatnonzero(low < high)).size:
                middle = (low[open_] + high[open_] + 1) // 2
                same = self.running.hashes(np.full(len(open_), i), middle) == running.hashes(j[open_], middle)
                low[open_[same]] = middle[same]
                high[open_[~same]] = middle[~same] - 1
            order = np.lexsort((j, -low))
            j, n = j[order], low[order]
            turn = np.arange(len(n)) - np.searchsorted(-n, -n, "left")
            kept = turn <= (b - a) + (b - a) // self.size * n
            found += [(i - a, x - base, y) for x, y in zip(j[kept].tolist(), n[kept].tolist(), strict=True)]
        return found


def _blocks(items: DataFrame, item_id: str, item_text: str) -> Iterator[tuple[list[tuple], bool]]:
    """The items in blocks of about BLOCK_WORDS words, each gathered on its own when its turn comes; whether there are more than one."""
    rows = items.select(F.col(item_id).alias("id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    words = rows.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0
    n = max(1, -(-int(words) // BLOCK_WORDS))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        yield [tuple(r) for r in part.sort("id", "text").collect()], n > 1


_TILES = pa.list_(pa.struct([("item_word", pa.int64()), ("text_word", pa.int64()), ("n_words", pa.int64())]))


def contaminated(docs: DataFrame, items: DataFrame, min_match: int = 4, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each text and item whose tiles of at least ``min_match`` words cover ``threshold`` of the item's words.

    Columns: document id, item id, coverage, n_tiles, n_words (covered) and tiles (item_word, text_word, n_words).
    Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. Items of fewer than ``min_match``
    words match nothing, for they are no evidence; nor do null or empty texts on either side. Null ids stay null,
    repeated rows give a row each, other columns are left out whatever their names, empty tables give an empty one. Of
    equally long matches the first in the item, then in the text is taken. Texts of any length are read whole. No shuffle.
    A benchmark of more than one block is gone through block by block: each one's rows are written before the next is
    gathered, so the driver holds a single block.
    """
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    item_arrow = pa.string() if item_kind == "string" else pa.int64()
    rows, found = small_batches(docs).select(F.col(id_col), F.col(text_col)), None
    for block, more in _blocks(items, item_id, item_text):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            tiler = Tiler(block, min_match, threshold)
            for batch in batches:
                hits = list(tiler.find(batch.column(1)))
                covered = [sum(n for *_, n in t) for _, _, t in hits]
                tiles = [[{"item_word": i, "text_word": j, "n_words": n} for i, j, n in t] for _, _, t in hits]
                columns = [batch.column(0).take(pa.array([r for r, *_ in hits], pa.int64())), pa.array([tiler.ids[k] for _, k, _ in hits], item_arrow)]
                columns += [pa.array([c / len(tiler.items[k]) for c, (_, k, _) in zip(covered, hits, strict=True)], pa.float64()), pa.array([len(t) for *_, t in hits], pa.int64()), pa.array(covered, pa.int64()), pa.array(tiles, _TILES)]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, item_id, "coverage", "n_tiles", "n_words", "tiles"])

        ddl = f"`{id_col}` {kind}, `{item_id}` {item_kind}, coverage double, n_tiles long, n_words long, tiles array<struct<item_word: long, text_word: long, n_words: long>>"
        part = rows.mapInArrow(run, ddl)
        part = materialize(part, "tiles") if more else part
        found = part if found is None else found.unionByName(part)
    return found


def decontaminate(docs: DataFrame, items: DataFrame, min_match: int = 4, threshold: float = 0.5, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs``, all columns, without the rows that ``contaminated`` would name. Rows are judged where they are: no join.

    Null and empty texts and null ids stay; of repeated rows all stay or all go; ties are ``contaminated``'s; columns may
    have any names, for rows pass through as they are; an empty table or an empty benchmark leaves ``docs`` as it is.
    """
    for block, more in _blocks(items, item_id, item_text):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            tiler = Tiler(block, min_match, threshold)
            for batch in batches:
                keep = np.ones(len(batch), bool)
                keep[[r for r, *_ in tiler.find(batch.column(text_col))]] = False
                yield batch.filter(pa.array(keep))

        docs = small_batches(docs).mapInArrow(run, docs.schema)
        docs = materialize(docs, "clean") if more else docs
    return docs
