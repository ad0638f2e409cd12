"""Vectorised word scanning over Arrow text columns.

A batch of texts is one byte buffer; words are runs of word bytes in it. Everything per byte or per word is a numpy
operation, so a text is scanned at memory speed and no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes scanned at a time: the temporary arrays are some tens of times as large, and should stay in a processor's cache.
BLOCK = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: [0-9A-Za-z] and every byte of a character beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

#: Every byte but white space.
INK = np.ones(256, bool)
INK[[9, 10, 11, 12, 13, 32]] = False

_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


#: Bytes up to which the middle of a word is mixed in eight at a time; longer words are hashed one by one.
_STEPWISE = 64


def ends_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first and the last eight bytes of stretches of bytes as numbers (shorter ones padded), and all eight-byte runs."""
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[8:-8] = data
    eight = np.lib.stride_tricks.as_strided(padded, (len(padded) - 7, 8), (1, 1))
    sizes = ends - starts
    head = np.ascontiguousarray(eight[starts + 8]).view("<u8").ravel() & _MASKS[np.minimum(sizes, 8)]
    short = np.uint64(8) * (8 - np.minimum(sizes, 8)).astype(np.uint64)
    tail = np.ascontiguousarray(eight[ends]).view("<u8").ravel()
    return head, np.where(sizes == 0, np.uint64(0), tail >> np.minimum(short, np.uint64(63))), eight


def mixed_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Keys of the stretches ``starts .. ends`` of bytes, of all their bytes; see ``Scan.keys``."""
    head, tail, eight = ends_of(data, starts, ends)
    sizes = ends - starts
    key = head * _C1 + (tail ^ (tail >> np.uint64(29))) * _C2 + sizes.astype(np.uint64) * _C3
    left, at = np.flatnonzero((sizes > 16) & (sizes <= _STEPWISE)), 8
    while len(left):
        middle = np.ascontiguousarray(eight[starts[left] + at + 8]).view("<u8").ravel()
        key[left] = (key[left] ^ (key[left] >> np.uint64(31))) * _C2 + (middle ^ (middle >> np.uint64(29))) * _C3
        at += 8
        left = left[sizes[left] - 8 > at]  # the last eight bytes are in already
    for k in np.flatnonzero(sizes > _STEPWISE).tolist():
        key[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes())
    key ^= key >> np.uint64(32)
    key *= _C1
    return key ^ (key >> np.uint64(29))


@dataclass
class Scan:
    """Words of the texts ``first .. first + len(counts)`` of a batch."""

    first: int
    data: np.ndarray  # lower-cased bytes
    starts: np.ndarray  # of each word, into data
    ends: np.ndarray
    bounds: np.ndarray  # words before each text, and at last all of them

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def keys(self) -> np.ndarray:
        """A 64-bit key of each whole word; two words get the same one by a chance of 2**-64. Who needs certainty compares ``word``."""
        return mixed_keys(self.data, self.starts, self.ends)

    def word(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]].tobytes()

    def words(self, a: int, b: int) -> list[bytes]:
        return [self.data[s:e].tobytes() for s, e in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist(), strict=True)]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a text column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    where = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), where


def scans(column: pa.Array, word_bytes: np.ndarray = ALNUM) -> Iterator[Scan]:
    """Scans all texts of a column, in blocks of whole texts of about BLOCK bytes."""
    data, offsets = utf8(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, "right")) - 1)
        to = min(to, n)
        block, cuts = LOWER[data[offsets[at] : offsets[to]]], offsets[at : to + 1] - offsets[at]
        inside = word_bytes[block]
        edge = np.zeros(len(block) + 1, bool)
        edge[1:-1] = inside[1:] != inside[:-1]
        edge[cuts] = True  # a word ends with its text
        place = np.flatnonzero(edge)
        runs, ends = place[:-1], place[1:]
        if len(runs):
            words = inside[runs]
            starts, ends = runs[words], ends[words]
        else:
            starts = ends = np.zeros(0, np.int64)
        yield Scan(at, block, starts, ends, np.searchsorted(starts, cuts))
        at = to


_RADIX = 0x9E3779B97F4A7C15  # odd, so it has an inverse


class Running:
    """A running Karp-Rabin hash over word keys: prefix sums, from which the hash of any window follows in one step."""

    def __init__(self, keys: np.ndarray):
        n = len(keys)
        self.power, self.inverse = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, r, np.uint64))]) for r in (np.uint64(_RADIX), np.uint64(pow(_RADIX, -1, 1 << 64))))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(keys * self.power[:n], dtype=np.uint64)])

    def hashes(self, starts: np.ndarray, sizes: np.ndarray | int) -> np.ndarray:
        """The hash of each window, which depends on its words alone."""
        value = (self.sums[starts + sizes] - self.sums[starts]) * self.inverse[starts]
        return value ^ (value >> np.uint64(31))

    def windows(self, size: int) -> np.ndarray:
        """The hashes of all windows of ``size`` words."""
        return self.hashes(np.arange(max(0, len(self.sums) - size)), size)


def keys_of(words: list[bytes]) -> np.ndarray:
    """The keys of given words, as ``Scan.keys`` makes them."""
    text = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words], dtype=np.int64) - 1
    starts = ends - [len(w) for w in words]
    return Scan(0, np.frombuffer(text, np.uint8), starts, ends, np.array([0, len(words)])).keys() if words else np.zeros(0, np.uint64)


class Lookup:
    """Word keys to numbers from 1 (0: unknown), by one probe of a direct-address table and one comparison."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.concatenate([np.zeros(1, np.uint64), np.unique(keys)])
        self.bits = max(10, int(np.ceil(np.log2(max(1, len(self.keys))))) + 3)
        self.shift = np.uint64(64 - self.bits)
        order = np.argsort(self.keys[1:] >> self.shift, kind="stable") + 1
        slots = (self.keys[order] >> self.shift).astype(np.int64)
        self.sorted = self.keys[order]
        self.number = order.astype(np.int32)
        self.first = np.searchsorted(slots, np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.depth = int(np.diff(self.first).max(initial=0))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int32)
        if not len(self.sorted):
            return out
        slots = (keys >> self.shift).astype(np.int64)
        first = self.first[slots]
        busy = np.flatnonzero(self.first[slots + 1] > first)
        first, last, wanted = first[busy], self.first[slots[busy] + 1], keys[busy]
        for k in range(self.depth):
            at = first + k
            hit = (at < last) & (self.sorted[np.minimum(at, len(self.sorted) - 1)] == wanted)
            out[busy[hit]] = self.number[at[hit]]
        return out
