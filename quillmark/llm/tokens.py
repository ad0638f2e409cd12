"""Tokenizers on executors: exact ids of whole texts, with a table of chunks that are already encoded.

A byte-level BPE tokenizer without a normalizer never merges across its pre-tokens. Where a single space follows another
character, around a single line end, and between letters, digits and punctuation (the apostrophe aside), a pre-token
surely begins. Texts are cut there, by numpy over their bytes, and a chunk is encoded by the library once while the
table holds it. Texts with neighbouring white space or with a special string are one chunk each, and so are all texts
of other tokenizers.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .words import BLOCK, ends_of, mixed_keys, utf8

#: Chunks that a table holds before it is emptied; up to 60 bytes each, ids included.
KEPT = 500_000

_SPACE, _LINE, _BLANK, _LETTER, _DIGIT, _PUNCT, _QUOTE, _OTHER = range(8)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[:128] = _PUNCT  # control characters too: neither white space nor letter nor number
_CLASS[[9, 11, 12, 13, *range(28, 32)]] = _BLANK
_CLASS[32], _CLASS[10], _CLASS[39] = _SPACE, _LINE, _QUOTE
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_BETWEEN = (_LETTER, _DIGIT, _PUNCT)
#: By the classes of a byte and the next one: whether a chunk begins between them. Not next to _OTHER, which may be anything.
_CUT = np.zeros((8, 8), bool)
for _a in _BETWEEN:
    _CUT[_a, [b for b in _BETWEEN if b != _a]] = True
_CUT[[*_BETWEEN, _QUOTE], _SPACE] = _CUT[[*_BETWEEN, _QUOTE], _LINE] = True
_CUT[_LINE, [*_BETWEEN, _QUOTE]] = True

_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+").fullmatch  # letters only


def _cuts(data: np.ndarray, bounds: np.ndarray, special: list[bytes]) -> np.ndarray:
    """Where chunks begin in the bytes of texts that begin at ``bounds`` (the last one ends the data)."""
    kind = _CLASS[data]
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC9))  # U+00C0 to U+024F in two bytes
    kind[lead] = kind[lead + 1] = _LETTER
    sign = lead[(data[lead] == 0xC3) & ((data[lead + 1] == 0x97) | (data[lead + 1] == 0xB7))]  # multiplication, division
    kind[sign] = kind[sign + 1] = _OTHER
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = _CUT.ravel()[kind[:-1] * np.uint8(8) + kind[1:]]
    blank = kind <= _BLANK
    pairs = np.flatnonzero(blank[1:] & blank[:-1])
    whole = set(np.unique(np.searchsorted(bounds, pairs, "right") - 1).tolist())
    for s in special:
        text, at = data.tobytes(), -1
        while (at := text.find(s, at + 1)) >= 0:
            whole.add(int(np.searchsorted(bounds, at, "right")) - 1)
    for doc in whole:
        cut[bounds[doc] : bounds[doc + 1]] = False
    cut[bounds] = True
    return np.flatnonzero(cut)


@dataclass
class _Chunks:
    """Chunks of up to 16 bytes: a hash of each, and what they are, namely their first and last eight bytes and their sizes."""

    hashes: np.ndarray
    parts: tuple[np.ndarray, np.ndarray, np.ndarray]

    def at(self, k: np.ndarray) -> _Chunks:
        return _Chunks(self.hashes[k], tuple(x[k] for x in self.parts))


class _Table:
    """Chunks to places in a pool of ids, by open addressing; whole arrays are looked up and stored at once.

    The bytes of a chunk are compared, not its hash alone.
    """

    def __init__(self, room: int):
        self.room, self.bits = room, int(np.ceil(np.log2(2 * room)))
        self.empty()

    def empty(self) -> None:
        n = 1 << self.bits
        self.parts = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.uint8)  # size 0: free
        self.slots = np.zeros((n, 2), np.int32)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.held = self.used = 0

    def _slot(self, chunks: _Chunks) -> np.ndarray:
        return (chunks.hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def _same(self, slot: np.ndarray, chunks: _Chunks) -> np.ndarray:
        return (self.parts[0][slot] == chunks.parts[0]) & (self.parts[1][slot] == chunks.parts[1]) & (self.parts[2][slot] == chunks.parts[2])

    def find(self, chunks: _Chunks) -> np.ndarray:
        """The slot of each chunk, or -1."""
        slot = self._slot(chunks)
        found = np.where(self._same(slot, chunks), slot, -1)
        todo = np.flatnonzero((found < 0) & (self.parts[2][slot] != 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            same = self._same(slot[todo], chunks.at(todo))
            found[todo[same]] = slot[todo[same]]
            todo = todo[~same & (self.parts[2][slot[todo]] != 0)]
        return found

    def add(self, ids: list[list[int]]) -> np.ndarray:
        """Puts ids into the pool; gives (place, number) of each."""
        sizes = np.array([len(x) for x in ids], np.int64)
        n = int(sizes.sum())
        if self.used + n > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(n, len(self.pool)), np.uint32)])
        self.pool[self.used : self.used + n] = [t for x in ids for t in x]
        places = self.used + np.cumsum(sizes) - sizes
        self.used += n
        return np.stack([places, sizes], 1)

    def store(self, chunks: _Chunks, places: np.ndarray) -> None:
        """Stores distinct chunks that aren't held."""
        slot, todo = self._slot(chunks), np.arange(len(places))
        self.held += len(places)
        while len(todo):
            free = todo[self.parts[2][slot[todo]] == 0]
            _, first = np.unique(slot[free], return_index=True)
            free = free[first]
            for own, new in zip(self.parts, chunks.parts, strict=True):
                own[slot[free]] = new[free]
            self.slots[slot[free]] = places[free]
            todo = np.setdiff1d(todo, free, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)


@dataclass
class Ids:
    """The ids of the texts ``first .. first + len(bounds) - 1`` of a column, in a row; ``bounds``: before each text, and all."""

    first: int
    flat: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def ended(self, end_id: int) -> Ids:
        """With an id after each text."""
        n = len(self.bounds) - 1
        flat = np.insert(self.flat, self.bounds[1:], np.uint32(end_id)) if n else self.flat
        return Ids(self.first, flat, self.bounds + np.arange(n + 1))


def _byte_letters() -> list[str]:
    """The character by which byte-level vocabularies write each byte: itself where printable, else from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class Encoder:
    """Ids as the library of a tokenizer file gives them: tokenizers for .json files, sentencepiece for .model files.

    No begin, end or added special tokens; special strings in a text are handled as the library does by default, and
    nothing is truncated or padded. Chunks are told apart by their bytes.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self._cut = False
        if path.endswith(".model"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self._encode: Callable[[str], list[int]] = lambda text: pieces.encode(text, num_threads=1)
            return
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        self._encode = lambda text: library.encode(text, add_special_tokens=False).ids
        self._merge, self._letters = library.model.tokenize, dict(enumerate(_byte_letters()))
        self._special = [t.content.encode() for t in library.get_added_tokens_decoder().values()]
        kind = json.loads(library.to_str())
        before = kind["pre_tokenizer"] or {}
        if kind["normalizer"] is None and kind["post_processor"] is None and kind["model"]["type"] == "BPE" and before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]:
            self._cut, self._table, self._long = True, _Table(KEPT), {}

    def _chunk(self, chunk: bytes) -> list[int]:
        """The ids of a chunk. Latin letters, after a space or not, are one pre-token, which the model takes as it is."""
        text = chunk.decode()
        word = text[1:] if text[:1] == " " else text
        if not _LATIN(word):
            return self._encode(text)
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self._letters)
        return [t.id for t in self._merge(self._letters[32] + word if text[0] == " " else word)]

    def ids(self, text: str) -> list[int]:
        return next(self.batch(pa.array([text], pa.string()))).flat.tolist()

    def batch(self, column: pa.Array) -> Iterator[Ids]:
        """The ids of all texts of a column, in blocks of whole texts; null counts as empty."""
        data, offsets = utf8(column)
        at, n = 0, len(offsets) - 1
        while at < n:
            to = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, "right")) - 1))
            block, bounds = data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            if self._cut:
                yield self._by_chunks(at, block, bounds)
            else:
                texts = [self._encode(block[a:b].tobytes().decode()) for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]
                yield Ids(at, np.array([t for x in texts for t in x], np.uint32), np.cumsum([0, *map(len, texts)]))
            at = to

    def _by_chunks(self, first: int, data: np.ndarray, bounds: np.ndarray) -> Ids:
        if not len(data):
            return Ids(first, np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64))
        if self._table.held > self._table.room - len(data) // 8:
            self._table.empty()
            self._long.clear()
        place = _cuts(data, bounds, self._special)
        starts, ends = place[:-1], place[1:]
        sizes = ends - starts
        short = np.flatnonzero(sizes <= 16)
        head, tail, _ = ends_of(data, starts[short], ends[short])
        chunks = _Chunks(mixed_keys(data, starts[short], ends[short]), (head, tail, sizes[short].astype(np.uint8)))
        slots = np.full(len(sizes), -1)
        slots[short] = self._table.find(chunks)
        missing = np.flatnonzero(slots[short] < 0)
        if len(missing):
            text, new = data.tobytes(), {}
            for k, a, b in zip(missing.tolist(), starts[short[missing]].tolist(), ends[short[missing]].tolist(), strict=True):
                new.setdefault(text[a:b], k)
            self._table.store(chunks.at(np.array(list(new.values()))), self._table.add([self._chunk(c) for c in new]))
            slots[short[missing]] = self._table.find(chunks.at(missing))
        where = self._table.slots[np.maximum(slots, 0)].astype(np.int64)
        for k in np.flatnonzero(sizes > 16).tolist():
            chunk = data[starts[k] : ends[k]].tobytes()
            if (held := self._long.get(chunk)) is None:
                held = tuple(self._table.add([self._chunk(chunk)])[0].tolist())
                if len(chunk) <= 64 and len(self._long) < KEPT // 8:
                    self._long[chunk] = held
            where[k] = held
        after = np.cumsum(where[:, 1])
        total = int(after[-1])
        flat = self._table.pool[np.repeat(where[:, 0] - after + where[:, 1], where[:, 1]) + np.arange(total)]
        before = np.concatenate([[0], after])
        if self._table.used > 8 * KEPT:  # long chunks that aren't kept fill the pool too
            self._table.empty()
            self._long.clear()
        return Ids(first, flat, before[np.searchsorted(starts, bounds)])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a file; Python workers keep it from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def version(path: str) -> str:
    """A digest of what decides the ids: the tokenizer file and the library's version."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    with open(path, "rb") as file:
        return hashlib.sha256(file.read() + f"{library.__name__} {library.__version__}".encode()).hexdigest()
