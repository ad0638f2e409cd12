"""License scans: a generalised suffix automaton of license words, matching statistics, and chained template spans.

The templates' words make one suffix automaton. Each text streams through it; after each word it holds the longest
run of words ending there that occurs in a template (the matching statistic); the suffix links of its state give the
shorter ones that other places of templates have. Base phrases are read off it exactly. Right-maximal matches of some
length are chained, template by template, in text and template order, and a template that a chain covers well enough gives
its label and a span of the text. Of overlapping spans with different labels the better covered one counts, so that the
words which decide between versions do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .storage import small_batches

# The base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Notices that licenses ask for, as they are commonly published, and one-line mentions.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc-sa", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license"),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0"),
    ("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4 0 international license"),
    ("cc-by-nc-nd", "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-3", "it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-2", "it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


@dataclass
class Automaton:
    """A generalised suffix automaton; ``places`` has for each state where its strings end in the templates."""

    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    size: list[int] = field(default_factory=lambda: [0])
    places: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])

    def _state(self, step: dict[int, int], link: int, size: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.size.append(size)
        self.places.append([])
        return len(self.step) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        copy = self._state(dict(self.step[q]), self.link[q], self.size[p] + 1)
        self.link[q] = copy
        while p >= 0 and self.step[p].get(word) == q:
            self.step[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: int) -> int:
        q = self.step[last].get(word)
        if q is not None:  # known from an earlier template
            return q if self.size[q] == self.size[last] + 1 else self._split(last, q, word)
        new, p = self._state({}, 0, self.size[last] + 1), last
        while p >= 0 and word not in self.step[p]:
            self.step[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][word]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, q, word)
        return new

    @classmethod
    def of(cls, templates: list[list[int]]) -> Automaton:
        a = cls()
        for words in templates:
            last = 0
            for w in words:
                last = a._extend(last, w)
        for t, words in enumerate(templates):
            s = 0
            for end, w in enumerate(words, 1):
                s = a.step[s][w]
                p = s
                while p > 0:
                    a.places[p].append((t, end))
                    p = a.link[p]
        return a

    def stream(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """After each word the state and the length of the longest match ending there."""
        s = n = 0
        for w in words:
            while s and w not in self.step[s]:
                s = self.link[s]
                n = self.size[s]
            if w in self.step[s]:
                s, n = self.step[s][w], n + 1
            else:
                s = n = 0
            yield s, n


class Scanner:
    """Templates made ready for batches of texts."""

    def __init__(self, templates=TEMPLATES, base=BASE, min_match: int = 3, min_coverage: float = 0.8, max_gap: int = 8):
        self.min_match, self.min_coverage, self.max_gap = min_match, min_coverage, max_gap
        texts = [(label, phrase.encode().split()) for phrase, label in base] + [(label, t.encode().split()) for label, t in templates]
        self.n_base = len(base)
        self.labels = [label for label, _ in texts]
        vocabulary = sorted({w for _, words in texts for w in words})
        self.lookup = W.Lookup(W.keys_of(vocabulary))
        self.number = dict(zip(vocabulary, self.lookup(W.keys_of(vocabulary)).tolist(), strict=True))
        self.spelt = {n: w for w, n in self.number.items()}
        self.templates = [[self.number[w] for w in words] for _, words in texts]
        self.automaton = Automaton.of(self.templates)
        self.pairs = np.zeros((len(vocabulary) + 1,) * 2, bool)
        for words in self.templates:
            self.pairs[words[:-1], words[1:]] = True
        #: For each state the places at which only strings of its suffix links end, with their lengths.
        a = self.automaton
        self.shorter: list[list[tuple[int, int, int]]] = [[] for _ in a.link]
        for s in range(1, len(a.link)):
            seen, p = set(a.places[s]), a.link[s]
            while p > 0 and a.size[p] >= min_match:
                self.shorter[s] += [(t, e, a.size[p]) for t, e in a.places[p] if (t, e) not in seen]
                seen.update(a.places[p])
                p = a.link[p]
        #: For each state the base phrases that are suffixes of its longest string, with their lengths.
        whole = {(t, len(self.templates[t])) for t in range(self.n_base)}
        self.base_at: list[list[tuple[int, int]]] = [[] for _ in self.automaton.link]
        for s in sorted(range(1, len(self.automaton.link)), key=self.automaton.size.__getitem__):
            inherited = self.base_at[self.automaton.link[s]]
            self.base_at[s] = sorted({*inherited, *((t, e) for t, e in self.automaton.places[s] if (t, e) in whole and e <= self.automaton.size[s])})

    def runs(self, scan: W.Scan) -> Iterator[tuple[int, int]]:
        """Stretches of words in which each neighbouring pair occurs in a template; elsewhere no match passes one word."""
        number = self.lookup(scan.keys())
        both = np.flatnonzero((number[:-1] > 0) & (number[1:] > 0))
        both = both[self.pairs[number[both], number[both + 1]]]
        cuts = np.zeros(len(number) + 1, bool)
        cuts[scan.bounds] = True
        both = both[~cuts[both + 1]]  # the second word begins another text
        if not len(both):
            return
        breaks = np.flatnonzero(np.diff(both) > 1) + 1
        for a, b in zip(np.concatenate([[0], breaks]), np.concatenate([breaks, [len(both)]]), strict=True):
            if b - a >= 2:
                yield int(both[a]), int(both[b - 1]) + 2

    def read(self, words: list[bytes], at: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
        """Base places (start, phrase) and right-maximal matches (template, its start, text start, length) of a run."""
        base, matches, before = [], [], (0, 0)
        numbers = [self.number.get(w, 0) for w in words]
        for k, (s, n) in enumerate([*self.automaton.stream(numbers), (0, 0)]):
            base += [(at + k + 1 - size, t) for t, size in self.base_at[s] if size <= n]
            state, size = before
            if size >= self.min_match:
                following = numbers[k] if k < len(numbers) else 0
                for t, end, length in [*((t, e, size) for t, e in self.automaton.places[state]), *self.shorter[state]]:
                    own = self.templates[t]
                    if t >= self.n_base and not (end < len(own) and own[end] == following):
                        matches.append((t, end - length, at + k - length, length))
            before = (s, n)
        return base, matches

    def chain(self, template: int, matches: list[tuple[int, int, int]]) -> tuple[float, int, int]:
        """The best chain of matches (template start, text start, length): covered share, text start, text end.

        Matches follow each other in both orders and at most ``max_gap`` text words apart; of an overlap only the
        rest counts. A text place ends at most one match for each place of the template, so the look-back is bounded.
        """
        best: list[tuple[int, int, int, int, int]] = []  # text end, template end, covered, text start, number
        top = (0, 0, 0)
        for q, p, n in sorted(matches, key=lambda m: (m[1] + m[2], m[0])):
            covered, start = n, p
            for e, f, c, s, _ in reversed(best):
                if e < p - self.max_gap:
                    break
                new = min(n, p + n - e, q + n - f)
                if new > 0 and s < p and c + new > covered:
                    covered, start = c + new, s
            best.append((p + n, q + n, covered, start, len(best)))
            if (covered, -(p + n - start)) > (top[0], -(top[2] - top[1])):
                top = (covered, start, p + n)
        return top[0] / len(self.templates[template]), top[1], top[2]

    @staticmethod
    def agreed(spans: list[tuple[dict, float]]) -> list[dict]:
        """Of spans and their covered words those that no better covered one of another label overlaps, nor an equally well
        covered one of more words."""
        kept: list[dict] = []
        for x, _ in sorted(spans, key=lambda x: (-x[0]["coverage"], -x[1], x[0]["label"], x[0]["first"])):
            if all(x["label"] == y["label"] or x["after"] <= y["first"] or y["after"] <= x["first"] for y in kept):
                kept.append(x)
        return [x for x, _ in spans if x in kept]

    def batch(self, column: pa.Array) -> Iterator[tuple]:
        """For each text: words, base places, first, last, base labels, labels, score, spans."""
        for scan in W.scans(column):
            found: dict[int, tuple[list, list]] = {}
            for a, b in self.runs(scan):
                doc = int(np.searchsorted(scan.bounds, a, "right")) - 1
                base, matches = self.read(scan.words(a, b), a - int(scan.bounds[doc]))
                if base or matches:
                    own = found.setdefault(doc, ([], []))
                    own[0].extend(base)
                    own[1].extend(matches)
            for doc, n in enumerate(scan.counts.tolist()):
                base, matches = found.get(doc, ((), ()))
                if not base and not matches:
                    yield n, 0, None, None, "", "", 0.0, []
                    continue
                by: dict[int, list] = {}
                for t, q, p, size in matches:
                    by.setdefault(t, []).append((q, p, size))
                chains = [(*self.chain(t, m), self.labels[t]) for t, m in sorted(by.items())]
                spans = self.agreed([({"label": label, "first": s, "after": e, "coverage": c}, c * len(self.templates[t])) for (c, s, e, label), t in zip(chains, sorted(by), strict=True) if c >= self.min_coverage])
                own = {self.labels[t] for _, t in base}
                score = 1.0 if base else min(1.0, max([c for c, *_ in chains], default=0.0))
                starts = [s for s, _ in base]
                yield n, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(own | {x["label"] for x in spans})), score, spans


_SPAN = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("after", pa.int64()), ("coverage", pa.float64())]))
_OUT = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", _SPAN)])
_DDL = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first: long, after: long, coverage: double>>"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One row per row of ``docs``: license phrases and covered template spans of its whole text.

    Columns: the id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans (label, first word,
    word after the last, covered share of the template). ``score`` is 1 where a base phrase stands, otherwise the
    largest covered share. ``settings``: see ``Scanner``. Base phrases are found at every place, overlaps included;
    matches are chained when they have ``min_match`` words.

    Null or empty text: zero words, null places, empty labels, score 0. A null id stays null; repeated rows give a row
    each; other columns are left out, whatever their names; an empty table gives an empty one. Of equally good chains
    the shorter and then the earlier span is given. No shuffle: the work is one pass over the scan's own partitions.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(**settings)
        for batch in batches:
            rows = list(scanner.batch(batch.column(1)))
            columns = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_OUT)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, *_OUT.names])

    return small_batches(docs).select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, {_DDL}")
