"""Language identification by a byte convolutional network, trained here in numpy.

A window of bytes is embedded, convolved with filters of several widths, pooled by maximum and classified by softmax.
A text is cut into windows without gaps; their probabilities, weighted by their bytes, are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import small_batches
from .words import utf8

WINDOW, EMBEDDING, WIDTHS, FILTERS = 192, 8, (2, 3, 4), 12
REACH = max(WIDTHS) - 1
UNKNOWN = "und"

#: At most so many labelled rows are fitted, equally many of each language, and so many windows of each row.
SAMPLE_ROWS, SAMPLE_WINDOWS = 8000, 3

_LETTER = regex.compile(r"\p{L}").search


@dataclass
class Network:
    """Weights; ``table`` holds for each pair of bytes what the filters get from their first and from their later two."""

    languages: list[str]
    embedding: np.ndarray  # 256 x EMBEDDING
    filters: list[np.ndarray]  # for each width: (width * EMBEDDING) x FILTERS
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        by_place = np.zeros((4, 256, FILTERS * len(WIDTHS)), np.float32)
        for n, (width, filters) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            for k in range(width):
                by_place[k, :, n * FILTERS : (n + 1) * FILTERS] = self.embedding @ filters[k * EMBEDDING : (k + 1) * EMBEDDING]
        first, second = ((by_place[k][:, None] + by_place[k + 1][None]).reshape(65536, -1) for k in (0, 2))
        return first + self.bias, second

    def probabilities(self, windows: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Of windows (n x (WINDOW + REACH) bytes, zeros after the text)."""
        out = []
        for k in range(0, len(windows), 32):
            part = windows[k : k + 32].astype(np.int32)
            pairs = part[:, :-1] * 256 + part[:, 1:]
            response = tables[0][pairs[:, :WINDOW]]
            response += tables[1][pairs[:, 2 : WINDOW + 2]]
            out.append(_softmax(np.maximum(response.max(1), 0) @ self.weights + self.offset))
        return np.concatenate(out)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], steps: int = 1800, batch: int = 64, rate: float = 4e-3, seed: int = 7) -> Network:
    """Adam on the cross entropy; gradients reach only the window places that won the pooling."""
    rng = np.random.default_rng(seed)
    net = Network(
        languages, rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32), [rng.normal(0, (w * EMBEDDING) ** -0.5, (w * EMBEDDING, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(FILTERS * len(WIDTHS), np.float32), rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32), np.zeros(len(languages), np.float32),
    )
    values = [net.embedding, *net.filters, net.bias, net.weights, net.offset]
    moments, squares, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    while step < steps:
        order = rng.permutation(len(windows))
        for k in range(0, len(order), batch):
            x, y = windows[order[k : k + batch]], labels[order[k : k + batch]]
            n, row = len(x), np.arange(len(x))[:, None]
            embedded = net.embedding[x]
            best, pooled = [], []
            for width, filters in zip(WIDTHS, net.filters, strict=True):
                patches = np.lib.stride_tricks.sliding_window_view(embedded, width, 1)[:, :WINDOW].transpose(0, 1, 3, 2).reshape(n, WINDOW, -1)
                response = patches.reshape(-1, width * EMBEDDING) @ filters
                response = response.reshape(n, WINDOW, FILTERS)
                best.append(response.argmax(1))
                pooled.append(np.take_along_axis(response, best[-1][:, None], 1)[:, 0])
            total = np.concatenate(pooled, 1) + net.bias
            hidden = np.maximum(total, 0)
            error = _softmax(hidden @ net.weights + net.offset)
            error[np.arange(n), y] -= 1
            error /= n
            back = (error @ net.weights.T) * (total > 0)
            grads = [np.zeros_like(net.embedding), *(np.zeros_like(f) for f in net.filters), back.sum(0), hidden.T @ error, error.sum(0)]
            for m, (width, filters) in enumerate(zip(WIDTHS, net.filters, strict=True)):
                g = back[:, m * FILTERS : (m + 1) * FILTERS]
                for j in range(width):
                    place = best[m] + j
                    rows = slice(j * EMBEDDING, (j + 1) * EMBEDDING)
                    grads[1 + m][rows] = np.einsum("nf,nfd->df", g, embedded[row, place])
                    np.add.at(grads[0], x[row, place].ravel(), (g[:, :, None] * filters[rows].T[None]).reshape(-1, EMBEDDING))
            step += 1
            for value, grad, m1, m2 in zip(values, grads, moments, squares, strict=True):
                m1 += 0.1 * (grad - m1)
                m2 += 0.001 * (grad * grad - m2)
                value -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return net


def cut_windows(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the texts in ``data``, the text of each, and how many of its bytes it holds."""
    sizes = np.diff(bounds)
    many = -(-sizes // WINDOW)
    text = np.repeat(np.arange(len(sizes)), many)
    start = bounds[:-1][text] + WINDOW * (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many))
    held = np.minimum(bounds[1:][text] - start, WINDOW)
    place = start[:, None] + np.arange(WINDOW + REACH)
    windows = np.concatenate([data, np.zeros(1, np.uint8)])[np.where(np.arange(WINDOW + REACH) < held[:, None], place, len(data))]
    return windows, text, held


def labelled_sample(docs: DataFrame, rows: int = SAMPLE_ROWS, windows: int = SAMPLE_WINDOWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], list[tuple[str, str]]]:
    """The labels, and (label, piece of text) of at most ``rows`` rows, chosen by a hash of their ids: as many of each label.

    Every label has a row, unless there are more labels than ``rows``; then those of the most rows do.
    """
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    counts = {r.lang: r["count"] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(rows).collect()}
    if not counts:
        return [], []
    each = max(1, rows // len(counts))
    chosen, pick = F.xxhash64("id", F.lit("sample")), F.pmod(F.xxhash64("id", F.lit("share")), F.lit(1 << 30))
    shares = docs.sparkSession.createDataFrame([(lang, int(min(1.0, 1.5 * each / n) * (1 << 30))) for lang, n in counts.items()], f"lang {labelled.schema['lang'].dataType.simpleString()}, share long")
    some = labelled.join(F.broadcast(shares), "lang").where(pick < F.col("share"))  # as many rows as labels, ``rows`` at most
    few = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(chosen, "id", "text"))).where(F.col("rank") <= each)
    pieces = [F.substring("text", F.lit(1) + F.pmod(F.xxhash64("id", F.lit(k)), F.greatest(F.lit(1), F.length("text") - WINDOW + 1)).cast("int"), WINDOW) for k in range(windows)]
    found = few.select("lang", F.explode(F.array(*pieces)).alias("piece")).collect()
    return sorted(counts), sorted((r.lang, r.piece) for r in found)


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS, **columns: str) -> Network | None:
    """A network from a bounded sample of the labelled rows; None if there are none."""
    languages, sample = labelled_sample(docs, rows, **columns)
    if not sample:
        return None
    number = {lang: k for k, lang in enumerate(languages)}
    windows = np.zeros((len(sample), WINDOW + REACH), np.uint8)
    for k, (_, piece) in enumerate(sample):
        data = piece.encode()[:WINDOW]
        windows[k, : len(data)] = np.frombuffer(data, np.uint8)
    return train(windows, np.array([number[lang] for lang, _ in sample]), languages)


class Identifier:
    """A network made ready for batches of texts."""

    def __init__(self, net: Network | None):
        self.net, self.tables = net, net and net.tables()

    def batch(self, column: pa.Array, block: int = 1 << 20) -> tuple[list[str], np.ndarray]:
        """The language and the score of each text."""
        names, scores = [], []
        data, offsets = utf8(column)
        at, n = 0, len(offsets) - 1
        while at < n and self.net:
            to = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + block, "right")) - 1))
            total = np.zeros((to - at, len(self.net.languages)))
            bytes_ = np.maximum(np.diff(offsets[at : to + 1]), 1)
            for part in range(at, to):  # a text longer than a block goes in pieces of whole windows
                if offsets[part + 1] - offsets[part] > block:
                    step = block // WINDOW * WINDOW
                    for s in range(int(offsets[part]), int(offsets[part + 1]), step):
                        self._add(total, data, np.array([s, min(s + step, offsets[part + 1])]), np.array([part - at]))
            if to - at > 1 or offsets[to] - offsets[at] <= block:
                self._add(total, data, offsets[at : to + 1], np.arange(to - at))
            total /= bytes_[:, None]
            names += [self.net.languages[k] for k in total.argmax(1)]
            scores.append(total.max(1))
            at = to
        if not self.net:
            names, scores = [UNKNOWN] * n, [np.zeros(n)]
        score = np.minimum(np.concatenate([np.zeros(0), *scores]), 1.0)
        for k, text in enumerate(column):
            if not (t := text.as_py()) or not _LETTER(t):
                names[k], score[k] = UNKNOWN, 0.0
        return names, score

    def _add(self, total: np.ndarray, data: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> None:
        windows, text, held = cut_windows(data[bounds[0] : bounds[-1]], bounds - bounds[0])
        if len(windows):
            np.add.at(total, rows[text], self.net.probabilities(windows, self.tables) * held[:, None])


def held_out(id_col: str = "doc_id"):
    """Whether a row stays out of the training: the CRC-32 of its id as text leaves 1 when divided by 3; a null id doesn't."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of ``docs``: the id, lang_pred and score (0 to 1), from the whole text alone.

    Null texts and texts without a letter: ``und`` with score 0; so are all texts where there is no network. Of equal
    scores the first language in alphabetical order is given. Null ids stay null, repeated rows give a row each, other
    columns are left out, an empty table gives an empty one. One pass, no shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identifier = Identifier(net)
        for batch in batches:
            names, score = identifier.batch(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score)], names=[id_col, "lang_pred", "score"])

    return small_batches(docs).select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, net: Network | None, min_score: float = 0.4, text_col: str = "text") -> DataFrame:
    """``docs``, all columns, without the rows whose language is unknown or scores under ``min_score``.

    Null texts and texts without a letter go; null ids, repeated rows and columns of any name pass through as they are;
    an empty table gives an empty one. A score of exactly ``min_score`` stays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identifier = Identifier(net)
        for batch in batches:
            names, score = identifier.batch(batch.column(text_col))
            yield batch.filter(pa.array((np.array(names, object) != UNKNOWN) & (score >= min_score), pa.bool_()))

    return small_batches(docs).mapInArrow(run, docs.schema)
