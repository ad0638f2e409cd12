import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from quillmark.llm import languages as L

SCHEMA = "doc_id long, text string, lang string, lang_pred string, score int"
TABLES = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{TABLES}/documents.parquet")


@pytest.fixture(scope="module")
def net(docs):
    return L.fit(docs.where(~L.held_out()), rows=1200)


def test_held_out_accuracy(docs, net):
    got = L.identify(docs, net).join(docs.where(L.held_out()).select("doc_id", "lang"), "doc_id").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert got[1] > 250 and got[0] > 0.97


def test_tables_equal_plain_convolution(net):
    rng = np.random.default_rng(1)
    text = bytes(rng.integers(1, 256, 3 * L.WINDOW + 17, dtype=np.uint8))
    windows, owner, held = L.cut_windows(np.frombuffer(text * 2, np.uint8), np.array([0, len(text), len(text), 2 * len(text)]))
    assert held.sum() == 2 * len(text) and owner.tolist() == [0] * 4 + [2] * 4
    assert b"".join(w[:n].tobytes() for w, n in zip(windows, held, strict=True)) == text * 2
    for w, p in zip(windows, net.probabilities(windows, net.tables()), strict=True):
        hidden = [max(np.concatenate([net.embedding[w[t + k]] for k in range(width)]) @ f[:, j] for t in range(L.WINDOW)) for width, f in zip(L.WIDTHS, net.filters, strict=True) for j in range(L.FILTERS)]
        z = np.maximum(np.array(hidden) + net.bias, 0) @ net.weights + net.offset
        assert np.allclose(p, np.exp(z) / np.exp(z).sum(), atol=1e-4)


def test_long_text_in_pieces(net):
    identifier, text = L.Identifier(net), "the thing with of and " * 900
    column = pa.array(["a", text, None, text])
    one, many = identifier.batch(column), identifier.batch(column, block=1000)
    assert one[0] == many[0] and np.allclose(one[1], many[1])


def test_edges(spark, docs, net):
    german = docs.where("lang = 'de' and length(text) > 2000").sort("doc_id").first().text
    rows = [(0, None, "en", "", 1), (1, "", "en", "", 1), (2, "12 %%% 3.", None, "", 1), (None, "the thing", "en", "", 1), (4, "the thing", "en", "", 1), (4, "the thing", "en", "", 1), (5, german * 100, "de", "", 1)]
    table = spark.createDataFrame(rows, SCHEMA)
    got = L.identify(table, net).collect()
    assert [r.lang_pred for r in got][:3] == ["und"] * 3 and [r.score for r in got][:3] == [0] * 3
    assert got[3].lang_pred == got[4].lang_pred == got[5].lang_pred == "en" and got[6].lang_pred == "de" and all(0 <= r.score <= 1 for r in got)
    kept = L.keep_identified(table, net)
    assert kept.schema == table.schema and kept.count() == 4
    assert L.identify(table.limit(0), net).collect() == []
    assert L.fit(table.limit(0)) is None and {r.lang_pred for r in L.identify(table, None).collect()} == {"und"}
    only = L.fit(table.where("lang = 'en'"))
    assert {r.lang_pred for r in L.identify(table, only).collect()} == {"und", "en"}


def test_sample_is_bounded(docs):
    languages, sample = L.labelled_sample(docs, rows=40, windows=2)
    assert languages == ["de", "en", "es", "fr"] and len(sample) <= 80
    assert L.labelled_sample(docs.repartition(7), rows=40, windows=2) == (languages, sample)
