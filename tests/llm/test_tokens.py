import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from quillmark.llm import tokens
from quillmark.llm.token_counts import count_tokens
from quillmark.llm.token_files import file_digests, read_counts, read_range, write_token_files
from tokenizers import Tokenizer

JSON = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(JSON)
SCHEMA = "doc_id long, text string, n_tokens int, digest string"

def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids

@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(list("abzÉéßñ中ǅʰ²½٣0'.,!*%\t\r \x85\x1c") + ["'s", "'re", "<|endoftext|>", "the", "\n", " ", "  ", " the", "😀"]), max_size=30).map("".join))
def test_ids_equal_the_library(text):
    assert tokens.encoder(JSON).ids(text) == ids(text)

def test_generations(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 64)
    encoder, rng = tokens.Encoder(JSON), random.Random(3)
    for _ in range(200):
        text = " ".join(rng.choice(["one", "two,", "three.\nfour", "é", "x" * 80, "a-b"]) + str(rng.randrange(9)) for _ in range(20))
        assert encoder.ids(text) == ids(text)

def test_other_tokenizers():
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    pieces = sentencepiece.SentencePieceProcessor(model_file=model)
    lower = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for text in ("", "Two  Words.\nÜber", " <s> x"):
        assert tokens.encoder(model).ids(text) == pieces.encode(text)
        assert tokens.encoder(public_tokenizers.path("word_bpe_49k.json")).ids(text) == lower.encode(text, add_special_tokens=False).ids

TEXTS = [None, "", "a", "copy", "copy", "long " * 30000, "é ü <|endoftext|>", "word " * 511 + "x"]

@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, "clash") for i, t in enumerate(TEXTS)] + [(None, "copy", 1, ""), (3, "copy", 1, "")]
    return spark.createDataFrame(rows, SCHEMA)

def test_counts_and_cache(spark, docs, tmp_path):
    cache = f"file://{tmp_path}/cache"
    wanted = sorted(((r.doc_id, len((r.text or "").encode()), len(ids(r.text)), len(ids(r.text)) > 512) for r in docs.collect()), key=str)
    for _ in range(2):
        got = count_tokens(docs, JSON, cache)
        assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
        assert sorted(map(tuple, got.collect()), key=str) == wanted
        assert spark.read.parquet(cache).count() == len({t or "" for t in TEXTS})  # distinct contents, stored once
    more = docs.union(spark.createDataFrame([(99, "new", 1, "")], SCHEMA))
    assert count_tokens(more, JSON, cache).count() == len(wanted) + 1
    assert spark.read.parquet(cache).count() == len({t or "" for t in TEXTS}) + 1
    assert count_tokens(docs.limit(0), JSON).collect() == []

@pytest.mark.parametrize("dictionary", [True, False])
def test_files_round_trip(spark, docs, tmp_path, dictionary):
    path = f"file://{tmp_path}/ids"
    write_token_files(docs.repartition(3), path, JSON, dictionary=dictionary)
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    wanted, at = [], 0
    for r in rows:
        own = np.array([*ids(r.text), 0], "<u4")
        wanted.append((r.doc_id, at, len(own), zlib.crc32(own.tobytes())))
        at += len(own)
    assert sorted(map(tuple, file_digests(spark, path).collect()), key=lambda r: r[1]) == wanted
    assert {r.doc_id: r.ids for r in read_range(spark, path, 5, 6).collect()} == {i: [*ids(TEXTS[i]), 0] for i in (5, 6)}
    assert "ids" not in read_counts(spark, path).columns

def test_files_have_indexes(spark, docs, tmp_path):
    import glob

    import pyarrow.parquet as pq

    write_token_files(docs, f"file://{tmp_path}/ids", JSON, dictionary=False)
    column = pq.ParquetFile(glob.glob(f"{tmp_path}/ids/*.parquet")[-1]).metadata.row_group(0).column(2)
    assert "DELTA_BINARY_PACKED" in column.encodings and column.has_offset_index and column.has_column_index

def test_empty_files(spark, docs, tmp_path):
    write_token_files(docs.limit(0), f"file://{tmp_path}/ids", JSON)
    assert file_digests(spark, f"file://{tmp_path}/ids").collect() == []

def test_starts_follow_the_files_where_ids_repeat(spark, tmp_path):
    path, texts = f"file://{tmp_path}/ids", ["one two three four five six", "one", "", "two words", None, "x"] * 3
    write_token_files(spark.createDataFrame([(7, t) for t in texts] + [(1, "first")], "doc_id long, text string").repartition(4), path, JSON)
    stands = [t for r in sorted(spark.read.parquet(path).select("*", "_metadata.file_name", "_metadata.row_index").collect(), key=lambda r: (r.file_name, r.row_index)) for t in r.ids]
    rows = file_digests(spark, path).collect()
    assert len(rows) == len(texts) + 1 and sorted(r.start for r in rows)[-1] < len(stands)
    for r in rows:
        assert zlib.crc32(np.array(stands[r.start : r.start + r.n_tokens], "<u4").tobytes()) == r.ids_crc32
        assert stands[r.start + r.n_tokens - 1] == 0 and 0 not in stands[r.start : r.start + r.n_tokens - 1]

def test_starts_where_a_task_writes_several_files(spark, tmp_path):
    path = f"file://{tmp_path}/ids"
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "3")
    try:
        write_token_files(spark.createDataFrame([(k, "x " * (k + 1)) for k in range(10)], "doc_id long, text string"), path, JSON)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    rows = sorted(file_digests(spark, path).collect(), key=lambda r: r.doc_id)
    assert [r.start for r in rows] == [sum(r.n_tokens for r in rows[:k]) for k in range(10)]


def test_chunks_are_told_apart_by_their_bytes(monkeypatch):
    monkeypatch.setattr(tokens, "mixed_keys", lambda data, starts, ends: np.full(len(starts), 5 << 40, np.uint64))  # all hashes collide
    encoder = tokens.Encoder(JSON)
    for text in ("the the a b c of the", "of a,b;c the 12 é\nthe ab\0 ab"):
        assert encoder.ids(text) == ids(text)

def test_a_warm_cache_encodes_nothing(spark, docs, tmp_path, monkeypatch):
    cache = f"file://{tmp_path}/warm"
    first = sorted(map(str, count_tokens(docs, JSON, cache).collect()))
    monkeypatch.setattr("quillmark.llm.token_counts.encoder", None)
    assert sorted(map(str, count_tokens(docs, JSON, cache).collect())) == first


def test_encoding_takes_little_memory_however_many_texts_a_batch_has():
    import pyarrow as pa

    words = [f"w{k}" for k in range(2000)]
    column, encoder = pa.array([" ".join(random.Random(k).choices(words, k=400)) for k in range(2000)], pa.string()), tokens.encoder(JSON)
    for _ in encoder.batch(column):  # the table is made
        pass
    tracemalloc.start()
    found = sum(len(own.counts) for own in encoder.batch(column))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == len(column)
    assert peak < 24 << 20
