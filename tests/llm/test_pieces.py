"""SentencePiece encoding and decoding, against the library on whole texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.messy import DOCUMENTS_DDL, documents
from tidemark.llm import pieces
from tidemark.llm.queries import tokenizer

MODEL = tokenizer("piece_bpe_32k.model")
ODD = [
    "", " ", "   ", "a", " a", "a ", "a  b", "a\n\n b \n c", "\n", " \n ", "▁x▁▁y", "▁", "\x00", "a\x00 b", "<s> a</s>", "日本語 テキスト", "한국어   x", "a\xa0b", "퟿", "é ﬁ", "x" * 3000, "ab " * 500,
    "\t\ttab", "🙂🙂 🙂", "\r\nline\r\n",
]


@pytest.fixture(scope="module")
def own():
    return pieces.Pieces(MODEL)


def test_encode_and_decode_any_text(spark, own):
    r = random.Random(5)
    texts = ODD + ["".join(r.choice("ab1é .\n▁日🙂") for _ in range(r.randint(0, 300))) for _ in range(300)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    encoded = pieces.encode(rows, MODEL, back=True)
    found = {x.doc_id: x for x in encoded.withColumn("back", pieces.decoded(F.col("ids"), MODEL)).collect()}
    assert all(x.decoded == x.back for x in found.values())
    for k, t in enumerate(texts):
        ids = own.model.encode(t)
        assert found[k].ids == ids and found[k].back == own.model.decode(ids), repr(t)


def test_messy_documents(spark, own):
    rows = spark.createDataFrame(documents(), DOCUMENTS_DDL)
    found = pieces.encode(rows.withColumn("ids", F.lit(1)), MODEL).collect()
    key = lambda x: (-1 if x[0] is None else x[0], x[1])
    assert sorted(((x.doc_id, x.ids) for x in found), key=key) == sorted(((d[0], own.model.encode(d[1] or "")) for d in documents()), key=key)
    assert pieces.encode(spark.createDataFrame([], DOCUMENTS_DDL), MODEL).collect() == []


def test_null_ids_decode_to_null(spark):
    rows = spark.createDataFrame([(1, None), (2, [])], "k long, ids array<int>")
    assert {x.k: x.back for x in rows.withColumn("back", pieces.decoded(F.col("ids"), MODEL)).collect()} == {1: None, 2: ""}


def test_slices_and_a_full_table_change_nothing(own, monkeypatch):
    r = random.Random(9)
    text = " ".join("".join(r.choice("abcdé\n") for _ in range(r.randint(1, 9))) for _ in range(3000))
    ids = own.model.encode(text)
    monkeypatch.setattr(pieces, "SLICE_IDS", 50)
    monkeypatch.setattr(pieces, "PLACES_ONCE", 100)
    monkeypatch.setattr(pieces, "CHUNKS_ONCE", 7)
    monkeypatch.setattr(pieces, "MAX_CHUNKS", 500)
    data = np.frombuffer((" " + text).encode(), np.uint8)
    found, counts = pieces.Pieces(MODEL).encode(data, np.array([0, len(data)]))
    assert found.tolist() == ids and counts.tolist() == [len(ids)] and own.decode(np.array(ids)) == own.model.decode(ids)


def test_each_distinct_chunk_is_segmented_once(monkeypatch):
    fresh, seen = pieces.Pieces(MODEL), []
    segment = fresh.segment
    monkeypatch.setattr(fresh, "segment", lambda chunks: seen.extend(chunks) or segment(chunks))
    data = np.frombuffer((" the cat and the dog and the end" * 50).encode(), np.uint8)
    for _ in range(3):
        fresh.encode(data, np.array([0, len(data)]))
    assert sorted(seen) == [" and", " cat", " dog", " end", " the"]
