"""The registered queries over whole given tables, against plain versions of their contracts."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest

from tests.llm.messy import words
from tests.llm.test_operators import brute_components, brute_stats, shingle_set
from tests.llm.test_tokens import BYTE, WORD, check_packed, plain
from tidemark.llm import queries as q

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables here")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()


def rows(spark, name):
    return q.QUERIES[name](spark, SF_DIR).collect()


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("benchmark", "documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    df = q.QUERIES[name](spark, SF_DIR)
    found = con.execute(q.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(repr, found.fetchall()))


def test_op1(spark, docs):
    found = rows(spark, "op1_source_mix")
    sizes = {d.doc_id: len(words(d.text)) for d in docs}
    assert {r.doc_id: r["size"] for r in found} == sizes
    total = {}
    for r in found:
        assert r.taken <= 3 * r["size"]
        t = total.setdefault(r.source, [0, r.target, 0])
        t[0], t[2] = t[0] + r.taken, t[2] + r["size"]
    assert sum(t[1] for t in total.values()) == pytest.approx(sum(sizes.values()))
    assert all(abs(taken - target) <= 0.05 * target and target <= 3 * size for taken, target, size in total.values())
    assert sorted((r.doc_id, r.taken) for r in rows(spark, "op1_source_mix")) == sorted((r.doc_id, r.taken) for r in found)


def test_op3(spark, docs):
    found = rows(spark, "op3_minhash_near_dedup")
    assert {r.doc_id: r.component_id for r in found} == brute_components([(d.doc_id, d.text) for d in docs])
    assert {r.doc_id: r.n_shingles for r in found} == {d.doc_id: len(shingle_set(d.text)) for d in docs} and all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_op4(spark, docs):
    filled = check_packed(rows(spark, "op4_packing"), [(d.doc_id, ids + [0]) for d, ids in zip(docs, plain(BYTE, [d.text for d in docs]), strict=True)], 1024)
    padding = sum(0 if n & (n - 1) == 0 else 1024 - n for n in filled.values())
    assert padding < 0.04 * sum(filled.values())


def test_op6(spark, docs):
    found = {r.doc_id: r for r in rows(spark, "op6_language_id")}
    held = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 4 == 2]
    assert {d.doc_id for d in held} == {k for k, r in found.items() if r.held_out} and len(found) == len(docs)
    assert np.mean([found[d.doc_id].lang_pred == d.lang for d in held]) > 0.97 and all(0 <= r.score <= 1 for r in found.values())


def test_op7(spark, docs):
    found = rows(spark, "op7_sharding")
    assert {(r.doc_id, r["size"], r.text_crc32, r.law, r.grown_shard) for r in found} == {(
        d.doc_id, len((d.text or "").encode()) + 1, zlib.crc32((d.text or "").encode()), "bytes", None
    ) for d in docs}
    slots, held = {}, {}
    for r in found:
        slots.setdefault(r.shard, []).append(r.slot)
        held[r.shard] = held.get(r.shard, 0) + r["size"]
    assert sorted(slots) == list(range(16)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(held.values()) - min(held.values()) <= max(r["size"] for r in found)


def test_op8(spark, docs):
    found = rows(spark, "op8_token_counts")
    assert {r.doc_id: r.n_tokens for r in found} == {d.doc_id: len(ids) + 1 for d, ids in zip(docs, plain(BYTE, [d.text for d in docs]), strict=True)} and len(found) == len(docs)


def test_op9(spark, docs):
    for r in rows(spark, "op9_quality_rules"):
        text = next(d.text for d in docs if d.doc_id == r.doc_id)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_stats(text)


def test_op10(spark, docs):
    found = sorted(rows(spark, "op10_token_file"), key=lambda r: r.start)
    ids = {d.doc_id: x + [2] for d, x in zip(docs, plain(WORD, [d.text for d in docs]), strict=True)}
    assert [r.doc_id for r in found] == sorted(ids)
    at = 0
    for r in found:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids[r.doc_id]), zlib.crc32(np.array(ids[r.doc_id], "<u4").tobytes()))
        at += r.n_tokens


def test_op13(spark, docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=q.tokenizer("piece_bpe_32k.model"))
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(d.doc_id, ids) for d in docs for ids in [library.encode(d.text or "")]]
    assert sorted(map(tuple, rows(spark, "op13_sentence_pieces"))) == sorted((i, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids))) for i, ids in want)
