import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.messy import DOCUMENTS_DDL, documents

tokenizers = pytest.importorskip("tokenizers")
vocabularies = pytest.importorskip("public_tokenizers")

from tidemark.llm import packing, tokencount, tokenfile  # noqa: E402
from tidemark.llm.common import text_slices  # noqa: E402
from tidemark.llm.tokens import Encoder, encoder  # noqa: E402

BYTE, WORD = (vocabularies.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def plain(path, texts):
    t = tokenizers.Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def pieced(path, texts, max_bytes=1 << 20):
    out = []
    for _, _, data, offsets in text_slices(pa.array(texts, pa.string()), max_bytes):
        ids, counts = encoder(path).encode(data, offsets)
        out += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    return out


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.sampled_from("ab éÉ×÷ß \n\t\r.,;:!?'s<|>  ̸́ \x1c\x85日😀0123Z"), max_size=40), max_size=5))
def test_pieces_give_the_tokenizers_own_ids(path, texts):
    assert pieced(path, texts, 64) == plain(path, texts)


def test_messy_documents_give_the_tokenizers_own_ids():
    texts = [row[1] for row in documents()]
    for path in (BYTE, WORD):
        assert pieced(path, texts) == plain(path, texts)


def test_pieces_that_find_no_slot_and_an_emptied_table(monkeypatch):
    from tidemark.llm import tokens

    monkeypatch.setattr(tokens, "_SLOT_BITS", 3)
    monkeypatch.setattr(tokens, "_SLOT_MASK", np.uint64(7))
    monkeypatch.setattr(tokens, "MAX_PIECES", 50)
    own, texts = Encoder(BYTE), [row[1] for row in documents()] * 3
    for _, _, data, offsets in text_slices(pa.array(texts, pa.string()), 2000):
        ids, counts = own.encode(data, offsets)
    got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == plain(BYTE, texts)[-len(got) :]


def check_packed(rows, reference, size):
    """reference: (doc_id, ids with the end id), as often as rows stand."""
    taken = {}
    for r in rows:
        taken.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length, r.ids_crc32))
    wanted = {}
    for doc_id, ids in reference:
        pieces = [(k, len(ids[k : k + size]), zlib.crc32(np.array(ids[k : k + size], "<u4").tobytes())) for k in range(0, len(ids), size)]
        wanted.setdefault((doc_id, len(ids)), []).extend(pieces)
    assert {k: sorted(v) for k, v in taken.items()} == {k: sorted(v) for k, v in wanted.items()}
    filled = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert all(n <= size for n in filled.values())
    return filled


def test_packing(spark):
    docs = spark.createDataFrame(documents(), DOCUMENTS_DDL).repartition(5)
    rows = packing.pack(docs, BYTE, window=128, open_windows=4).collect()
    reference = [(r[0], ids + [0]) for r, ids in zip(documents(), plain(BYTE, [r[1] for r in documents()]), strict=True)]
    filled = check_packed(rows, reference, 128)
    assert sum(128 - n for n in filled.values()) < 128 * 2
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32


def test_packing_an_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], DOCUMENTS_DDL), BYTE).collect() == []


def test_best_fit_emits_the_fullest():
    w = packing._Windows(10, 2)
    assert w.place(("a",), 6) == [] and w.place(("b",), 7) == []
    assert [p[1] for p in w.place(("c",), 5)] == ["b"]  # none fits: the fullest goes
    assert [p[1] for p in w.place(("d",), 4)] == ["a", "d"]  # full: it goes at once


@pytest.mark.parametrize("stripe", [1, 3, 4096])
def test_token_counts(spark, tmp_path, stripe):
    docs = spark.createDataFrame(documents(), DOCUMENTS_DDL).repartition(3)
    written = tokencount.write_flat_files(docs, f"file://{tmp_path}/flat", BYTE, 50256).cache()
    assert written.count() == len(documents())
    rows = tokencount.count_tokens(tokencount.file_ends(spark, f"file://{tmp_path}/flat", 50256, block=64), stripe).join(written, ["file", "doc_no"]).collect()
    wanted = sorted((r[0] or -1, len(ids) + 1) for r, ids in zip(documents(), plain(BYTE, [r[1] for r in documents()]), strict=True))
    assert sorted((r.doc_id or -1, r.n_tokens) for r in rows) == wanted and all(r.finished for r in rows)
    assert sum(f.stat().st_size for f in (tmp_path / "flat").glob("part-*")) == 2 * sum(n for _, n in wanted)
    written.unpersist()


@pytest.mark.parametrize("stripe", [1, 2, 4096])
def test_token_counts_of_raw_files(spark, tmp_path, stripe):
    rng = np.random.default_rng(0)
    streams = [rng.integers(0, 30, n).astype("<u2") for n in (1000, 1, 0, 64, 65)] + [np.full(200, 7, "<u2"), np.zeros(10, "<u2"), np.zeros(1000, "<u2")]
    for k, s in enumerate(streams):
        (tmp_path / f"{k}.bin").write_bytes(s.tobytes() + b"x" * (k == 3))  # half an id at the end is none
    rows = tokencount.count_tokens(tokencount.file_ends(spark, str(tmp_path), 7, block=64), stripe).collect()
    wanted = []
    for k, s in enumerate(streams):
        ends = [0, *(np.flatnonzero(s == 7) + 1).tolist()]
        wanted += [
            (f"{k}.bin", n, a, b - a, True) for n, (a, b) in enumerate(zip(ends, ends[1:], strict=False))
        ] + [(f"{k}.bin", len(ends) - 1, ends[-1], len(s) - ends[-1], False)] * (ends[-1] < len(s))
    assert sorted((r.file, r.doc_no, r.start, r.n_tokens, r.finished) for r in rows) == sorted(wanted)


def test_token_counts_of_nothing(spark, tmp_path):
    written = tokencount.write_flat_files(spark.createDataFrame([], DOCUMENTS_DDL), f"file://{tmp_path}/flat", BYTE, 50256)
    assert written.collect() == []
    (tmp_path / "flat").mkdir(exist_ok=True)
    assert tokencount.count_tokens(tokencount.file_ends(spark, f"file://{tmp_path}/flat", 50256)).collect() == []


def alternating(rounds):
    """Two different strings on which any polynomial in powers of two agrees."""
    one, other = "a", "b"
    for _ in range(rounds):
        one, other = one + other, other + one
    return one, other


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_pieces_are_not_mistaken_for_one_another(path):
    for rounds in (10, 11, 12):
        one, other = alternating(rounds)
        assert pieced(path, [one, other]) == plain(path, [one, other]) and plain(path, [one]) != plain(path, [other])


def test_token_file_and_packing_tell_alternating_texts_apart(spark, tmp_path):
    texts = alternating(11)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    tokenfile.write_token_file(docs, str(tmp_path / "ids"), WORD, end_id=2)
    rows = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in tokenfile.read_token_file(spark, str(tmp_path / "ids")).collect()}
    assert [rows[k] for k in range(2)] == [ids + [2] for ids in plain(WORD, texts)]
    packed = packing.pack(docs, BYTE).collect()
    assert {r.doc_id: r.ids_crc32 for r in packed} == {k: zlib.crc32(np.array([*ids, 0], "<u4").tobytes()) for k, ids in enumerate(plain(BYTE, texts))}


@settings(max_examples=200, deadline=None)
@given(ids=st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=300), share=st.floats(0, 1))
def test_blocks_round_trip(ids, share):
    raw = b"xyz" + tokenfile.encode_block(np.array(ids, np.uint32), share)
    assert tokenfile.decode_block(raw, 3).tolist() == ids


def test_outliers_do_not_widen_a_block():
    ids = np.array([1000 + k % 16 for k in range(4000)] + [49000], np.uint32)
    assert len(tokenfile.encode_block(ids)) < 4001 * 4 / 8 + 30


def test_token_file(spark, tmp_path):
    docs = spark.createDataFrame(documents(), DOCUMENTS_DDL).repartition(4)
    tokenfile.write_token_file(docs, str(tmp_path / "ids"), WORD, end_id=2, block=64, segment_tokens=300)
    rows = sorted(tokenfile.read_token_file(spark, str(tmp_path / "ids")).collect(), key=lambda r: r.start)
    order = [(-1 if r.doc_id is None else r.doc_id) for r in rows]
    assert order == sorted(order) and len(rows) == len(documents())
    at = 0
    for r in rows:
        assert r.start == at and zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
    wanted = sorted((r[0] or -1, ids + [2]) for r, ids in zip(documents(), plain(WORD, [r[1] for r in documents()]), strict=True))
    assert sorted((r.doc_id or -1, np.frombuffer(r.ids, "<u4").tolist()) for r in rows) == wanted


def test_token_file_of_nothing(spark, tmp_path):
    tokenfile.write_token_file(spark.createDataFrame([], DOCUMENTS_DDL), str(tmp_path / "ids"), WORD, end_id=2)
    assert tokenfile.read_token_file(spark, str(tmp_path / "ids")).collect() == []


def test_single_documents_are_read_from_their_blocks(spark, tmp_path, monkeypatch):
    rows = [(k, " ".join(f"word{k} {j}" for j in range(40 * k)) if k != 3 else None) for k in range(12)] + [(5, "again")]
    path = str(tmp_path / "file")
    tokenfile.write_token_file(spark.createDataFrame(rows, "doc_id long, text string"), path, WORD, end_id=2, block=64, segment_tokens=1000)
    whole = sorted((r.doc_id, r.ids) for r in tokenfile.read_token_file(spark, path).collect())
    by = lambda df: sorted((r.doc_id, r.ids) for r in df.collect())
    assert by(tokenfile.read_tokens(spark, path, [5, 3, 11, 99])) == [x for x in whole if x[0] in (3, 5, 11)]
    part = tokenfile.read_tokens(spark, path, [11, 3], 100, 70).collect()
    assert {r.doc_id: (r.first, np.frombuffer(r.ids, "<u4").tolist()) for r in part} == {
        11: (100, np.frombuffer(dict(whole)[11], "<u4")[100:170].tolist()), 3: (1, [])
    }
    assert tokenfile.read_tokens(spark, path, []).collect() == []
    decoded, decode = [], tokenfile.decode_block
    monkeypatch.setattr(tokenfile, "decode_block", lambda raw, at=0: decoded.append(at) or decode(raw, at))
    file = spark.read.parquet(path).filter("array_contains(doc_ids, 11L)").first()
    tokenfile._piece(bytes(file.payload), list(file.block_starts), 100, 170)
    assert len(decoded) == 2
