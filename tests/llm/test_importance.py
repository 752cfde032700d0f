"""Importance resampling, against plain versions."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.messy import DOCUMENTS_DDL, documents, lowered, prose
from tidemark.llm import importance
from tidemark.llm.common import lowered as lowered_bytes
from tidemark.llm.common import text_slices

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    ws = WORD.findall(lowered(text or ""))
    return [" ".join(ws[k : k + n]) for n in (1, 2, 3) for k in range(len(ws) - n + 1)], len(ws)


def brute(rows, target, share, least):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    corpus, aim = (collections.Counter(bucket(f) for t in texts for f in features(t)[0]) for texts in ([t for _, t in rows], target))
    s, t = sum(corpus.values()), sum(aim.values())
    gain = lambda b: math.floor(1000 * math.log((aim[b] + 1) * (s + 10000) / ((corpus[b] + 1) * (t + 10000))))
    out = []
    for i, text in rows:
        fs, n = features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in fs)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n, None])
    able = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1]))
    for k, x in enumerate(able[: len(able) * share[0] // share[1]]):
        x[5] = k + 1
    return sorted((x[0] is None, x[0] or 0, *x[1:4], x[5] or 0) for x in out)


def found_rows(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_features, r.weight, r.score, r["rank"] or 0) for r in df.collect())


def test_features_are_the_crc_of_all_runs():
    r = random.Random(1)
    texts = ["", "a", "Hello World  foo9bar", "x" * 5000 + " y " + "z" * 64 + " " + "q" * 63 + " " + "w" * 65 + " " + "v" * 128, "日本語 Überß a-b_c", None, "...", "a b c d"]
    texts += ["".join(r.choice("ab1é .\nZ本") for _ in range(r.randint(0, 200))) for _ in range(200)]
    for low, high, data, offsets in text_slices(pa.array(texts), 3000):
        found, valid, first = importance.feature_buckets(lowered_bytes(data), offsets)
        for k, text in enumerate(texts[low:high]):
            ws = WORD.findall(lowered(text or ""))
            for n in (1, 2, 3):
                part = slice(first[k], first[k + 1])
                assert found[n - 1][part][valid[n - 1][part]].tolist() == [zlib.crc32(" ".join(ws[j : j + n]).encode()) % 10000 for j in range(len(ws) - n + 1)]


@pytest.mark.parametrize("share", [(1, 2), (1, 1), (0, 1)])
def test_resampling_of_messy_documents(spark, share):
    rows = [(d[0], d[1]) for d in documents()]
    docs = spark.createDataFrame(documents(), DOCUMENTS_DDL).repartition(3).withColumn("rank", F.lit("clash"))
    target = [prose(8, 50), None, "", "One Two three"]
    found = importance.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), share)
    assert found_rows(found) == brute(rows, target, share, 20)


def test_nothing_to_draw_from_or_towards(spark):
    docs, target = spark.createDataFrame([], DOCUMENTS_DDL), spark.createDataFrame([], "text string")
    assert importance.resample(docs, target).collect() == []
    rows = [(k, prose(k, 30)) for k in range(40)]
    assert found_rows(importance.resample(spark.createDataFrame(rows, "doc_id long, text string"), target, (1, 4))) == brute(rows, [], (1, 4), 20)


def test_columns_are_carried(spark):
    rows = spark.createDataFrame([(k, prose(k, 30), f"s{k}") for k in range(30)], "doc_id long, text string, source string")
    found = importance.resample(rows, rows, (1, 3), carry=("text", "source")).collect()
    assert {(r.doc_id, r.text, r.source) for r in found} == {tuple(r) for r in rows.collect()} and sorted(r["rank"] for r in found if r["rank"]) == list(range(1, 11))


@pytest.mark.parametrize("seed", range(4))
def test_cut_is_exact(spark, monkeypatch, seed):
    """Few distinct first parts, many ties, uneven tasks, small last choice: every rank gives its key."""
    monkeypatch.setattr(importance, "LAST_KEYS", 3)
    r = np.random.default_rng(seed)
    rows = [(int(a), int(b), int(c), k) for k, (a, b, c) in enumerate(zip(r.integers(-3, 3, 700) * 10**15, r.integers(0, 4, 700), r.integers(0, 2, 700), strict=True))]
    keys = importance.materialize(spark.createDataFrame(rows, "k1 long, k2 long, k3 long, k4 long").repartition(7, "k1"))
    for wanted in (1, 2, 350, 699, 700):
        assert importance.cutoff(keys, wanted) == sorted(rows)[wanted - 1]
    assert importance.cutoff(keys, 0) is None


def test_each_round_discards_a_quarter(spark, monkeypatch):
    monkeypatch.setattr(importance, "LAST_KEYS", 10)
    sizes, medians = [], importance._medians
    monkeypatch.setattr(importance, "_medians", lambda *a: sizes.append(medians(*a)) or sizes[-1])
    keys = importance.materialize(spark.range(4000).selectExpr("id * id % 3989 AS k1", "0L AS k2", "0L AS k3", "id AS k4").repartitionByRange(16, "k1"))
    importance.cutoff(keys, 777)
    left = [sum(n for _, n, _ in sizes[0])]
    for found in sizes[1:]:
        by_side = [sum(n for side, n, _ in found if side == s) for s in (True, False)]
        assert sum(by_side) == left[-1] or sum(by_side) <= left[-1]
        assert max(by_side) <= 0.75 * sum(by_side) + 16
        left.append(sum(by_side))
    assert len(sizes) < 25
