"""The pipeline's own choices: thresholds and limits that no operator's contract sets."""

import itertools

import pytest

from tests.llm.messy import prose
from tests.llm.test_operators import shingle_set

pipeline = pytest.importorskip("corpus_pipeline")
DDL = "doc_id long, text string, lang string, source string, n_chars long"


def similarity(a, b):
    x, y = shingle_set(a), shingle_set(b)
    return len(x & y) / len(x | y)


def components(rows, least):
    label = {i: i for i, _ in rows}
    pairs = [(a, b) for (a, x), (b, y) in itertools.combinations(rows, 2) if similarity(x, y) >= least]
    for _ in rows:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_near_duplicates_link_from_80_percent(spark):
    rows = []
    for k in range(30):  # a text and the same with a changed end, about 75 to 90 % alike
        base = prose(900 + k, 120).split()
        tail = 6 + k % 10
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[: len(base) - tail] + [f"new{k}x{j}" for j in range(tail)]))]
    found = [similarity(rows[2 * k][1], rows[2 * k + 1][1]) for k in range(30)]
    assert sum(0.8 <= x < 0.85 for x in found) >= 5 and sum(x < 0.8 for x in found) >= 5
    docs = spark.createDataFrame([(i, t, "en", "h", len(t)) for i, t in rows], DDL).repartition(4)
    wanted = {i for i, root in components(rows, 0.8).items() if i == root}
    assert {r.doc_id for r in pipeline.near_duplicates(spark, docs, "").collect()} == wanted


def lined(seed, n):
    return [prose(seed * 100 + j, 14).replace("\n", " ") + f" end{seed}x{'abcdefghijklmnop'[j]}" for j in range(n)]


def test_near_copies_do_not_condemn_each_other(spark):
    clean, rows = lined(40, 12), []
    for k in range(200):  # one clean document, each copy with a word of its own
        rows.append((k, "\n".join([*clean[:11], f"{clean[11]} mark{'abcdefghij'[k // 20]}{'abcdefghijklmnopqrst'[k % 20]}"]), "en", "h", 0))
    rows += [(1000 + k, "\n".join(lined(50 + k, 8)), "en", "h", 0) for k in range(20)]
    kept = pipeline.quality_rules(spark, spark.createDataFrame(rows, DDL).repartition(4), "").collect()
    assert {r.doc_id: r.text for r in kept} == {r[0]: r[1] for r in rows}
    docs = spark.createDataFrame(kept, DDL)
    assert {r.doc_id for r in pipeline.near_duplicates(spark, docs, "").collect()} == {0, *range(1000, 1020)}


def test_frequent_lines_go_on_small_and_large_hosts(spark, monkeypatch):
    monkeypatch.setattr(pipeline, "MANY_DOCS", 8)  # stands for 1000, as 1200 documents do for millions
    notice = "all pages of this site carry one notice"
    rows = [(k, "\n".join([*lined(300 + k, 6), notice]), "en", "small", 0) for k in range(12)]
    rows += [(100 + k, "\n".join([*lined(400 + k, 6), *[notice] * (k < 4)]), "en", "chance", 0) for k in range(12)]
    rows += [(1000 + k, "\n".join([*lined(2000 + k, 6), *[notice] * (k < 10)]), "en", "large", 0) for k in range(1200)]
    kept = {r.doc_id: r.text for r in pipeline.quality_rules(spark, spark.createDataFrame(rows, DDL).repartition(4), "").collect()}
    assert set(kept) == {r[0] for r in rows}
    assert {i for i, t in kept.items() if notice in t} == {100, 101, 102, 103}


def test_rows_that_share_an_id_are_judged_apart(spark):
    one, other = prose(1, 90), prose(2, 90)
    rows = [(1, one), (1, other), (2, one), (None, other), (3, prose(3, 90)), (3, prose(3, 90)), (None, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "h", 0) for i, t in rows], DDL).repartition(3)
    kept = pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted([(1, one), (1, other), (3, prose(3, 90)), (0, ""), (4, "")])


def test_two_runs_do_not_disturb_each_other(spark, tmp_path):
    rows = [(k, "\n".join(lined(700 + k, 8)), "en" if k % 2 else "de", "h" if k % 3 else None, 0) for k in range(60)] + [(None, None, None, None, None), (60, "", None, "h", 0)]
    spark.createDataFrame(rows, DDL).write.parquet(f"{tmp_path}/documents.parquet")
    one, other = pipeline.run(spark, str(tmp_path)), pipeline.run(spark, str(tmp_path))
    key = lambda df: sorted((r.doc_id, r.start, r.ids_crc32, r.length) for r in df.collect())
    first = key(one)
    assert first and first == key(other) == key(one)
