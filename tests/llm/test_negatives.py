"""Hard negatives, against brute force."""

import numpy as np
import pandas as pd
import pytest

from tidemark.llm import negatives

DDL = "id long, label long, vector array<long>, score string, row string"


def brute(rows, anchors, positives, negatives_, least):
    sound = lambda r: r[0] is not None and r[1] is not None and r[2] is not None and None not in r[2]
    rows, out = [r for r in rows if sound(r)], []
    for a in filter(sound, anchors):
        scored = [(-sum(x * y for x, y in zip(a[2], r[2], strict=True)), r[0], r[1]) for r in rows if r[0] != a[0] and len(r[2]) == len(a[2])]
        for minus, pid, _ in sorted(x for x in scored if x[2] == a[1])[:positives]:
            p = -minus
            inside = sorted(x for x in scored if x[2] != a[1] and least[0] * p <= -least[1] * x[0] <= least[1] * p)
            out += [(a[0], pid, k + 1, x[1], p, -x[0]) for k, x in enumerate(inside[:negatives_])]
    return sorted(out)


def mined(spark, rows, anchors, **more):
    vectors = spark.createDataFrame([(*r, "clash", "clash") for r in rows], DDL).repartition(5)
    return sorted(tuple(r) for r in negatives.hard_negatives(vectors, spark.createDataFrame([(*r, "x", "y") for r in anchors], DDL), **more).collect())


def test_kernel():
    for seed in range(300):
        r = np.random.default_rng(seed)
        d, n, g = int(r.choice([0, 1, 3, 8, 9, 20, 40])), int(r.integers(1, 60)), int(r.integers(1, 9))
        x = np.floor(r.normal(size=(n, d)) * r.choice([3, 100]) * (r.random((n, 1)) + 0.01)).astype(np.int64)
        x[r.random(n) < 0.1] = 0
        if r.random() < 0.3:
            x[:] = x[0]
        q = x[:g].copy() if r.random() < 0.5 and n >= g else np.floor(r.normal(size=(g, d)) * 30).astype(np.int64)
        block = negatives._block(pd.DataFrame({"id": r.integers(0, 50, n), "label": r.integers(0, 3, n), "vector": [v.tolist() for v in x], "length": d}), 1)
        dims, lists, bounds = (np.frombuffer(block[k], t) for k, t in (("dims", np.int32), ("lists", np.int32), ("bounds", np.float64)))
        scores = q @ x.T
        t = np.array([r.choice([-np.inf, 0, np.quantile(scores, 0.5), np.quantile(scores, 0.9), scores.max()]) for _ in range(g)], float)
        wanted = r.random((g, n)) < 0.8
        found = negatives.scores_above(q[:, dims], t, wanted, np.frombuffer(block["matrix"], np.int64).reshape(n, -1), lists.reshape(-1, n), bounds.reshape(-1, n))
        want = sorted((i, j, scores[i, j]) for i in range(g) for j in range(n) if wanted[i, j] and scores[i, j] >= t[i])
        assert sorted(zip(*(f.tolist() for f in found), strict=True)) == want


def test_lists_leave_out_what_remaining_norms_cover(monkeypatch):
    """At a high threshold, most of the lists after the first is not read."""
    r = np.random.default_rng(1)
    x = np.floor(r.normal(size=(2000, 64)) * 0.5 ** np.arange(64) * 1000).astype(np.int64)
    block = negatives._block(pd.DataFrame({"id": np.arange(2000), "label": 0, "vector": [v.tolist() for v in x], "length": 64}), 1)
    lists, bounds = (np.frombuffer(block[k], t).reshape(-1, 2000) for k, t in (("lists", np.int32), ("bounds", np.float64)))
    best = np.sort(x @ x[0])[-5]
    heads = [np.searchsorted(-b, -best / np.linalg.norm(x[0]), "right") for b in bounds[:-1]]
    assert heads[0] > 0 and heads[1:] == [0] * 3


@pytest.mark.parametrize("seed", range(3))
def test_mining(spark, monkeypatch, seed):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 40)
    monkeypatch.setattr(negatives, "GROUP_ROWS", 3)
    monkeypatch.setattr(negatives, "LANES", 3)
    r = np.random.default_rng(seed)
    centers = r.normal(size=(6, 12)) * 20
    rows = [(k, int(r.integers(0, 4)), np.floor(centers[r.integers(0, 6)] + r.normal(size=12) * 6).astype(int).tolist()) for k in range(400)]
    rows += [(1000 + k, 1, rows[0][2]) for k in range(60)] + [(2000 + k, 2, [5] * 7) for k in range(5)] + [(2100 + k, 3, [4] * 7) for k in range(5)]  # a hot vector; another length
    anchors = [x for x in rows if x[0] % 25 == 0]
    assert mined(spark, rows, anchors) == brute(rows, anchors, 5, 5, (80, 100))
    assert mined(spark, rows, anchors, positives=2, negatives=7, least=(50, 100)) == brute(rows, anchors, 2, 7, (50, 100))


def test_vectors_are_not_broadcast(spark, monkeypatch):
    """Groups are small on disk and go to all lanes: neither they nor what is found may be sent through the driver. Only the typical norms of each length may."""
    plans, write = [], negatives.materialize
    planned = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(negatives, "materialize", lambda df: (plans.append(planned(df)), write(df))[1])
    rows = [(k, k % 3, [k % 7, k % 11]) for k in range(120)]
    vectors, anchors = (spark.createDataFrame([(*r, "x", "y") for r in some], DDL) for some in (rows, rows[::20]))
    found = negatives.hard_negatives(vectors, anchors)
    joined = [p for p in [*plans, planned(found)] if "Join" in p and "avg(" not in p]
    assert len(joined) > 5 and not any("BroadcastHashJoin" in p for p in joined)
    assert sorted(map(tuple, found.collect())) == brute(rows, rows[::20], 5, 5, (80, 100))


def test_messy_rows(spark):
    rows = [
        (0, 1, [3, 4]), (0, 1, [3, 4]), (1, 1, [3, 4]), (2, 2, [3, 4]), (2, 2, [3, 4]), (3, 1, [0, 0]), (4, 2, [0, 0]), (5, 1, [-3, -4]), (6, None, [3, 4]), (7, 1, None), (8, 2, [None, 4]), (None, 2, [3, 4]),
        (9, 2, [3]), (10, 2, [2, 4]), (11, 2, []), (12, 1, []),
    ]
    anchors = [rows[0], rows[1], rows[6], (12, 1, []), (None, 1, [1, 1]), (13, 1, None), (14, None, [1, 1]), (99, 5, [1, 1])]
    assert mined(spark, rows, anchors) == brute(rows, anchors, 5, 5, (80, 100))
    assert mined(spark, [], rows[:2]) == [] and mined(spark, rows, []) == []


def test_scores_beyond_doubles_and_beyond_64_bits(spark):
    big = 1 << 30
    rows = [(0, 1, [big, 1]), (1, 1, [big, 3]), (2, 2, [big, 2]), (3, 2, [big, 1]), (4, 2, [big - 1, 0])]
    assert mined(spark, rows, rows[:1]) == brute(rows, rows[:1], 5, 5, (80, 100))
    with pytest.raises(Exception, match="too large"):
        mined(spark, [(0, 1, [1 << 40, 1]), (1, 1, [1 << 40, 2]), (2, 2, [1, 1])], [(0, 1, [1 << 40, 1])])
