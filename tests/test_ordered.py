"""Ordered folds: the same results for any cut and order, refusals, timers, and state that ends."""

import json
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_operators import noise_frames
from tidemark.operators import detect
from tidemark.plans import streams
from tidemark.streaming import flows, folds, ordered

DDL = "s string, t_ms double, value double, source string, epoch long, over boolean"


def cut_fold(fold, rows, cuts, most=None):
    """What a fold tells of rows in pieces, its state packed between them; most: bytes of state."""
    state, told = None, []
    for low, high in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        if high > low:
            state, found, _ = fold.step(state, rows.iloc[low:high].reset_index(drop=True))
            told.append(found)
            raw = ordered.pack(state)
            assert most is None or len(raw) <= most
            state = ordered.unpack(raw)
    told.append(fold.last(state))
    return pd.concat([x for x in told if len(x)] or told[:1], ignore_index=True)


def same(found, wanted):
    assert len(found) == len(wanted)
    assert np.allclose(found[list(wanted.columns)].to_numpy(float), wanted.to_numpy(float), equal_nan=True)


def cuts_of(r, n):
    return np.sort(r.choice(n, int(r.integers(0, 60)))).tolist()


@pytest.mark.parametrize("seed", range(12))
def test_blinks_for_any_cut(seed):
    r = np.random.default_rng(seed)
    n = 3000
    t = np.cumsum(r.choice([20.0, 33.0, 40.0, 90.0], n, p=[0.4, 0.4, 0.19, 0.01]))
    level = np.repeat(r.choice([0.3, 0.05, 0.2, 0.26], n // 5, p=[0.6, 0.2, 0.1, 0.1]), 5) + r.normal(0, 0.01, n)
    level[700:760] = 0.05
    rows = pd.DataFrame({"t_ms": t, "aperture": level, "bin": (t // 5000).astype(int) + np.cumsum(r.random(n) < 0.001), "reference": 0.3})
    cuts = list(range(1, n)) if seed == 0 else cuts_of(r, n)
    same(cut_fold(folds.Blinks(), rows, cuts, 1500), detect.blink_fold(rows))


@pytest.mark.parametrize("seed", range(8))
def test_expressions_for_any_cut(seed):
    r = np.random.default_rng(seed)
    n = 2500
    rise = np.repeat(r.choice([0, 0.03, 0.05, 0.08], n // 20, p=[0.4, 0.2, 0.2, 0.2]), 20) + r.random(n) / 1000
    rise[500:800] = 0.05
    rows = pd.DataFrame({"t_ms": np.cumsum(r.choice([40.0, 50.0, 250.0], n, p=[0.6, 0.395, 0.005])), "left_y": 0.1 - rise, "right_y": 0.1 - rise / 2, "left_eye": 0.3 - rise, "right_eye": 0.3})
    rows = rows.assign(rest_left_y=0.1, rest_right_y=0.1, rest_left_eye=0.28, rest_right_eye=0.3)
    same(cut_fold(folds.Expressions(), rows, cuts_of(r, n), 12_000), detect.expression_fold(rows))


@pytest.mark.parametrize("seed", range(12))
def test_noise_floors_for_any_cut(seed):
    r = np.random.default_rng(seed)
    parts, t = [], 0
    for _ in range(25):
        kind, length = ("loud", int(r.integers(100, 700))) if r.random() < 0.4 else ("quiet", int(r.integers(500, 3500)))
        over = {} if r.random() < 0.6 else [{"rms": 0.0019 if kind == "quiet" else 0.013}, {"identity": "b"}, {"usable": False}, {"cpp_db": 9.5}][int(r.integers(0, 4))]
        parts.append((kind, t, t + length // 10 * 10, 10, over))
        t += length // 10 * 10 + (60 if r.random() < 0.1 else 0)
    rows = noise_frames(*parts)
    rows["rms"] *= r.uniform(0.9, 1.2, len(rows))
    wanted = detect.noise_fold(rows)
    same(cut_fold(folds.Noise(), rows, cuts_of(r, len(rows)), 1300), wanted)
    same(cut_fold(folds.Noise(), rows, list(range(1, len(rows), 7))), wanted)


def test_some_noise_floors_are_found():
    rows = noise_frames(("loud", 0, 500, 10, {}), ("quiet", 500, 2490, 10, {}), ("loud", 2490, 3000, 10, {}), ("quiet", 3000, 6000, 10, {}))
    assert len(cut_fold(folds.Noise(), rows, [3, 55, 56, 200, 280])) == 2


def test_windows_rotate():
    rows = pd.DataFrame([(0, 1.0, "a"), (50, 1.0, "a"), (90, 1.0, "a"), (120, 1.0, "a"), (500, 1.0, "a"), (510, 1.0, "b")], columns=["at_ms", "value", "source"])
    fold = folds.Windows(window_ms=100, max_rows=2)
    for cuts in ([], [1, 2, 3, 4, 5], [3]):
        found = cut_fold(fold, rows, cuts)
        assert found.to_numpy().tolist() == [
            [0, 0, 100, 2, 1, 2.0, "full"], [1, 100, 200, 1, 0, 1.0, "full"], [2, 500, 510, 1, 0, 1.0, "source-changed"], [3, 510, 510, 1, 0, 1.0, "ended"]
        ]


def test_windows_lie_on_the_clock():
    rows = pd.DataFrame([(130, 1.0), (190, 1.0), (195, 2.0), (200, 1.0), (720, None), (800, 3.0)], columns=["at_ms", "value"])
    for cuts in ([], [1, 2, 3, 4, 5], [2]):
        found = cut_fold(folds.ClockWindows(window_ms=100, max_rows=2), rows, cuts)
        assert found.to_numpy().tolist() == [
            [1, 100, 200, 2, 1, 2.0, "full"], [2, 200, 300, 1, 0, 1.0, "full"], [7, 700, 800, 1, 0, 0.0, "full"], [8, 800, 800, 1, 0, 3.0, "ended"]
        ]


def rows_of(n, seed=3):
    r = np.random.default_rng(seed)
    out = [(f"s{k % 3}", float(10 * k), float(r.integers(0, 9)), "x" if k < n * 0.7 else "y", 1, False) for k in range(n)]
    return [out[k] for k in np.argsort(np.arange(n) + r.uniform(0, 40, n))]  # up to 400 ms out of order


def stream_of(spark, path, batches):
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(f"{path}/{number:03d}")
        time.sleep(0.01)
    return spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def told(spark, tmp_path, name, batches, lateness, fold, **more):
    stream = stream_of(spark, str(tmp_path / name / "in"), batches)
    tagged = ordered.ordered(stream, "s", "t_ms", fold, lateness, **more)
    kept = {k: v for k, v in more.items() if k in ("epoch", "order")}
    return ordered.run_to_end(tagged, str(tmp_path / name / "out"), str(tmp_path / name / "check"), "s", "t_ms", fold, **kept)


def test_any_order_within_the_lateness_gives_the_same_windows(spark, tmp_path):
    fold, rows = folds.Windows("t_ms", "value", "source", 700.0), rows_of(240)
    found = []
    for name, batches in (("one", [rows]), ("five", [rows[k : k + 48] for k in range(0, 240, 48)]), ("shuffled", [rows[k : k + 24] for k in (24, 0, 72, 48, 96, 144, 120, 168, 216, 192)])):
        tagged = told(spark, tmp_path, name, batches, 1000.0, fold)
        assert ordered.refused(tagged, "s").count() == 0
        assert ordered.closed(tagged, "s").agg(F.sum("accepted")).first()[0] == 240
        found.append(sorted(map(tuple, ordered.results(tagged, "s", fold).collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) >= 9


def test_what_cannot_be_taken_is_told(spark, tmp_path):
    first = [("a", t, 1.0, "x", 2, False) for t in (0.0, 10.0, 500.0)]
    second = [
        ("a", 100.0, 1.0, "x", 2, False), ("a", 600.0, 1.0, "x", 1, False), ("a", None, 1.0, "x", 2, False), ("a", float("nan"), 1.0, "x", 2, False), ("a", 610.0, 1.0, "x", None, False),
        ("a", 500.0, 2.0, "x", 2, False),
    ]
    third = [("a", 5.0, 1.0, "x", 3, False), ("a", 6.0, 1.0, "x", 3, False)]
    fold = folds.Windows("t_ms", "value", "source", 1000.0, max_rows=3)
    tagged = told(spark, tmp_path, "refusals", [first, second, third], 200.0, fold, epoch="epoch")
    refused = sorted((r.reason, r.row_at_ms) for r in ordered.refused(tagged, "s").collect() if r.reason != "no-time")
    assert refused == [("no-room", 500.0), ("old-epoch", 600.0), ("too-late", 100.0)]
    assert [json.loads(r.row)["value"] for r in ordered.refused(tagged, "s").filter("reason = 'no-room'").collect()] == [2.0]  # equal times go in the order of arrival
    assert ordered.refused(tagged, "s").filter("reason = 'no-time'").count() == 3
    assert [tuple(r) for r in ordered.closed(tagged, "s").collect()] == [("a", 5, 6)]
    windows = sorted((r.start_ms, r.end_ms, r["rows"], r.ended_by) for r in ordered.results(tagged, "s", fold).collect())
    assert windows == [(0.0, 500.0, 3, "ended"), (5.0, 6.0, 2, "ended")]  # another epoch, other windows


def test_waiting_rows_are_bounded(spark, tmp_path):
    rows = [("a", float(t), 1.0, "x", 1, False) for t in range(100)]
    fold = folds.Windows("t_ms", "value", "source", 1e9)
    tagged = told(spark, tmp_path, "bounded", [rows, [("a", 10.0, 1.0, "x", 1, False)]], 1e9, fold, max_waiting=20)
    assert [(r.row_at_ms, r.reason) for r in ordered.refused(tagged, "s").collect()] == [(10.0, "too-late")]
    assert [tuple(r) for r in ordered.closed(tagged, "s").collect()] == [("a", 100, 1)]


def running(spark, tmp_path, tagged, done, seconds=60):
    """Runs a query with timers until its output satisfies done; that output, and the state's number of rows."""
    query = tagged.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="100 milliseconds").start()
    try:
        for _ in range(seconds * 5):
            time.sleep(0.2)
            if (tmp_path / "out" / "_spark_metadata").exists():
                rows = spark.read.schema(tagged.schema).parquet(str(tmp_path / "out")).collect()
                progress = query.lastProgress
                left = progress["stateOperators"][0]["numRowsTotal"] if progress and progress["stateOperators"] else None
                if done(rows, left):
                    return rows, left
        raise AssertionError("nothing came")
    finally:
        query.stop()


def test_closed_and_silent_sessions_leave_no_state(spark, tmp_path):
    fold = folds.Windows("t_ms", "value", "source", 100.0)
    rows = [[("closes", float(t), 1.0, "x", 1, t == 40) for t in range(0, 50, 10)], [("silent", float(t), 1.0, "x", 1, False) for t in range(0, 50, 10)]]
    tagged = ordered.ordered(stream_of(spark, str(tmp_path / "in"), rows), "s", "t_ms", fold, 1000.0, closes="over", ttl_ms=1500)
    found, left = running(spark, tmp_path, tagged, lambda rows, left: sum(r.tag == "closed" for r in rows) == 2 and left == 0)
    assert sorted((r.s, r["rows"], r.ended_by) for r in found if r.tag == "result") == [("closes", 5, "ended"), ("silent", 5, "ended")] and left == 0


def test_a_silent_lane_is_told_by_the_clock(spark, tmp_path):
    spark.createDataFrame([("l", 0.0, "processed", True), ("l", 30.0, "camera", False)], "lane string, at double, kind string, up boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("lane string, at double, kind string, up boolean").parquet(str(tmp_path / "in"))
    found, left = running(spark, tmp_path, ordered.lane_health(stream, "lane", "at", "kind", "up", gap_ms=300, ttl_ms=1000), lambda rows, left: rows and left == 0)
    assert [(r.measurable, r.reasons, r.by) for r in found] == [(False, "camera-unavailable,visual-frame-gap", "timer")] and found[0].at_ms > 300


def test_lane_state_carries_over_batches():
    rows = [(0.0, "processed", True), (100.0, "evaluate", True), (201.0, "evaluate", True), (250.0, "camera", False), (260.0, "processed", True), (255.0, "camera", True), (270.0, "evaluate", True)]
    whole, _ = ordered.lane_state(rows, None)
    one, state = ordered.lane_state(rows[:3], None)
    assert whole == one + ordered.lane_state(rows[3:], state)[0]
    assert whole == [(100.0, True, "", "row"), (201.0, False, "visual-frame-gap", "row"), (255.0, None, "camera", "late"), (270.0, False, "camera-unavailable", "row")]


def test_window_metrics_are_published_once(spark, tmp_path):
    """Each closed window's frames, and only those, are measured, in the batch that closes it or at the end."""
    rows = [[("a", float(t), 1.0, "x", 1, False) for t in range(k, k + 400, 10)] for k in (0, 400, 800)]
    stream, fold = stream_of(spark, str(tmp_path / "in"), rows), folds.Windows("t_ms", "value", "source", 500.0)
    frames = spark.range(120).select(F.lit("a").alias("session_id"), (F.col("id") * 10.0).alias("t_ms"))

    def counted(own, sessions):
        return own.groupBy("session_id").agg(F.count("*").alias("n"), F.max("t_ms").alias("last")).join(sessions, "session_id", "right")

    found = flows.window_metrics(flows.rotating_windows(stream, "s", fold, 50.0), "s", fold, lambda: frames, "voice", counted, str(tmp_path / "out"), str(tmp_path / "check"))
    assert sorted((r.s, r.window_no, r.n, r["last"]) for r in found.collect()) == [("a", 0, 50, 490.0), ("a", 1, 50, 490.0), ("a", 2, 19, 180.0)]


def test_the_query_keeps_every_row(spark, tmp_path):
    start = F.lit("2024-01-01").cast("timestamp")
    hot = spark.range(3000).select(F.col("id").alias("event_id"), F.lit(1).cast("long").alias("user_id"), F.lit("e").alias("event_type"), F.lit(1.0).alias("value"), start.alias("ts"))
    hot.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    assert [(r.accepted, r.refused) for r in streams.stream_closed_keys(spark, str(tmp_path)).collect()] == [(15, 2985)]
