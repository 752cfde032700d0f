import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import compare, detect, face, gates, geometry, governance, history, ingest, journal, provenance, robust, sessionize, signals, voice
from tidemark.sources import schemas
from tidemark.streaming import flows


def one(spark, ddl, row, **columns):
    return spark.createDataFrame([row], ddl).select(*[c.alias(k) for k, c in columns.items()]).first()


# scalars and statistics


def test_finite_and_clamp(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (math.inf,), (None,), (-2.0,)], "x double")
    assert [r[0] for r in df.select(S.finite("x")).collect()] == [True, False, False, False, True]
    assert [r[0] for r in df.filter("x is null or not isnan(x)").select(S.clamp01("x")).collect()] == [1.0, 1.0, None, 0.0]


def test_reasons_keep_their_order_and_null_conditions_fail_nothing(spark):
    r = one(
        spark, "a int, b int", (5, None), all=S.reasons([(F.col("a") > 1, "x"), (F.col("b") > 1, "y"), (F.col("a") > 2, "z")]),
        first=S.first_reason([(F.col("b") > 1, "y"), (F.col("a") > 2, "z")])
    )
    assert r["all"] == ["x", "z"] and r["first"] == "z"


def test_canonical_json_and_digest(spark):
    df = spark.createDataFrame([(1, None)], "b int, a string")
    r = df.select(S.canonical_json({"b": "b", "a": "a"}).alias("j"), S.digest({"b": "b", "a": "a"}).alias("d"))
    assert r.first().j == '{"a":null,"b":1}'
    assert r.select(S.digest_verified({"x": F.lit(1)}, F.col("d"))).first()[0] is False


def test_length_prefix_tells_parts_apart(spark):
    r = one(spark, "a string, b string, c string", ("a|1:b", "a", None), x=S.length_prefixed("a", "c"), y=S.length_prefixed("b", "a"))
    assert r.x != r.y and S and r.x.endswith("-1:")


def test_window_refs(spark):
    low, high = S.window_ref_bounds(F.col("w"))
    r = one(spark, "w string", ("voice:1:mic:10.5:20.5",), low=low, high=high)
    assert (r.low, r.high) == (10.5, 20.5)
    low, high = S.window_ref_bounds(F.lit("x"))
    assert tuple(one(spark, "w string", ("x",), low=low, high=high)) == (None, None)


def test_clock_calibration(spark):
    probe = lambda *x: one(spark, "a double, b double, c double, d double, e double, f double, g double", x, k=S.clock_calibration("a", "b", "c", "d", "e", "f", "g")).k
    good = probe(1005.0, 1006.0, 0.0, 11.0, 11.0, 1.0, 1e9)
    assert (good.offset_ms, good.uncertainty_ms, good.expires_at_ms, good.error) == (1000.0, 15.0, 60011.0, None)
    assert probe(1005.0, 1004.0, 0.0, 11.0, 11.0, 1.0, 1e9).error == "invalid-round-trip"
    assert probe(1005.0, 1006.0, 0.0, 11.0, 90.0, 1.0, 1e9).error == "local-clock-discontinuity"
    assert probe(1005.0, 1006.0, 0.0, 11.0, 11.0, 1.0, 1.0).error == "source-expired"


def test_coding_label_and_dose(spark):
    df = spark.createDataFrame([([("", "1"), ("s", "2")], -1.0, "mg")], "c array<struct<system: string, code: string>>, v double, u string")
    r = df.select(S.coding_label("c").alias("l"), S.positive_dose("v", "u").alias("d"), S.positive_dose(F.lit(2.0), "u").alias("e")).first()
    assert r.l == "s|2" and r.d is None and r.e.value == 2.0


def test_median_mad_and_sd(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 10.0), ("b", 3.0)], "k string, x double")
    stats = {r.k: r for r in robust.median_and_mad(df, ["k"], "x", robust.population_sd("x").alias("sd"), robust.percentile("x", 0.25).alias("q")).collect()}
    assert (stats["a"].median_value, stats["a"].mad_value, stats["a"].q) == (2.0, 1.0, 1.5)
    assert (stats["b"].median_value, stats["b"].mad_value, stats["b"].sd) == (3.0, 0.0, 0.0)


def test_timed_percentile_does_not_interpolate(spark):
    df = spark.createDataFrame([(0.0, 1.0), (10.0, 5.0), (90.0, 2.0)], "t double, x double").withColumn("k", F.lit(1))
    w = robust.frame_weights(df, ["k"], ["t"], "t", 1000.0, 10.0)
    assert robust.timed_percentile(w, ["k"], "x", "weight_ms", 0.4, ["t"]).first().timed_percentile == 2.0
    zero = df.withColumn("w", F.lit(0.0))
    assert robust.timed_percentile(zero, ["k"], "x", "w", 0.5, ["t"]).first().timed_percentile == 2.0


def test_interval_union_joins_touching_intervals(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 1, 3), (1, 9, 10), (1, None, 4), (1, 8, 2)], "k int, a int, b int")
    r = robust.interval_union(df, ["k"], "a", "b").first()
    assert (r.union_length, r.islands, r.cover_start, r.cover_end) == (8, 2, 0, 10)


def test_rejected_rows_are_boundaries(spark):
    rows = [(1, k, k * 10.0, k != 5, 1) for k in range(10)] + [(1, k, k * 10.0 + 100, True, 1) for k in range(10, 14)]
    df = spark.createDataFrame(rows, "s int, k int, t double, usable boolean, epoch int")
    cut = sessionize.usable_segments(df, ["s"], ["t"], "t", "usable", ["epoch"], 40, F.floor(F.col("t") / 30))
    by = {}
    for r in cut.collect():
        by.setdefault((r.continuity_no, r.segment_no), []).append(r.k)
    assert sorted(map(sorted, by.values())) == [[0, 1, 2], [3, 4], [6, 7, 8], [9], [10], [11, 12, 13]]
    assert len({c for c, _ in by}) == 3


# gates


def voice_frame(**over):
    base = dict(
        session_id="s", t_ms=0.0, acquired_at_ms=0.0, capture_epoch=1, sequence=1, absolute_sample_index=0, task_context="ambient-speech-turn", track_segment_id="m", processor_ref="p", speech_active=True, periodic=True, syllabic_nucleus=False,
        rms=0.08, f0_hz=140.0, f0_confidence=0.92, estimator_agreement=0.95, snr_db=26.0, dc_offset=0.001, spectral_flux=0.0, cepstral_peak_prominence_db=9.0, clipped_sample_fraction=0.0, lost_block_fraction=0.0, block_gap_ms=0.0, sample_rate_hz=48000.0,
        browser_processing=(False, False, False), quality_reasons=[],
    )
    return tuple((base | over).values())


def gate(spark, **over):
    return spark.createDataFrame([voice_frame(**over)], schemas.VOICE_FRAMES).select(
        gates.voice_gate_failures().alias("f"), gates.voice_timing_usable().alias("t"), gates.valid_pitch().alias("p")
    ).first()


@pytest.mark.parametrize(
    "over,failures,timing,pitch",
    [
        ({}, [], True, True),
        ({"snr_db": 10.0}, ["speech-snr-pitch-only"], True, False),
        ({"snr_db": float("nan")}, ["non-finite-snr"], False, False),
        ({"snr_db": None}, ["non-finite-snr"], False, False),
        ({"task_context": None, "track_segment_id": ""}, ["task-context", "no-track-id"], False, True),
        ({"block_gap_ms": 41.0, "dc_offset": -0.03}, ["block-gap", "dc-offset"], False, True),
        ({"quality_reasons": ["audio-clipping", "other"]}, ["quality:audio-clipping"], False, True),
        ({"f0_hz": None}, [], True, False),
        ({"f0_hz": 701.0}, [], True, False),
        ({"quality_reasons": None}, [], True, True),
    ],
)
def test_voice_gates(spark, over, failures, timing, pitch):
    r = gate(spark, **over)
    assert (r.f, r.t, r.p) == (failures, timing, pitch)


def face_frame(**over):
    base = dict(
        session_id="s", t_ms=0.0, acquired_at_ms=0.0, sequence=1, capture_epoch=1, task_context="ambient-frontal", processor_ref="p", track_segment_id="t", face_count=1, face_visible=True, bounding_box=(0.35, 0.2, 0.3, 0.5, 384.0, 360.0, 0.1), pose=(0.0, 0.0, 0.0),
        eye_aperture=(0.3, 0.3), brow_height=(0.55, 0.55), fissure_width=None, fissure_height=None, iris_diameter=None, mouth_corners=((0.3, 0.1), (-0.3, 0.1)), gaze_offset=None, mouth_aperture_ratio=0.08, mouth_midline_offset=None, regional_movement_speed=0.02,
        inter_result_gap_ms=50.0, image_quality=(0.55, 0.02, 0.02, 0.002), analyzed_frame_rate=30.0, skipped_frame_fraction=0.0, processing_latency_ms=8.0, quality_reasons=[],
    )
    return tuple((base | over).values())


@pytest.mark.parametrize(
    "over,reasons,event,failures",
    [
        ({}, [], True, []),
        ({"pose": (12.0, 0.0, 0.0)}, [], True, ["yaw"]),
        ({"pose": (16.0, 0.0, 0.0)}, ["pose-out-of-range"], True, ["yaw"]),
        ({"pose": None}, ["face-not-visible"], False, ["image-quality", "no-pose"]),
        ({"image_quality": (0.05, 0.02, 0.02, 0.0001)}, ["illumination-out-of-range", "blur"], False, ["image-quality"]),
        ({"inter_result_gap_ms": None}, [], True, []),
        ({"inter_result_gap_ms": 201.0}, ["visual-frame-gap"], False, ["image-quality"]),
        ({"face_count": 2}, [], False, ["face-count"]),
        ({"bounding_box": (0.3, 0.2, 0.3, 0.5, 500.0, 360.0, 0.1)}, [], True, ["face-scale"]),
        ({"eye_aperture": (None, 0.3)}, [], False, ["incomplete-geometry"]),
        ({"quality_reasons": ["blur", "document-hidden"]}, ["document-hidden", "blur"], False, ["image-quality"]),
    ],
)
def test_face_gates(spark, over, reasons, event, failures):
    calibration = F.struct(F.lit(384.0).alias("baseline_box_width_pixels"), F.lit(360.0).alias("baseline_box_height_pixels"))
    resting = F.lit(None).cast("struct<yaw_degrees: double, pitch_degrees: double, roll_degrees: double>")
    df = spark.createDataFrame([face_frame(**over)], schemas.FACE_FRAMES)
    r = df.select(gates.visual_quality_reasons().alias("q"), gates.event_usable().alias("e"), gates.face_gate_failures(calibration, resting).alias("f")).first()
    assert (r.q, r.e, r.f) == (reasons, event, failures)


def test_a_resting_pose_moves_the_gate(spark):
    rows = [face_frame(t_ms=50.0 * k, sequence=k, pose=(0.0, 7.4, 0.0)) for k in range(20)] + [face_frame(t_ms=2000.0, sequence=30, pose=(0.0, 16.0, 0.0))]
    df = spark.createDataFrame(rows, schemas.FACE_FRAMES)
    assert face.resting_pose(df).first().resting.pitch_degrees == 7.4
    away = spark.createDataFrame([face_frame(pose=(11.0, 0.0, 0.0))], schemas.FACE_FRAMES)
    assert face.resting_pose(away).first().resting is None


# lanes


def test_clean_minute_of_voice_is_measured(spark):
    rows = [voice_frame(
        t_ms=10.0 * k, sequence=k, speech_active=(k // 100) % 4 != 3, periodic=(k // 100) % 4 != 3, f0_hz=140.0 + 5 * math.sin(k / 20),
        syllabic_nucleus=k % 40 == 0
    ) for k in range(6000)]
    sessions = spark.createDataFrame([("s", 0.0, 2500.0), ("none", 0.0, 2500.0), ("raw", 0.0, 100.0)], "session_id string, session_started_at_ms double, noise_calibration_duration_ms double")
    found = {(r.session_id, r.metric_code.split("voice.")[1]): r for r in voice.metrics(spark.createDataFrame(rows, schemas.VOICE_FRAMES), sessions).collect()}
    assert len(found) == 21
    assert {r.status for (s, _), r in found.items() if s == "s"} == {"measured"}
    assert found["s", "speech_activity_fraction"].value == pytest.approx(0.75, abs=0.01)
    assert found["s", "f0.median"].value == pytest.approx(140, abs=1) and found["s", "pause_duration.median"].value == pytest.approx(1.0, abs=0.02)
    assert {r.reason_code for (s, _), r in found.items() if s == "none"} == {"no-usable-signal"} and all(r.value is None for (s, _), r in found.items() if s != "s")
    assert {r.reason_code for (s, _), r in found.items() if s == "raw"} == {"quality-threshold-failed"}


def test_face_minute_is_measured_without_its_bad_frames(spark):
    rows = [face_frame(t_ms=50.0 * k, sequence=k, image_quality=(0.55, 0.02, 0.02, 0.0001 if k % 9 == 0 else 0.002)) for k in range(1200)]
    rows += [face_frame(session_id="short", t_ms=50.0 * k, sequence=k) for k in range(250)]
    sessions = spark.createDataFrame(
        [("s", 0.0, (2000.0, 384.0, 360.0)), ("short", 0.0, (2000.0, 384.0, 360.0))],
        schemas.SESSIONS.replace("protocol_version string, protocol_sha256 string, ", "").replace("noise_calibration_duration_ms double, ", "")
    )
    found = {(r.session_id, r.metric_code): r for r in face.metrics(spark.createDataFrame(rows, schemas.FACE_FRAMES), sessions).collect()}
    assert found["s", "ambient.face.eye_aperture.left"].value == 0.3 and found["s", "ambient.face.mouth_width"].value == pytest.approx(0.6)
    withheld = {m.split("face.")[1]: r.reason_code for (s, m), r in found.items() if s == "s" and r.status == "withheld"}
    assert len(found) == 40 and withheld == {
        "blink_rate.bilateral": "insufficient-exposure", "spontaneous_excursion.p90": "insufficient-events", "spontaneous_excursion_asymmetry.median": "insufficient-events", "oculo_oral_synkinesis_index": "insufficient-events",
    }
    assert found["s", "ambient.face.spontaneous_event_rate"].value == 0 and found["s", "ambient.face.lid_closure_completeness.left"].value == 0
    assert found["s", "ambient.face.eye_aperture.left"].quality == pytest.approx(0.3 * 20 / 30 + 0.3 * 1.0 * 0.889 + 0.2 + 0.2, abs=0.02)
    assert {r.reason_code for (s, _), r in found.items() if s == "short"} == {"insufficient-bins"}


# detectors


def blinks_of(apertures, step=33.0, bins=None):
    t = np.arange(len(apertures)) * step
    return detect.blink_fold(pd.DataFrame({"t_ms": t, "aperture": apertures, "bin": [0] * len(t) if bins is None else bins, "reference": 0.3}))


def test_blink_phases_and_limits():
    wave = [0.3] * 5 + [0.2, 0.05, 0.05, 0.15, 0.3] + [0.3] * 5
    found = blinks_of(wave)
    assert len(found) == 1 and found["lid_minimum"][0] == 0.05 and found["onset_ms"][0] == 4 * 33 and found["offset_ms"][0] == 9 * 33 and found["depth"][0] == pytest.approx(5 / 6)
    assert len(blinks_of([0.3] * 3 + [0.1] + [0.3] * 3)) == 0  # too short
    assert len(blinks_of([0.3] * 3 + [0.1] * 40 + [0.3] * 3)) == 0  # too long
    assert len(blinks_of([0.3, 0.3, 0.05, 0.05, 0.05, 0.3, 0.05, 0.05, 0.05, 0.3])) == 1  # refractory
    assert len(blinks_of(wave, step=80.0)) == 0  # gaps
    assert len(blinks_of(wave, bins=[0] * 8 + [2] * 7)) == 0  # a bin is missing


def test_pairs_are_one_to_one():
    events = pd.DataFrame([("left", 0, 10, 5, 0), ("left", 8, 20, 15, 0), ("right", 9, 12, 10, 0), ("right", 40, 50, 45, 0)], columns=["side", "onset_ms", "offset_ms", "peak_ms", "bin"])
    assert detect.pair_fold(events)[["left_peak_ms", "right_peak_ms"]].to_numpy().tolist() == [[5, 10]]


def expressions_of(rises, step=50.0):
    t, r = np.arange(len(rises)) * step, np.array(rises)
    return detect.expression_fold(pd.DataFrame({
        "t_ms": t, "left_y": 0.1 - r, "right_y": 0.1 - r / 2, "left_eye": 0.3, "right_eye": 0.3, "rest_left_y": 0.1, "rest_right_y": 0.1, "rest_left_eye": 0.28,
        "rest_right_eye": 0.3
    }))


def test_expression_hysteresis():
    found = expressions_of([0, 0.03, 0.05, 0.08, 0.07, 0.05, 0.03, 0.025, 0.021, 0.01, 0])
    assert len(found) == 1 and found["start_ms"][0] == 100 and found["end_ms"][0] == 400 and found["peak_ms"][0] == 150 and found["peak_left"][0] == pytest.approx(0.08) and found["lid_delta_left"][0] == pytest.approx(0.02) and found["decay_tau_ms"][0] > 0
    assert len(expressions_of([0, 0.05, 0.05, 0])) == 0  # too short
    assert len(expressions_of([0] + [0.05] * 250 + [0])) == 1  # cut at ten seconds, then armed again
    assert len(expressions_of([0.05] * 10)) == 1  # closed by the end
    assert len(expressions_of([0.05] * 10, step=201.0)) == 0  # gaps discard


def test_schmitt_state_equals_a_loop(spark):
    values = [float(v) for v in np.random.default_rng(2).integers(0, 250, 200)]
    df = spark.createDataFrame(list(enumerate(values)), "k int, x double").withColumn("g", F.lit(1))
    state, wanted = 0, []
    for v in values:
        state = 1 if v >= 150 else 0 if v < 80 else state
        wanted.append(state)
    assert [r.s for r in df.withColumn("s", detect.schmitt_state(F.col("x"), 150, 80, ["g"], ["k"])).orderBy("k").collect()] == wanted


def test_nuclei_and_noise_floor():
    t = np.arange(400) * 10.0
    level = np.where(np.arange(400) % 30 < 3, 0.1, 0.01)
    found = detect.nucleus_fold(pd.DataFrame({"t_ms": t, "rms": level}))
    assert found["nucleus"].sum() == 14


def noise_frames(*parts):
    """Rows of (kind, first ms, end ms, step ms, overrides)."""
    kinds = {
        "loud": {"rms": 0.02, "cpp_db": 12.0, "f0_hz": 160.0, "f0_confidence": 0.9, "agreement": 0.9, "flux": 0.2},
        "quiet": {"rms": 0.001, "cpp_db": 2.0, "f0_hz": None, "f0_confidence": 0.1, "agreement": 0.1, "flux": 0.001}
    }
    rows = [{"acquired_at_ms": float(t), "usable": True, "identity": "a", **kinds[kind], **over} for kind, low, high, step, over in parts for t in range(low, high, step)]
    return pd.DataFrame(rows)


def floors(*parts):
    return detect.noise_fold(noise_frames(*parts))[["at_ms", "noise_floor_rms"]].to_numpy().tolist()


def test_noise_floor_needs_contrast_and_two_quiet_seconds():
    contrast = ("loud", 0, 500, 10, {})
    assert floors(contrast, ("quiet", 500, 2490, 10, {})) == [[2480, 0.001]]
    assert floors(contrast, ("quiet", 500, 2480, 10, {})) == []
    assert floors(("quiet", 0, 60_000, 10, {})) == [] and floors(("loud", 0, 60_000, 10, {})) == []
    assert floors(("loud", 0, 360, 10, {}), ("quiet", 360, 4000, 10, {})) == []  # too short a contrast
    assert floors(contrast, ("quiet", 500, 1000, 1, {})) == []  # windows that overlap add nothing
    assert floors(contrast, ("quiet", 500, 2490, 10, {}), ("quiet", 2490, 9000, 10, {})) == [[2480, 0.001]]  # the next one needs contrast again
    assert len(floors(contrast, ("quiet", 500, 2490, 10, {}), ("loud", 2490, 3000, 10, {}), ("quiet", 3000, 6000, 10, {}))) == 2


@pytest.mark.parametrize(
    "over",
    [{"rms": 0.003}, {"flux": 0.2}, {"cpp_db": 12.0}, {"cpp_db": 10.0}, {"f0_hz": 160.0}, {"f0_confidence": 0.5}, {"agreement": 0.5}, {"usable": False}, {"identity": "b"}]
)
def test_doubtful_frames_give_no_noise_floor(over):
    assert floors(("loud", 0, 500, 10, {}), ("quiet", 500, 4000, 10, over)) == []


def test_noise_floor_evidence_ends():
    contrast = ("loud", 0, 500, 10, {})
    assert floors(contrast, ("quiet", 1000, 5000, 10, {})) == []  # a gap
    swinging = [("quiet", t, t + 10, 10, {"rms": 0.0002 if t % 80 < 40 else 0.001}) for t in range(500, 35_000, 10)]
    assert floors(contrast, *swinging, ("quiet", 35_000, 38_000, 10, {})) == []  # unsteady, and then the contrast is too old
    late = [("quiet", t, t + 10, 10, {"rms": 0.0002 if t % 80 < 40 else 0.001}) for t in range(500, 20_000, 10)]
    assert len(floors(contrast, *late, ("quiet", 20_000, 23_000, 10, {}))) == 1  # steady in time
    rising = [("quiet", t, t + 10, 10, {"cpp_db": 11.0}) for t in range(500, 3000, 10)]
    assert len(floors(contrast, *rising, ("quiet", 3000, 5000, 10, {}))) == 1  # slides on until the median has dropped


def blinks_by_frame(t, aperture, bins, reference):
    """The rules of blinks, told frame by frame."""
    out, start, wait, seen_open, ended = [], None, False, None, -math.inf
    for k, (x, a) in enumerate(zip(t, aperture, strict=True)):
        if k and (x - t[k - 1] > 75 or bins[k] - bins[k - 1] not in (0, 1)):
            start, wait, seen_open = None, False, None
        is_open = a >= 0.8 * reference
        if wait:
            wait = not is_open
        elif start is not None:
            took = x - t[start]
            if took > 800:
                start, wait = None, True
            elif is_open:
                if took >= 50:
                    low = min(range(start, k + 1), key=lambda j: (aperture[j], j))
                    out.append((onset, t[low], x, sum(t[j] - t[j - 1] for j in range(start + 1, k + 1) if aperture[j] <= 0.6 * reference)))
                    ended = x
                start = None
        elif a <= 0.6 * reference and x - ended >= 150:
            start, onset = k, x if seen_open is None else seen_open
        seen_open = x if is_open else seen_open
    return out


@pytest.mark.parametrize("seed", range(6))
def test_blinks_equal_their_rules_told_frame_by_frame(seed):
    r = np.random.default_rng(seed)
    n = 3000
    t = np.cumsum(r.choice([20.0, 33.0, 40.0, 90.0], n, p=[0.4, 0.4, 0.19, 0.01]))
    level = np.repeat(r.choice([0.3, 0.05, 0.2, 0.26], n // 5, p=[0.6, 0.2, 0.1, 0.1]), 5) + r.normal(0, 0.01, n)
    bins = (t // 5000).astype(int) + np.cumsum(r.random(n) < 0.001)
    found = detect.blink_fold(pd.DataFrame({"t_ms": t, "aperture": level, "bin": bins, "reference": 0.3}))
    assert np.allclose(found[["onset_ms", "peak_ms", "offset_ms", "closed_dwell_ms"]].to_numpy(float), np.array(blinks_by_frame(t, level, bins, 0.3))) and len(found) > 20


@pytest.mark.parametrize("seed", range(4))
def test_expressions_equal_their_rules_told_frame_by_frame(seed):
    r = np.random.default_rng(seed)
    n = 4000
    t = np.cumsum(r.choice([40.0, 50.0, 250.0], n, p=[0.6, 0.395, 0.005]))
    rise = np.repeat(r.choice([0, 0.03, 0.05, 0.08], n // 20, p=[0.4, 0.2, 0.2, 0.2]), 20)
    rise[500:800] = 0.05  # longer than ten seconds
    wanted, held = [], []
    for k in range(n):
        if k and t[k] - t[k - 1] > 200:
            held = []
        if held and rise[k] < 0.02:
            wanted += [(t[held[0]], t[held[-1]])] if t[held[-1]] - t[held[0]] >= 300 else []
            held = []
        elif held or rise[k] >= 0.04:
            held = [*held, k]
            held = [] if t[k] - t[held[0]] > 10_000 else held
    wanted += [(t[held[0]], t[held[-1]])] if held and t[held[-1]] - t[held[0]] >= 300 else []
    assert [(t[a], t[b - 1]) for a, b in detect.expression_spans(t, rise)] == wanted and len(wanted) > 20


# geometry and signals


@pytest.mark.parametrize("angles", [(0, 0, 0), (20, -10, 5), (-35, 40, -60)])
def test_pose_round_trip(spark, angles):
    scaled = [v * 2.5 for v in geometry.rotation(*angles)]
    r = one(spark, "m array<double>", (scaled,), p=geometry.pose("m")).p
    assert (r.yaw_degrees, r.pitch_degrees, r.roll_degrees) == pytest.approx(angles, abs=1e-9)
    assert one(spark, "m array<double>", ([1.0],), p=geometry.pose("m")).p is None


def test_level_face(spark):
    points = [(0.5, 0.5)] * 478
    for index, p in {
        362: (0.6, 0.4), 263: (0.7, 0.4), 33: (0.3, 0.4), 133: (0.4, 0.4), 385: (0.63, 0.38), 380: (0.63, 0.42), 387: (0.67, 0.38), 373: (0.67, 0.42),
        291: (0.6, 0.7), 61: (0.4, 0.7), 13: (0.5, 0.69), 14: (0.5, 0.73), 473: (0.65, 0.4), **{k: (0.66, 0.4) for k in (474, 475, 476, 477)}
    }.items():
        points[index] = p
    f = geometry.Face("p", F.lit(100.0), F.lit(100.0))
    s = f.system()
    r = one(
        spark, "p array<struct<x: double, y: double>>", (points,), s=s, a=f.eye_aperture("left_eye"), m=f.mouth_aperture(), o=f.mouth_midline_offset(s),
        i=f.iris("left", s), j=f.iris("right", s), b=f.bounding_box(), w=f.fissure("left_eye", s)
    )
    assert (r.s.scale, r.s.angle) == (pytest.approx(30), 0.0) and r.a == pytest.approx(0.4) and r.m == pytest.approx(0.2) and r.o == pytest.approx(0.0)
    assert r.i.gaze_x == pytest.approx(0.0) and r.i.diameter == pytest.approx(2 / 30) and r.j is None and r.w.width == pytest.approx(1 / 3)
    short = one(spark, "p array<struct<x: double, y: double>>", (points[:468],), i=f.iris("left", s), b=f.bounding_box())
    assert short.i is None and short.b.width == pytest.approx(0.4)
    assert one(spark, "p array<struct<x: double, y: double>>", ([(1.2, 0.5)],), b=f.bounding_box()).b is None


def test_pitch_of_a_tone(spark):
    for hz in (90, 200, 400):
        auto, _, difference, _, crossing, _ = signals.pitch_estimates(np.sin(2 * np.pi * hz * np.arange(800) / 8000), 8000)
        assert all(x == pytest.approx(hz, rel=0.06) for x in (auto, difference, crossing))
    noise = signals.pitch_estimates(np.random.default_rng(0).normal(size=800), 8000)
    assert noise[0] is None
    agree = lambda *x: one(spark, "a double, b double, c double, d double, e double, f double", x, p=signals.pitch_consensus(*[F.col(k) for k in "abcdef"])).p
    assert agree(200.0, 0.9, 204.0, 0.8, None, 0.0).hz == 202.0
    octave = agree(200.0, 0.9, 100.0, 0.8, 101.0, 0.7)
    assert (octave.hz, octave.agreement, octave.confidence) == (100.5, 0.8, 0.7)
    assert agree(200.0, 0.9, 150.0, 0.8, None, 0.0).hz is None and agree(None, 0.1, 150.0, 0.8, None, 0.0).agreement == 0.0


def test_pooling_leaves_out_vectors_that_are_not_finite(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 6.0]), ("a", [float("nan"), 1.0]), ("a", None)], "k string, v array<float>")
    assert [(r.dimension, r.mean_value, r.sd_value, r.n) for r in signals.pooled(df, ["k"], "v").orderBy("dimension").collect()] == [(0, 2.0, 1.0, 2), (1, 4.0, 2.0, 2)]


# histories


@pytest.mark.parametrize(
    "rows,leaf,problems",
    [
        ([("r1", None, 1), ("r2", "r1", 2), ("r3", "r2", 2)], "r3", []),
        ([("r1", None, 1), ("r2", "r1", 2), ("r3", "r1", 3)], None, ["no-single-leaf", "revision-fork"]),
        ([("r1", None, 1), ("r2", "gone", 2)], None, ["no-single-leaf", "invalid-link"]),
        ([("r1", None, 5), ("r2", "r1", 2)], None, ["no-single-leaf", "invalid-link"]),
        ([("r1", None, 1), ("r2", "r3", 2), ("r3", "r2", 2)], None, ["revision-cycle"]),
        ([("r1", None, 1), ("r2", None, 2)], None, ["no-single-root", "no-single-leaf"]),
    ],
)
def test_revision_chains(spark, rows, leaf, problems):
    df = spark.createDataFrame([("t", "x", *r) for r in rows], "scope string, id string, rev string, prev string, at int")
    r = history.chain_audit(df, ["scope"], "id", "rev", "prev", "at").first()
    assert (r.leaf, r.problems) == (leaf, problems)


def test_periods_are_strict(spark):
    days = [(-1.0, -0.5), (-1.0, 0.0), (0.0, 1.0), (-1.0, 0.5), (-60.0, -50.0), (100.0, 200.0), (None, None)]
    df = spark.createDataFrame(days, "a double, b double")
    assert [r[0] for r in df.select(history.period(F.col("a"), F.col("b"), -56, 0, 112)).collect()] == [
        "baseline", "treatment-time-overlap", "followup", "treatment-time-overlap", "outside-analysis-window", "outside-analysis-window", None
    ]


def test_baseline_weighs_encounters(spark):
    df = spark.createDataFrame([("p", "e1", 1.0), ("p", "e1", 1.0), ("p", "e1", 4.0), ("p", "e2", 9.0), ("q", "e1", 1.0)], "p string, e string, v double")
    found = {r.p: r for r in history.baseline(df, ["p"], "e", "v", 2, 2).collect()}
    assert found["p"].baseline_value == 5.0 and found["q"].baseline_value is None and found["q"].baseline_reason == "insufficient-baseline-observations"


def test_reference_stratum_prefers_the_baseline(spark):
    df = spark.createDataFrame([("p", "late", False, 1), ("p", "early", True, 2), ("q", "only", False, 3)], "p string, f string, b boolean, o int")
    assert {r.p: r.reference_fingerprint for r in history.reference_stratum(df, ["p"], "f", "b", ["o"]).collect()} == {"p": "early", "q": "only"}


def test_comparison_rules(spark):
    rows = [([], "measured", "measured", 1.0, 3.0), (["x"], "withheld", "measured", 1.0, 3.0), ([], "withheld", "measured", 1.0, 3.0), ([], "measured", "measured", 1.0, math.inf)]
    df = spark.createDataFrame(rows, "r array<string>, a string, b string, x double, y double")
    status, delta, reasons = compare.comparison(F.col("r"), F.col("a"), F.col("b"), F.col("x"), F.col("y"))
    assert [tuple(r) for r in df.select(status, delta, reasons).collect()] == [
        ("measured", 2.0, []), ("incompatible", None, ["x"]), ("withheld", None, []), ("incompatible", None, ["non-finite-delta"])
    ]


def test_admission(spark):
    ddl = "k string, h string, o int"
    log, batch = spark.createDataFrame([("a", "1", 0)], ddl), spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("b", "5", 1), ("b", "5", 2), ("b", "6", 3)], ddl)
    assert sorted((r.k, r.o, r.admission) for r in ingest.classify_batch(batch, log, ["k"], "h", ["o"]).collect()) == [
        ("a", 1, "duplicate"), ("a", 2, "conflict"), ("b", 1, "new"), ("b", 2, "duplicate"), ("b", 3, "conflict")
    ]


def test_source_order(spark):
    df = spark.createDataFrame([("10", "9", None, None), ("9", "10", None, None), ("b", "a", 2, 1), ("b", "a", None, None), ("1", None, None, None)], "v string, c string, u int, w int")
    assert [r[0] for r in df.select(ingest.source_order_reason(F.col("v"), F.col("u"), F.col("c"), F.col("w"))).collect()] == [None, "source-order", None, "source-order", None]


def test_journal_audit_and_stages(spark):
    rows = [("s", 1, "e1", 10, "capture.started", "observing", None), ("s", 2, "e2", 9, "report.created", "observing", "e1"), ("s", 4, "e2", 12, "capture.error", "error", "e9")]
    df = spark.createDataFrame(rows, "session string, sequence int, id string, at int, type string, stage string, cause string")
    found = {r.sequence: r.problems for r in journal.sequence_audit(df, "session", "sequence", "id", "at", "cause").collect()}
    assert found == {1: [], 2: ["timestamp-regressed"], 4: ["sequence-not-contiguous", "duplicate-event-id", "cause-not-earlier"]}
    assert [r.sequence for r in journal.disallowed(df, "type", "stage", journal.allowed_stages(spark)).collect()] == [2]


def test_rules_and_claims(spark):
    times = spark.createDataFrame([(1, 1, "instant"), (1, 2, "instant"), (2, 1, "day"), (None, None, "unknown"), (1, 1, "unknown")], "a int, b int, p string")
    assert [r[0] for r in times.select(provenance.effective_time_rules(F.col("a"), F.col("b"), F.col("p"))).collect()] == [[], ["instant-with-range"], ["bounds-reversed"], [], ["unknown-with-bounds"]]
    claims = spark.createDataFrame([("m", 2, 15, 25), ("n", 1, 99, 5)], "k string, window_count int, claimed_duration int, claimed_span int")
    refs = spark.createDataFrame([("m", "a"), ("m", "b"), ("n", "a"), ("n", "a")], "k string, w string")
    windows = spark.createDataFrame([("a", 0, 10), ("b", 20, 30)], "w string, s int, e int")
    assert {r.k: r.violations for r in provenance.window_claims(claims, refs, windows, ["k"], "w", "s", "e").collect()} == {"m": [], "n": ["repeated-window", "duration-exceeds-windows"]}


def test_registry_completion(spark):
    present, owners = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "o string, c string"), spark.createDataFrame([("a",), ("b",)], "o string")
    registry = spark.createDataFrame([("x",), ("y",)], "c string")
    assert {(r.o, r.c): r.problem for r in governance.completed(present, owners, registry, ["o"], "c").collect()} == {
        ("a", "x"): "repeated", ("a", "y"): "missing", ("b", "x"): "missing", ("b", "y"): None
    }


# sources, sinks, streams


def test_private_names_are_found_in_any_depth(spark):
    df = spark.createDataFrame([(1, [((0.1,),)])], "id int, a array<struct<mouthCorners: struct<x: double>>>")
    assert schemas.private_columns(df.schema) == ["a.mouthCorners"]
    with pytest.raises(ValueError):
        schemas.assert_no_private_columns(df)


def test_append_once(spark, tmp_path):
    df = spark.createDataFrame([("e", 1, "k"), ("e", 1, "k"), ("e", 2, "k")], "episode string, revision int, kind string")
    path = str(tmp_path / "log")
    assert [schemas.append_once(df, path, ["episode", "revision"], ["kind"]) for _ in range(2)] == [2, 0]
    assert spark.read.parquet(path).count() == 2


# cycles, streams


def test_a_tied_chain_of_thousands_is_followed(spark):
    rows = [("t", "long", k, k - 1 if k else None, 1) for k in range(5000)] + [("t", "round", 10_000 + k, 10_000 + (k + 1) % 700, 1) for k in range(700)] + [("t", "round", 20_000, None, 1)]
    found = {r.id: (r.leaf, r.problems) for r in history.chain_audit(
        spark.createDataFrame(rows, "scope string, id string, rev long, prev long, at int"), ["scope"], "id", "rev", "prev", "at"
    ).collect()}
    assert found["long"] == (4999, []) and found["round"] == (None, ["revision-cycle"])


def test_updates_of_several_batches_are_merged(spark, tmp_path):
    rows = [[(1, 1.0), (2, 1.0)], [(1, 5.0)], [(3, 2.0)]]
    for part in rows:
        spark.createDataFrame(part, "k long, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).groupBy("k").agg(F.sum("v").alias("v"))
    found = flows.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "check"), mode="update", keys=["k"])
    assert sorted(map(tuple, found.collect())) == [(1, 6.0), (2, 1.0), (3, 2.0)]


def test_runs_are_published_only_if_current(spark, tmp_path):
    runs = spark.createDataFrame([("e", 1, "a"), ("e", 2, "b"), ("f", 1, "c")], "episode_id string, input_revision int, result string")
    now = spark.createDataFrame([("e", 2), ("f", 1)], "episode_id string, revision int")
    assert schemas.publish_runs(runs, str(tmp_path / "runs"), "1", now) == 2 and schemas.publish_runs(runs, str(tmp_path / "runs"), "1", now) == 0
    assert sorted(r.result for r in spark.read.parquet(str(tmp_path / "runs")).collect()) == ["b", "c"]


def test_json_events_are_read_with_their_schema(spark, tmp_path):
    (tmp_path / "events.jsonl").write_text('{"event_id": "a", "sequence": 1, "type": "measurement.recorded", "payload": {"metric_code": "m"}, "unknown": 1}\n{"event_id": "b", "sequence": 2}\n')
    rows = schemas.read(spark, str(tmp_path), schemas.WORKFLOW_EVENTS, "json").orderBy("event_id").collect()
    assert [(r.event_id, r.sequence, r.payload and r.payload.metric_code) for r in rows] == [("a", 1, "m"), ("b", 2, None)]


def test_frame_files_are_read_with_nan_as_null(spark, tmp_path):
    for ddl, row in ((schemas.VOICE_FRAMES, voice_frame(rms=float("nan"))), (schemas.FACE_FRAMES, face_frame(mouth_aperture_ratio=float("nan")))):
        spark.createDataFrame([row], ddl).write.mode("overwrite").parquet(str(tmp_path / "frames"))
        read = schemas.read(spark, str(tmp_path / "frames"), ddl)
        assert read.first()["rms" if "rms" in read.columns else "mouth_aperture_ratio"] is None and read.count() == 1
