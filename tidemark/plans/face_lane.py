"""Queries over facial frames that events make up: gates, bins, metrics, blinks, expressions, hysteresis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detect, face, governance, robust
from ..sources import registry
from .catalog import query, table
from .signals import events

#: Frames to a session, and milliseconds from one to the next.
FRAMES, STEP = 2400, 40


def face_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame for each event: its place by event_id, its measures from event_id and value. Every gate fails somewhere."""
    e, k = F.col("event_id"), F.col("event_id") % FRAMES
    session = F.expr(f"event_id div {FRAMES}")
    wave = F.floor("value") % 10 / 100.0
    pair = lambda a, b: F.struct(a.alias("left"), b.alias("right"))
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    shut = (e % 60 < 3) | (e % 1777 < 25) | (e % 311 == 0)
    eye = F.when(shut, 0.05).otherwise(0.3 + wave / 10)
    smile = F.expr("event_id div 200")
    rise = F.when(e % 200 < 20, 0.05 + (smile % 5) / 100.0).otherwise(0.0)
    size = F.when(e % 557 == 0, 1.4).when((F.expr("event_id div 125") % 11 == 5) & (e % 125 < 60), 1.18).otherwise(1.0)
    pose = F.struct(
        F.when(e % 389 < 2, 20.0).otherwise(F.floor("value") % 9 - 4.0).alias("yaw_degrees"), F.when(e % 401 == 0, 40.0).otherwise(7.0 + F.floor("value") % 5).alias("pitch_degrees"), F.when(e % 433 == 0, 9.0).otherwise(0.5).alias("roll_degrees")
    )
    brow = pair(0.55 + wave, F.lit(0.55))
    return table(spark, sf_dir, "events").select(
        session.cast("string").alias("session_id"), (k * float(STEP)).alias("t_ms"), (k * float(STEP)).alias("acquired_at_ms"), k.alias("sequence"), F.when((session % 4 == 2) & (k >= 1200), 2).otherwise(1).cast("long").alias("capture_epoch"),
        F.when(e % 701 == 0, "other").otherwise("ambient-frontal").alias("task_context"), F.lit("face@1").alias("processor_ref"), F.when(e % 509 == 0, "").otherwise("track-1").alias("track_segment_id"), F.when(e % 997 == 0, 2).otherwise(1).alias("face_count"), F.lit(True).alias("face_visible"),
        F.struct(
            F.lit(0.35).alias("x"), F.lit(0.2).alias("y"), F.lit(0.3).alias("width"), F.lit(0.5).alias("height"), (384.0 * size).alias("width_pixels"),
            (360.0 * size).alias("height_pixels"), F.lit(0.1).alias("edge_margin_fraction")
        ).alias("bounding_box"),
        F.when(e % 653 != 0, pose).alias("pose"), pair(eye, F.when(e % 120 < 3, 0.05).otherwise(0.29 + wave / 10)).alias("eye_aperture"), F.when(e % 53 != 0, brow).alias("brow_height"),
        *[F.lit(None).cast("struct<left: double, right: double>").alias(c) for c in ("fissure_width", "fissure_height", "iris_diameter")],
        pair(
            point(F.lit(0.3), 0.1 - rise), point(F.lit(-0.3), 0.102 - rise * (0.4 + (smile % 3) / 10.0))
        ).alias("mouth_corners"), F.lit(None).cast("struct<left: struct<x: double, y: double>, right: struct<x: double, y: double>>").alias("gaze_offset"),
        F.when(e % 601 != 0, 0.08 + wave).alias("mouth_aperture_ratio"), F.lit(None).cast("double").alias("mouth_midline_offset"), F.when(e % 59 != 0, 0.02 + wave / 10).alias("regional_movement_speed"), F.when(k == 0, None).otherwise(float(STEP)).alias("inter_result_gap_ms"),
        F.struct(
            F.lit(0.55).alias("illumination_mean"), F.lit(0.02).alias("dark_clipping_fraction"), F.lit(0.02).alias("bright_clipping_fraction"),
            F.when((e % 83 == 0) | (e % 1543 < 8), 0.0001).otherwise(0.002).alias("sharpness")
        ).alias("image_quality"),
        F.lit(30.0).alias("analyzed_frame_rate"), F.lit(0.0).alias("skipped_frame_fraction"), F.lit(8.0).alias("processing_latency_ms"), F.array().cast("array<string>").alias("quality_reasons"),
    )


def face_sessions(frames: DataFrame) -> DataFrame:
    """The sessions of the frames; each fourth one is not calibrated."""
    calibration = F.struct(
        F.when(F.col("session_id").cast("int") % 4 == 3, 900.0).otherwise(2000.0).alias("duration_ms"), F.lit(384.0).alias("baseline_box_width_pixels"),
        F.lit(360.0).alias("baseline_box_height_pixels")
    )
    return frames.select("session_id").distinct().select("session_id", F.lit(0.0).alias("session_started_at_ms"), calibration.alias("face_calibration"))


_E, _K, _S, _W = "event_id", f"(event_id % {FRAMES})", f"(event_id // {FRAMES})", "(floor(value) % 10 / 100.0)"
FACE_SQL = f"""f0 AS (SELECT CAST({_S} AS VARCHAR) AS session_id, {_K} * {STEP}.0::DOUBLE AS t, {_K} AS k, CAST({_K} // {5000 // STEP} AS INT) AS bin, {_E} % 701 = 0 AS other, CASE WHEN {_S} % 4 = 2 AND {_K} >= 1200 THEN 2 ELSE 1 END AS epoch,
  CASE WHEN {_E} % 653 <> 0 THEN CASE WHEN {_E} % 389 < 2 THEN 20.0 ELSE floor(value) % 9 - 4.0 END END AS yaw, CASE WHEN {_E} % 653 <> 0 THEN CASE WHEN {_E} % 401 = 0 THEN 40.0 ELSE 7.0 + floor(value) % 5 END END AS pitch,
  CASE WHEN {_E} % 653 <> 0 THEN CASE WHEN {_E} % 433 = 0 THEN 9.0 ELSE 0.5 END END AS roll, {_E} % 997 = 0 AS two, {_E} % 509 = 0 AS untracked, {_E} % 83 = 0 OR {_E} % 1543 < 8 AS blurred, {_E} % 653 = 0 AS poseless, {_E} % 601 = 0 AS incomplete, {_E} % 557 = 0 AS off_scale,
  CASE WHEN {_E} % 557 = 0 THEN 1.4 WHEN ({_E} // 125) % 11 = 5 AND {_E} % 125 < 60 THEN 1.18 ELSE 1.0 END * sqrt(384.0 * 360.0) AS size,
  CASE WHEN {_E} % 60 < 3 OR {_E} % 1777 < 25 OR {_E} % 311 = 0 THEN 0.05 ELSE 0.3 + {_W} / 10 END AS eye_left, CASE WHEN {_E} % 120 < 3 THEN 0.05 ELSE 0.29 + {_W} / 10 END AS eye_right,
  CASE WHEN {_E} % 53 <> 0 THEN 0.55 + {_W} END AS brow_left, CASE WHEN {_E} % 53 <> 0 THEN 0.55 END AS brow_right, CASE WHEN {_E} % 601 <> 0 THEN 0.08 + {_W} END AS mouth, CASE WHEN {_E} % 59 <> 0 AND {_K} > 0 THEN 0.02 + {_W} / 10 END AS speed,
  CASE WHEN {_E} % 200 < 20 THEN 0.05 + ({_E} // 200 % 5) / 100.0 ELSE 0.0 END AS rise, 0.4 + ({_E} // 200 % 3) / 10.0 AS part FROM events),
f AS (SELECT *, 0.1 - rise AS left_y, 0.102 - rise * part AS right_y, sqrt(0.36 + power(0.1 - rise - (0.102 - rise * part), 2)) AS mouth_width, abs(0.1 - rise - (0.102 - rise * part)) AS corners FROM f0 WHERE NOT other),
rp AS (SELECT session_id, quantile_cont(yaw, 0.5) AS ry, quantile_cont(pitch, 0.5) AS rpi, quantile_cont(roll, 0.5) AS rr FROM f WHERE NOT (two OR untracked OR blurred OR poseless OR incomplete) GROUP BY session_id),
gf AS (SELECT f.*, ry, rpi, rr, blurred OR poseless AS bad_image, abs(yaw - ry) > 7 AS off_yaw, abs(pitch - rpi) > 10 AS off_pitch, abs(roll - rr) > 5 AS off_roll FROM f LEFT JOIN rp USING (session_id)),
gu AS (SELECT *, NOT (two OR untracked OR bad_image OR poseless OR off_yaw OR off_pitch OR off_roll OR off_scale OR incomplete) AS usable FROM gf)"""


@query(
    "face_gate_failures",
    f"""WITH {FACE_SQL}, r AS (SELECT session_id, unnest(list_filter([CASE WHEN two THEN 'face-count' END, CASE WHEN untracked THEN 'no-track-id' END, CASE WHEN bad_image THEN 'image-quality' END, CASE WHEN poseless THEN 'no-pose' END, CASE WHEN off_yaw THEN 'yaw' END,
  CASE WHEN off_pitch THEN 'pitch' END, CASE WHEN off_roll THEN 'roll' END, CASE WHEN off_scale THEN 'face-scale' END, CASE WHEN incomplete THEN 'incomplete-geometry' END], lambda x: x IS NOT NULL)) AS reason FROM gf)
SELECT session_id, reason, count(*) AS frames FROM r GROUP BY session_id, reason""",
)
def face_gate_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = face_frames(spark, sf_dir)
    return face.gate_failure_counts(frames, face_sessions(frames))


@query(
    "face_resting_pose",
    f"WITH {FACE_SQL}, a AS (SELECT DISTINCT session_id FROM f0) SELECT session_id, round(ry, 6) AS yaw, round(rpi, 6) AS pitch, rr AS roll FROM a LEFT JOIN rp USING (session_id)"
)
def face_resting_pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("resting")
    return face.resting_pose(face_frames(spark, sf_dir)).select("session_id", F.round(r["yaw_degrees"], 6).alias("yaw"), F.round(r["pitch_degrees"], 6).alias("pitch"), r["roll_degrees"].alias("roll"))


def bins_sql(frames: str, keys: str, out: str) -> str:
    """Bins of usable frames with their statistics and the first reason that fails them."""
    return f"""{out}_g AS (SELECT *, t - lag(t) OVER (PARTITION BY {keys} ORDER BY t) AS gap FROM {frames}),
{out}_q AS (SELECT {keys}, count(*) AS frames, max(t) - min(t) AS span_ms, coalesce(quantile_cont(gap, 0.5) FILTER (WHERE gap > 0 AND gap <= 200), 1000 / 30.0) AS step_ms, max(gap) AS largest, count(DISTINCT epoch) AS epochs, min(epoch) AS epoch,
  quantile_cont(size, 0.1) AS size_p10, quantile_cont(size, 0.9) AS size_p90 FROM {out}_g GROUP BY {keys}),
{out}_z AS (SELECT *, least(5000.0, round(frames * step_ms, 3)) AS data_ms FROM {out}_q),
{out} AS (SELECT *, frames / (data_ms / 1000) AS cadence, CASE WHEN frames < 80 THEN 'too-few-usable-frames' WHEN epochs <> 1 THEN 'mixed-provenance' WHEN largest > 200 THEN 'frame-gap' WHEN span_ms < 4800 OR data_ms < 4000 THEN 'short-bin' WHEN size_p90 / size_p10 > 1.15 THEN 'scale-drift' END AS reason FROM {out}_z)"""


BINS_SQL = f"{FACE_SQL}, us AS (SELECT * FROM gu WHERE usable), {bins_sql('us', 'session_id, bin', 'br')}"


@query("face_bins", f"WITH {BINS_SQL} SELECT session_id, bin, frames, span_ms, round(step_ms, 4) AS step_ms, round(data_ms, 3) AS data_ms, reason FROM br")
def face_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = face_frames(spark, sf_dir)
    usable = face.gated(frames, face_sessions(frames)).filter("usable")
    return face.qualify(usable, ["session_id", "bin"]).select("session_id", "bin", "frames", "span_ms", F.round("step_ms", 4).alias("step_ms"), F.round("data_ms", 3).alias("data_ms"), "reason")


@query(
    "face_eye_bins",
    f"""WITH {BINS_SQL}, k AS (SELECT us.session_id, us.bin, us.t, eye_left, step_ms FROM us JOIN br USING (session_id, bin) WHERE reason IS NULL),
kw AS (SELECT *, coalesce(lead(t) OVER (PARTITION BY session_id, bin ORDER BY t) - t, step_ms) AS weight FROM k),
kc AS (SELECT *, sum(weight) OVER (PARTITION BY session_id, bin ORDER BY eye_left, t ROWS UNBOUNDED PRECEDING) AS running, sum(weight) OVER (PARTITION BY session_id, bin) AS whole FROM kw)
SELECT session_id, bin, round(min(eye_left) FILTER (WHERE running >= 0.9 * whole), 6) AS eye_left_p90, min(eye_left) AS eye_left_least FROM kc GROUP BY session_id, bin""",
)
def face_eye_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = face_frames(spark, sf_dir)
    _, kept = face.accepted_frames(frames, face_sessions(frames))
    return face.bin_values(kept, ["session_id", "bin"], ("eye_left",)).select("session_id", "bin", F.round("bin_value", 6).alias("eye_left_p90"), F.col("least").alias("eye_left_least"))


def blinks_sql(frames: str, key: str, out: str) -> str:
    """Blinks of both eyes. In these frames every closure's end comes long before the next closure, so no refractory time and no suppression binds."""
    sides = " UNION ALL ".join(f"SELECT {key}, t, bin, '{side}' AS side, eye_{side} AS a FROM {frames}" for side in ("left", "right"))
    own = f"PARTITION BY {key}, side"
    return f"""{out}_l AS ({sides}), {out}_r AS (SELECT *, quantile_cont(a, 0.9) OVER ({own}) AS ref, t - lag(t) OVER w AS step, bin - lag(bin) OVER w AS ahead FROM {out}_l WINDOW w AS ({own} ORDER BY t)),
{out}_i AS (SELECT *, a <= 0.6 * ref AS shut, a >= 0.8 * ref AS open, sum(CASE WHEN step > 75 OR ahead NOT IN (0, 1) THEN 1 ELSE 0 END) OVER ({own} ORDER BY t ROWS UNBOUNDED PRECEDING) AS island FROM {out}_r),
{out}_o AS (SELECT *, sum(open::INT) OVER ({own}, island ORDER BY t ROWS UNBOUNDED PRECEDING) AS opened FROM {out}_i),
{out}_c AS (SELECT {key}, side, island, opened, min(t) FILTER (WHERE shut) AS start, min(bin) FILTER (WHERE shut) AS start_bin, max(t) FILTER (WHERE open) AS seen_open, min(a) FILTER (WHERE NOT open) AS low, min_by(t, a) FILTER (WHERE NOT open) AS low_t,
  count(*) FILTER (WHERE NOT open) AS n, coalesce(sum(step) FILTER (WHERE shut), 0) AS shut_ms, arg_min(coalesce(step, 0), t) FILTER (WHERE shut) AS first_step, any_value(ref) AS ref FROM {out}_o GROUP BY ALL),
{out}_e AS (SELECT {key}, side, island, opened - 1 AS opened, t AS offset_ms FROM {out}_o WHERE open),
{out} AS (SELECT c.*, offset_ms, coalesce(seen_open, start) AS onset_ms FROM {out}_c c JOIN {out}_e e USING ({key}, side, island, opened) WHERE start IS NOT NULL AND offset_ms - start BETWEEN 50 AND 800)"""


_BLINK_COLUMNS = """start_bin AS bin, onset_ms, low_t AS peak_ms, offset_ms, round(low, 6) AS lid_minimum, round((ref - low) / ref, 6) AS depth, round(CASE WHEN low_t > onset_ms THEN (ref - low) / (low_t - onset_ms) * 1000 ELSE 0 END, 5) AS closing_velocity,
round((ref - low) / (offset_ms - low_t) * 1000, 5) AS opening_velocity, shut_ms - coalesce(first_step, 0) AS closed_dwell_ms, n + 1 AS frame_count"""
STREAMS_SQL = f"""{FACE_SQL}, ev AS (SELECT * FROM gf WHERE NOT (two OR untracked OR bad_image OR incomplete)),
st AS (SELECT * REPLACE (CAST(stream_no AS BIGINT) AS stream_no) FROM (SELECT *, 1 + sum(CASE WHEN epoch <> before THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS stream_no FROM (SELECT *, lag(epoch) OVER (PARTITION BY session_id ORDER BY t) AS before FROM ev)))"""
STREAM = ["session_id", "stream_no"]


def streams_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = face_frames(spark, sf_dir)
    return face.event_streams(frames, face_sessions(frames))


def _blinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return face.blinks(streams_of(spark, sf_dir), STREAM)


@query("face_blinks", f"WITH {STREAMS_SQL}, {blinks_sql('st', 'session_id, stream_no', 'bl')} SELECT session_id, stream_no, side, {_BLINK_COLUMNS} FROM bl")
def face_blinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lambda c, n: F.round(c, n).alias(c)
    return _blinks(spark, sf_dir).select(
        *STREAM, "side", "bin", "onset_ms", "peak_ms", "offset_ms", r("lid_minimum", 6), r("depth", 6), r("closing_velocity", 5), r("opening_velocity", 5),
        "closed_dwell_ms", F.col("frame_count").cast("long").alias("frame_count")
    )


def pairs_sql(blinks: str, key: str, out: str) -> str:
    """Each left blink with the first right one that overlaps it; in these frames no right blink overlaps two left ones."""
    return f"""{out} AS (SELECT {", ".join(f"l.{k.strip()}" for k in key.split(","))}, l.start_bin AS bin, l.low_t AS left_peak_ms, min(r.low_t) AS right_peak_ms FROM {blinks} l JOIN {blinks} r USING ({key}) WHERE l.side = 'left' AND r.side = 'right' AND r.onset_ms <= l.offset_ms AND l.onset_ms <= r.offset_ms GROUP BY ALL)"""


@query("face_bilateral_blinks", f"WITH {STREAMS_SQL}, {blinks_sql('st', 'session_id, stream_no', 'bl')}, {pairs_sql('bl', 'session_id, stream_no', 'pr')} SELECT * FROM pr")
def face_bilateral_blinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return face.bilateral_blinks(_blinks(spark, sf_dir), STREAM)


@query(
    "face_blink_poses",
    f"""WITH {STREAMS_SQL}, {blinks_sql('st', 'session_id, stream_no', 'bl')}, sp AS (SELECT session_id, stream_no, side, onset_ms, max((off_yaw OR off_pitch OR off_roll)::INT) AS off FROM bl JOIN gf USING (session_id) WHERE gf.t BETWEEN onset_ms AND offset_ms GROUP BY ALL)
SELECT session_id, stream_no, side, onset_ms, coalesce(off = 0, false) AS pose_within_limits FROM bl LEFT JOIN sp USING (session_id, stream_no, side, onset_ms)""",
)
def face_blink_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = face_frames(spark, sf_dir)
    found = face.within_pose(_blinks(spark, sf_dir), face.gated(frames, face_sessions(frames)), "onset_ms", "offset_ms", [*STREAM, "side", "onset_ms"])
    return found.select(*STREAM, "side", "onset_ms", "pose_within_limits")


def expressions_sql(frames: str, key: str, out: str) -> str:
    """Expression events with what the metrics use. In these frames a corner's rise is either none or above the upper threshold, and short."""
    own = f"PARTITION BY {key}"
    return f"""{out}_m AS (SELECT *, quantile_cont(left_y, 0.5) OVER ({own}) AS rl, quantile_cont(right_y, 0.5) OVER ({own}) AS rr2, quantile_cont(eye_left, 0.5) OVER ({own}) AS el, quantile_cont(eye_right, 0.5) OVER ({own}) AS er, t - lag(t) OVER ({own} ORDER BY t) AS step, lead(t) OVER ({own} ORDER BY t) - t AS ahead FROM {frames}),
{out}_d AS (SELECT *, greatest(0, rl - left_y) AS up_l, greatest(0, rr2 - right_y) AS up_r FROM {out}_m), {out}_x AS (SELECT *, greatest(up_l, up_r) AS drive FROM {out}_d),
{out}_b AS (SELECT *, drive >= 0.04 AS raised, lag(drive >= 0.04) OVER w AS was FROM {out}_x WINDOW w AS ({own} ORDER BY t)),
{out}_i AS (SELECT *, sum(CASE WHEN NOT raised OR NOT coalesce(was, false) OR step > 200 THEN 1 ELSE 0 END) OVER ({own} ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM {out}_b),
{out}_p AS (SELECT {key}, run, min(t) AS start_ms, max(t) AS end_ms, arg_max(ahead, t) AS after, count(*) AS frame_count, max(drive) AS top, min_by(t, -drive) AS peak_ms, min_by(up_l, -drive) AS peak_left, min_by(up_r, -drive) AS peak_right,
  min_by(eye_left - el, -drive) AS lid_left, min_by(eye_right - er, -drive) AS lid_right FROM {out}_i WHERE raised GROUP BY ALL),
{out} AS (SELECT *, (peak_left - peak_right) / (peak_left + peak_right) AS asymmetry, CASE WHEN peak_left >= 0.02 AND peak_right >= 0.02 THEN lid_left / peak_left - lid_right / peak_right END AS coupling FROM {out}_p WHERE end_ms - start_ms >= 300 AND (after IS NULL OR after <= 200))"""


@query(
    "face_expressions",
    f"WITH {STREAMS_SQL}, {expressions_sql('st', 'session_id, stream_no', 'ex')} SELECT session_id, stream_no, start_ms, end_ms, peak_ms, frame_count, round(peak_left, 6) AS peak_left, round(peak_right, 6) AS peak_right, peak_ms - start_ms AS rise_ms, round(lid_left, 6) AS lid_delta_left, round(lid_right, 6) AS lid_delta_right FROM ex"
)
def face_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lambda c: F.round(c, 6).alias(c)
    found = face.expressions(streams_of(spark, sf_dir), STREAM)
    return found.select(
        *STREAM, "start_ms", "end_ms", "peak_ms", F.col("frame_count").cast("long").alias("frame_count"), r("peak_left"), r("peak_right"), "rise_ms",
        r("lid_delta_left"), r("lid_delta_right")
    )


@query(
    "face_expression_summary",
    f"""WITH {STREAMS_SQL}, {expressions_sql('st', 'session_id, stream_no', 'ex')}, g AS (SELECT session_id, count(*) AS events, quantile_cont(greatest(peak_left, peak_right), 0.9) AS p90, quantile_cont(asymmetry, 0.5) AS asymmetry, count(coupling) AS couplings, quantile_cont(coupling, 0.5) AS coupling FROM ex GROUP BY session_id),
x AS (SELECT session_id, count(*) * {STEP}.0 AS eligible_ms FROM st GROUP BY session_id)
SELECT session_id, coalesce(events, 0) AS events, round(coalesce(events, 0) / (eligible_ms / 60000), 6) AS rate, CASE WHEN events >= 3 THEN round(p90, 6) END AS excursion_p90, CASE WHEN events >= 3 THEN round(asymmetry, 6) END AS asymmetry, CASE WHEN couplings >= 3 THEN round(coupling, 6) END AS coupling
FROM x LEFT JOIN g USING (session_id)""",
)
def face_expression_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    streams = streams_of(spark, sf_dir)
    found = face.expression_summary(face.expressions(streams, STREAM), streams.groupBy("session_id").agg((F.count("*") * float(STEP)).alias("eligible_ms")))
    return found.select("session_id", "events", *[F.round(c, 6).alias(c) for c in ("rate", "excursion_p90", "asymmetry", "coupling")])


_TIMED = " UNION ALL ".join(
    f"SELECT session_id, variant, bin, t, step_ms, '{name}' AS name, CAST({value} AS DOUBLE) AS v, {share} AS share FROM vk WHERE variant = '{variant}'"
    for name, value, share, variant in [
        ("eye_left", "eye_left", 0.9, "base"), ("eye_right", "eye_right", 0.9, "base"), ("eye_asymmetry", "abs(eye_left - eye_right)", 0.5, "base"), ("mouth_width", "mouth_width", 0.5, "base"), ("mouth_median", "mouth", 0.5, "base"), ("mouth_p90", "mouth", 0.9, "base"),
        ("corner_asymmetry", "corners", 0.5, "base"), (
            "movement", "CASE WHEN t > first_t THEN speed END", 0.9, "movement"
        ), ("brow_left", "brow_left", 0.5, "brow_left"), ("brow_right", "brow_right", 0.5, "brow_right"), ("brow_asymmetry", "brow_left - brow_right", 0.5, "brow_asymmetry"),
    ]
)
_CODES = ", ".join(f"({k}, '{code}', '{kind}', '{name}', '{variant}')" for k, (code, kind, name, variant) in enumerate(face.METRICS))
METRICS_SQL = f"""{BINS_SQL}, bk AS (SELECT us.* FROM us JOIN br USING (session_id, bin) WHERE reason IS NULL),
vf AS (SELECT *, unnest(list_filter(['base', CASE WHEN speed IS NOT NULL THEN 'movement' END, CASE WHEN brow_left IS NOT NULL THEN 'brow_left' END, CASE WHEN brow_right IS NOT NULL THEN 'brow_right' END, CASE WHEN brow_left IS NOT NULL THEN 'brow_asymmetry' END], lambda x: x IS NOT NULL)) AS variant FROM bk),
{bins_sql('vf', 'session_id, variant, bin', 'vb')}, vk AS (SELECT vf.*, step_ms, min(t) OVER (PARTITION BY session_id, variant, bin) AS first_t FROM vf JOIN vb USING (session_id, variant, bin) WHERE reason IS NULL),
tv AS (SELECT * FROM ({_TIMED}) WHERE v IS NOT NULL), tw AS (SELECT *, coalesce(lead(t) OVER (PARTITION BY session_id, variant, bin, name ORDER BY t) - t, step_ms) AS weight FROM tv),
tc AS (SELECT *, sum(weight) OVER (PARTITION BY session_id, variant, bin, name ORDER BY v, t ROWS UNBOUNDED PRECEDING) AS running, sum(weight) OVER (PARTITION BY session_id, variant, bin, name) AS whole FROM tw),
bv AS (SELECT session_id, variant, bin, name, min(v) FILTER (WHERE running >= share * whole) AS v, min(v) AS least FROM tc GROUP BY ALL),
ab AS (SELECT session_id, variant, bin, frames, data_ms, span_ms, cadence, largest, size_p10, size_p90, epoch FROM vb WHERE reason IS NULL UNION ALL
  SELECT b.session_id, replace(name, 'eye', 'lid'), b.bin, frames, data_ms, span_ms, cadence, largest, size_p10, size_p90, epoch FROM vb b JOIN bv ON bv.session_id = b.session_id AND bv.bin = b.bin AND bv.variant = 'base' WHERE b.variant = 'base' AND b.reason IS NULL AND name IN ('eye_left', 'eye_right') AND v > 0),
af AS (SELECT ab.variant, f.session_id, f.bin, f.t, f.yaw, f.pitch, f.roll, f.ry, f.rpi, f.rr FROM ab JOIN vk f ON f.session_id = ab.session_id AND f.bin = ab.bin AND f.variant = CASE WHEN ab.variant LIKE 'lid%' THEN 'base' ELSE ab.variant END),
fp AS (SELECT session_id, variant, quantile_cont(gap, 0.95) AS p95_gap_ms, quantile_cont(greatest(0, least(1, 1 - greatest(abs(yaw - ry) / 7, abs(pitch - rpi) / 10, abs(roll - rr) / 5))), 0.5) AS frontal FROM (SELECT *, t - lag(t) OVER (PARTITION BY session_id, variant, bin ORDER BY t) AS gap FROM af) GROUP BY ALL),
pf AS (SELECT session_id, variant, count(*) AS bins, sum(data_ms) AS eligible_ms, CAST(sum(frames) AS BIGINT) AS samples, count(DISTINCT epoch) AS segments, (max(bin) - min(bin) + 1) * 5000.0 AS span_ms, min(cadence) AS least_cadence_hz, min(span_ms) AS least_span_ms, max(largest) AS largest_gap_ms,
  0.3 * greatest(0, least(1, quantile_cont(cadence, 0.5) / 30)) + 0.3 * greatest(0, least(1, quantile_cont(data_ms / 5000, 0.5))) + 0.2 * quantile_cont(greatest(0, least(1, 1 - (size_p90 / size_p10 - 1) / 0.15)), 0.5) AS q3,
  string_agg('face:' || epoch || ':track-1:' || bin * 5000 || ':' || (bin + 1) * 5000, ',' ORDER BY bin) AS window_refs FROM ab GROUP BY session_id, variant),
pr0 AS (SELECT *, q3 + 0.2 * frontal AS quality FROM pf JOIN fp USING (session_id, variant)),
bm AS (SELECT session_id, name, m AS value, CASE WHEN count(*) >= 2 THEN quantile_cont(abs(v - m), 0.5) END AS dispersion FROM (SELECT *, quantile_cont(v, 0.5) OVER (PARTITION BY session_id, name) AS m FROM bv) GROUP BY ALL),
lc AS (SELECT session_id, replace(name, 'eye', 'closure') AS name, greatest(0, least(1, 1 - quantile_cont(least, 0.25) / quantile_cont(v, 0.5))) AS value, NULL::DOUBLE AS dispersion FROM bv WHERE variant = 'base' AND name IN ('eye_left', 'eye_right') AND v > 0 GROUP BY ALL),
bb AS (SELECT * FROM vk WHERE variant = 'base'), {blinks_sql('bb', 'session_id', 'kb')}, {pairs_sql('kb', 'session_id', 'kp')},
kr AS (SELECT b.session_id, b.bin, data_ms, coalesce(n, 0) AS n FROM ab b LEFT JOIN (SELECT session_id, bin, count(*) AS n FROM kp GROUP BY ALL) p ON p.session_id = b.session_id AND p.bin = b.bin WHERE b.variant = 'base'),
kv AS (SELECT session_id, 'blink_rate' AS name, sum(n) / (sum(data_ms) / 60000) AS value, CASE WHEN count(*) >= 2 THEN quantile_cont(abs(n * 12.0 - m), 0.5) END AS dispersion, CAST(sum(n) AS BIGINT) AS blinks FROM (SELECT *, quantile_cont(n * 12.0, 0.5) OVER (PARTITION BY session_id) AS m FROM kr) GROUP BY session_id),
{expressions_sql('bb', 'session_id', 'xe')},
xs AS (SELECT session_id, count(*) AS events, count(coupling) AS couplings, quantile_cont(greatest(peak_left, peak_right), 0.9) AS p90, any_value(ma) AS ma, any_value(mc) AS mc, CASE WHEN count(asymmetry) >= 2 THEN quantile_cont(abs(asymmetry - ma), 0.5) END AS da, CASE WHEN count(coupling) >= 2 THEN quantile_cont(abs(coupling - mc), 0.5) END AS dc
  FROM (SELECT *, quantile_cont(asymmetry, 0.5) OVER (PARTITION BY session_id) AS ma, quantile_cont(coupling, 0.5) OVER (PARTITION BY session_id) AS mc FROM xe) GROUP BY session_id),
xr AS (SELECT session_id, quantile_cont(right_y, 0.5) - quantile_cont(left_y, 0.5) AS rc, quantile_cont(eye_left, 0.5) - quantile_cont(eye_right, 0.5) AS re FROM bb GROUP BY session_id),
xv AS (SELECT xr.session_id, coalesce(events, 0) AS events, coalesce(couplings, 0) AS couplings, unnest([{{'name': 'rest_corner', 'v': rc, 'd': NULL::DOUBLE}}, {{'name': 'rest_eye', 'v': re, 'd': NULL}}, {{'name': 'event_rate', 'v': coalesce(events, 0) / (eligible_ms / 60000), 'd': NULL}}, {{'name': 'excursion_p90', 'v': p90, 'd': NULL}},
  {{'name': 'excursion_asymmetry', 'v': ma, 'd': da}}, {{'name': 'coupling', 'v': mc, 'd': dc}}]) AS x FROM xr JOIN pr0 ON pr0.session_id = xr.session_id AND variant = 'base' LEFT JOIN xs ON xs.session_id = xr.session_id),
fo AS (SELECT session_id, name, value, dispersion, NULL::BIGINT AS blinks, NULL::BIGINT AS events, NULL::BIGINT AS couplings FROM bm UNION ALL SELECT *, NULL, NULL, NULL FROM lc UNION ALL SELECT *, NULL, NULL FROM kv UNION ALL SELECT session_id, x.name, x.v, x.d, NULL, events, couplings FROM xv),
wh AS (SELECT session_id, count(*) AS base_bins, count(DISTINCT epoch) AS tracks, max(bin) - min(bin) + 1 AS base_span FROM ab WHERE variant = 'base' GROUP BY session_id),
sv AS (SELECT session_id, sum(two::INT) AS several, min(t) AS t0, max(t) AS t1 FROM f GROUP BY session_id), se AS (SELECT DISTINCT session_id FROM f0),
rg AS (SELECT * FROM (VALUES {_CODES}) AS r(metric_no, metric_code, kind, name, variant)),
jj AS (SELECT se.session_id, rg.*, several, t0, t1, base_bins, tracks, base_span, p.bins, p.samples, p.segments, p.eligible_ms, p.span_ms, p.least_cadence_hz, p.least_span_ms, p.p95_gap_ms, p.largest_gap_ms, p.window_refs, p.quality, fo.value, fo.dispersion, blinks, events, couplings
  FROM se CROSS JOIN rg LEFT JOIN sv USING (session_id) LEFT JOIN wh USING (session_id) LEFT JOIN pr0 p ON p.session_id = se.session_id AND p.variant = rg.variant LEFT JOIN fo ON fo.session_id = se.session_id AND fo.name = rg.name),
jr AS (SELECT *, CASE WHEN CAST(session_id AS INT) % 4 = 3 THEN 'quality-threshold-failed' WHEN base_bins IS NULL AND several > 0 THEN 'multiple-faces' WHEN base_bins IS NULL THEN 'no-usable-signal' WHEN tracks > 1 THEN 'quality-threshold-failed' WHEN base_bins < 3 THEN 'insufficient-bins' WHEN base_span < 6 THEN 'insufficient-duration'
  WHEN kind = 'bins' AND coalesce(bins, 0) < 3 THEN 'insufficient-bins' WHEN kind = 'bins' AND span_ms < 30000 THEN 'insufficient-duration' WHEN kind = 'blinks' AND eligible_ms < 60000 THEN 'insufficient-exposure' WHEN kind = 'blinks' AND least_cadence_hz < 24 THEN 'insufficient-frame-cadence' WHEN kind = 'blinks' AND p95_gap_ms > 75 THEN 'quality-threshold-failed'
  WHEN name IN ('excursion_p90', 'excursion_asymmetry', 'coupling') AND coalesce(events, 0) < 3 THEN 'insufficient-events' WHEN name = 'coupling' AND coalesce(couplings, 0) < 3 THEN 'insufficient-events' WHEN value IS NULL THEN 'no-usable-signal' END AS reason FROM jj)"""


@query(
    "face_metrics",
    f"""WITH {METRICS_SQL} SELECT session_id, metric_no, metric_code, CASE WHEN reason IS NULL THEN 'measured' ELSE 'withheld' END AS status, reason AS reason_code, CASE WHEN reason IS NULL THEN round(value, 6) END AS value, CASE WHEN reason IS NULL THEN round(dispersion, 6) END AS dispersion,
CASE WHEN reason IS NULL THEN round(quality, 6) END AS quality, coalesce(bins, 0) AS bins, coalesce(samples, 0) AS samples FROM jr""",
)
def face_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = face_frames(spark, sf_dir)
    r = lambda c: F.round(c, 6).alias(c)
    return face.metrics(frames, face_sessions(frames)).select("session_id", "metric_no", "metric_code", "status", "reason_code", r("value"), r("dispersion"), r("quality"), "bins", "samples")


@query(
    "face_registry_completion",
    f"""WITH {FACE_SQL}, c AS (SELECT * FROM (VALUES {_CODES}) AS r(metric_no, metric_code, kind, name, variant)), s AS (SELECT DISTINCT session_id FROM f0)
SELECT session_id, metric_code, CASE WHEN metric_no % 7 = 3 AND CAST(session_id AS INT) % 2 = 0 THEN 'missing' WHEN metric_no % 5 = 4 THEN 'repeated' END AS problem FROM s CROSS JOIN c""",
)
def face_registry_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcomes of each session against the registry, some of them taken out and some doubled."""
    frames = face_frames(spark, sf_dir)
    sessions = face_sessions(frames)
    found = face.metrics(frames, sessions).select("session_id", "metric_no", "metric_code")
    some = found.filter(~((F.col("metric_no") % 7 == 3) & (F.col("session_id").cast("int") % 2 == 0)))
    own = registry.metrics(spark).filter("modality = 'face'")
    return governance.completed(some.unionByName(some.filter("metric_no % 5 = 4")), sessions, own, ["session_id"], "metric_code").select("session_id", "metric_code", "problem")


@query(
    "face_evidence",
    f"""WITH {METRICS_SQL} SELECT session_id, metric_code, t0 AS observed_start_ms, t1 AS observed_end_ms, CAST(coalesce(segments, 0) AS BIGINT) AS segments, round(coalesce(eligible_ms, 0), 3) AS eligible_ms, coalesce(span_ms, 0) AS span_ms, round(least_cadence_hz, 6) AS least_cadence_hz, least_span_ms, p95_gap_ms, largest_gap_ms,
coalesce(window_refs, '') AS window_refs, CASE WHEN kind = 'blinks' THEN blinks END AS blink_count, CASE WHEN kind = 'expressions' THEN events END AS expression_count, CASE WHEN kind = 'expressions' THEN couplings END AS coupled_count FROM jr""",
)
def face_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = face_frames(spark, sf_dir)
    found = face.metrics(frames, face_sessions(frames))
    return found.select(
        "session_id", "metric_code", "observed_start_ms", "observed_end_ms", "segments", F.round("eligible_ms", 3).alias("eligible_ms"), "span_ms", F.round("least_cadence_hz", 6).alias("least_cadence_hz"), "least_span_ms", "p95_gap_ms", "largest_gap_ms",
        F.coalesce(F.array_join("window_refs", ","), F.lit("")).alias("window_refs"), "blink_count", "expression_count", "coupled_count",
    )


@query(
    "face_diagnostics",
    f"""WITH {BINS_SQL}, w AS (SELECT session_id, count(*) AS frames, CAST(sum(usable::INT) AS BIGINT) AS usable_frames, count(DISTINCT bin) AS bins_considered, quantile_cont(abs(yaw), 0.5) AS yaw_p50, quantile_cont(abs(yaw), 0.95) AS yaw_p95, quantile_cont(abs(pitch), 0.95) AS pitch_p95, quantile_cont(abs(roll), 0.5) AS roll_p50 FROM gu GROUP BY session_id),
j AS (SELECT b.session_id, b.bin, CASE WHEN br.frames IS NULL THEN 'too-few-usable-frames' ELSE reason END AS reason FROM (SELECT DISTINCT session_id, bin FROM gu) b LEFT JOIN br USING (session_id, bin)),
c AS (SELECT session_id, CAST(sum((reason IS NULL)::INT) AS BIGINT) AS bins_accepted FROM j GROUP BY session_id), rj AS (SELECT session_id, string_agg(reason || ':' || n, ',' ORDER BY reason) AS bin_rejections FROM (SELECT session_id, reason, count(*) AS n FROM j WHERE reason IS NOT NULL GROUP BY ALL) GROUP BY session_id)
SELECT w.*, bins_accepted, coalesce(bin_rejections, '') AS bin_rejections FROM w JOIN c USING (session_id) LEFT JOIN rj USING (session_id)""",
)
def face_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = face_frames(spark, sf_dir)
    told = F.array_join(F.transform("bin_rejections", lambda x: F.concat_ws(":", x["reason"], x["n"].cast("string"))), ",")
    return face.diagnostics(frames, face_sessions(frames)).select(
        "session_id", "frames", "usable_frames", "bins_considered", "yaw_p50", "yaw_p95", "pitch_p95", "roll_p50", "bins_accepted", told.alias("bin_rejections")
    )


@query(
    "face_acceptance_curve",
    f"""WITH {FACE_SQL}, u AS (SELECT *, CASE WHEN usable THEN t - lag(t) OVER (PARTITION BY session_id, bin, usable ORDER BY t) END AS gap FROM gu), s AS (SELECT session_id, bin, avg(usable::INT) AS share, sum(usable::INT) AS n, coalesce(max(gap), 0) AS gap, coalesce(max(t) FILTER (WHERE usable) - min(t) FILTER (WHERE usable), 0) AS span FROM u GROUP BY session_id, bin),
l AS (SELECT *, CASE WHEN n < 80 THEN 'samples' WHEN gap > 200 THEN 'gap' WHEN span < 4800 THEN 'span' ELSE 'bins' END AS lost FROM s), a AS (SELECT unnest([1.0, 0.98, 0.95, 0.9, 0.85, 0.8])::DOUBLE AS asked)
SELECT session_id, asked, {", ".join(f"CAST(sum((lost = '{x}' AND share >= asked)::INT) AS BIGINT) AS {n}" for x, n in (("bins", "bins"), ("samples", "lost_to_samples"), ("gap", "lost_to_gap"), ("span", "lost_to_span")))}, count(*) AS of_bins FROM l CROSS JOIN a GROUP BY session_id, asked""",
)
def face_acceptance_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = face_frames(spark, sf_dir)
    return face.acceptance_curve(frames, face_sessions(frames))


@query(
    "value_hysteresis",
    """WITH e AS (SELECT user_id, event_id, value, epoch_us(ts) AS us FROM events), d AS (SELECT *, CASE WHEN value >= 150 THEN 1 WHEN value < 80 THEN 0 END AS decided FROM e),
s AS (SELECT *, coalesce(last_value(decided IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING), 0) AS state FROM d)
SELECT user_id, CAST(sum(state) AS BIGINT) AS rows_on, count(*) AS n FROM s GROUP BY user_id""",
)
def value_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    state = detect.schmitt_state(F.col("value"), 150, 80, ["user_id"], ["us", "event_id"])
    return e.withColumn("state", state).groupBy("user_id").agg(F.sum("state").alias("rows_on"), F.count("*").alias("n"))


@query(
    "voice_nuclei",
    """WITH RECURSIVE f AS (SELECT event_id // 6000 AS s, event_id % 6000 AS k, CASE WHEN ((event_id % 6000) // 60) % 4 <> 3 THEN 0.02 + (event_id % 11) / 100.0 ELSE 0.002 + (event_id % 13) / 1000.0 END AS x FROM events),
r AS (SELECT s, k, x > 0.012 AS hit, 0.3 * x AS average, CASE WHEN x > 0.012 THEN k ELSE -1000 END AS last FROM f WHERE k = 0 UNION ALL
  SELECT f.s, f.k, x > greatest(0.012, 1.15 * average) AND f.k - last >= 10, 0.7 * average + 0.3 * x, CASE WHEN x > greatest(0.012, 1.15 * average) AND f.k - last >= 10 THEN f.k ELSE last END FROM r JOIN f ON f.s = r.s AND f.k = r.k + 1)
SELECT CAST(s AS VARCHAR) AS session_id, CAST(sum(hit::INT) AS BIGINT) AS nuclei, count(*) AS frames, quantile_cont(k * 10.0, 0.5) FILTER (WHERE hit) AS median_ms FROM r GROUP BY s""",
)
def voice_nuclei(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nuclei found by the fold over the levels of voice frames, beside those that the frames came with."""
    from .voice_lane import voice_frames

    found = detect.by_group(voice_frames(spark, sf_dir).select("session_id", "t_ms", "sequence", "rms"), ["session_id"], ["t_ms", "sequence"], detect.nucleus_fold, "t_ms double, nucleus boolean")
    return found.groupBy("session_id").agg(
        F.sum(F.col("nucleus").cast("long")).alias("nuclei"), F.count("*").alias("frames"),
        robust.median(F.when(F.col("nucleus"), F.col("t_ms"))).alias("median_ms")
    )
