"""Voice queries over frames in which every gate fails once in a while and every break and failure of a session occurs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gates, voice
from . import voice_lane
from .catalog import query, table

#: Frames to a session, twenty milliseconds each; every so many events a frame fails a gate, one gate after the other.
FRAMES, STEP_MS, FLAW = 2500, 20, 997
GATES = ["task-context", "no-track-id", "sample-rate", "block-gap", "lost-blocks", "clipping", "dc-offset", "non-finite-snr", "quality:audio-frame-gap"]


def varied_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame for each event. Of four sessions one has a gap in time, one a short calibration and one changes its track or epoch half-way."""
    e, s, k = F.col("event_id"), F.expr(f"event_id div {FRAMES}"), F.col("event_id") % FRAMES
    whole = F.floor("value")
    active = (F.expr(f"(event_id % {FRAMES}) div 60") % 4) != 3
    flaw = lambda n: (e % FLAW == 500) & (F.expr(f"event_id div {FLAW}") % len(GATES) == n)
    late = k >= FRAMES // 2
    return table(spark, sf_dir, "events").select(
        s.cast("string").alias("session_id"), (k * float(STEP_MS) + F.when((s % 4 == 1) & (k >= 1500), 100.0).otherwise(0.0)).alias("t_ms"), (k * float(STEP_MS)).alias("acquired_at_ms"), F.when((s % 8 == 7) & late, 2).otherwise(1).cast("long").alias("capture_epoch"), k.alias("sequence"), (k * 960).alias("absolute_sample_index"),
        F.when(flaw(0), "other-task").otherwise("ambient-speech-turn").alias("task_context"), F.when(flaw(1), "").when((s % 8 == 3) & late, "mic-2").otherwise("mic-1").alias("track_segment_id"), F.lit("dsp@1").alias("processor_ref"), active.alias("speech_active"), (e % 7 != 0).alias("periodic"), (e % 23 == 0).alias("syllabic_nucleus"),
        F.when(active, 0.02 + (e % 11) / 100.0).otherwise(0.002 + (e % 13) / 1000.0).alias("rms"), F.when(active, 100.0 + whole % 60).alias("f0_hz"), (0.6 + (e % 40) / 100.0).alias("f0_confidence"), (0.72 + (e % 25) / 100.0).alias("estimator_agreement"),
        F.when(flaw(7), F.lit(float("nan"))).otherwise(14.0 + whole % 20).alias("snr_db"), F.when(flaw(6), -0.2).otherwise(0.001).alias("dc_offset"), ((e % 5) / 100.0).alias("spectral_flux"), F.lit(10.0).alias("cepstral_peak_prominence_db"),
        F.when(flaw(5), 0.05).when(e % 400 == 5, 0.002).otherwise(0.0).alias("clipped_sample_fraction"), F.when(flaw(4), 0.2).otherwise((s % 3 + 1) / 100.0).alias("lost_block_fraction"), F.when(flaw(3), 80.0).otherwise(10.0).alias("block_gap_ms"),
        F.when(flaw(2), 22_050.0).otherwise(48_000.0).alias("sample_rate_hz"), F.struct(*[(e % 1709 == 17).alias(x) for x in ("echo_cancellation", "noise_suppression", "auto_gain_control")]).alias("browser_processing"),
        F.when(flaw(8), F.array(F.lit("audio-frame-gap"))).otherwise(F.array().cast("array<string>")).alias("quality_reasons"),
    )


def varied_sessions(frames: DataFrame) -> DataFrame:
    s = F.col("session_id").cast("long") % 4
    return frames.select("session_id").distinct().select("session_id", F.when(s == 1, 400.0).otherwise(0.0).alias("session_started_at_ms"), F.when(s == 2, 500.0).otherwise(2500.0).alias("noise_calibration_duration_ms"))


FRAMES_SQL = f"""f0 AS (SELECT event_id AS e, event_id // {FRAMES} AS s, event_id % {FRAMES} AS k, value, CASE WHEN event_id % {FLAW} = 500 THEN event_id // {FLAW} % {len(GATES)} END AS q FROM events),
fa AS (SELECT CAST(s AS VARCHAR) AS session_id, k * {STEP_MS}.0::DOUBLE + CASE WHEN s % 4 = 1 AND k >= 1500 THEN 100 ELSE 0 END AS t, k AS sequence, (k // 60) % 4 <> 3 AS active, e % 7 <> 0 AS periodic, e % 23 = 0 AS nucleus,
  CASE WHEN (k // 60) % 4 <> 3 THEN 0.02 + (e % 11) / 100.0 ELSE 0.002 + (e % 13) / 1000.0 END AS rms, CASE WHEN (k // 60) % 4 <> 3 THEN 100.0 + floor(value) % 60 END AS f0, CASE WHEN q IS NOT DISTINCT FROM 7 THEN NULL ELSE 14 + floor(value) % 20 END AS snr, q,
  CASE WHEN s % 4 = 1 THEN 400.0 ELSE 0.0 END AS start, CASE WHEN s % 4 = 2 THEN 500 ELSE 2500 END AS calibration, CASE WHEN s % 8 = 7 AND k >= 1250 THEN '2|' ELSE '1|' END || CASE WHEN q IS NOT DISTINCT FROM 1 THEN '' WHEN s % 8 = 3 AND k >= 1250 THEN 'mic-2' ELSE 'mic-1' END AS source,
  (s % 3 + 1) / 100.0 AS lost, CASE WHEN e % 400 = 5 THEN 0.002 ELSE 0 END AS clip FROM f0),
f AS (SELECT * FROM fa WHERE t >= start),
u AS (SELECT *, q IS NULL AS usable, coalesce(active AND periodic AND f0 IS NOT NULL AND snr >= 15, false) AS pitched, floor((t - start) / 10000) AS bucket FROM f),
k AS (SELECT *, CASE WHEN usable AND lag(usable) OVER v AND t - lag(t) OVER v <= 40 AND source = lag(source) OVER v THEN 0 ELSE 1 END AS hard, CASE WHEN usable AND lag(usable) OVER v AND t - lag(t) OVER v <= 40 AND source = lag(source) OVER v AND bucket = lag(bucket) OVER v THEN 0 ELSE 1 END AS soft FROM u WINDOW v AS (PARTITION BY session_id ORDER BY t, sequence)),
s AS (SELECT *, sum(hard) OVER v AS continuity_no, sum(soft) OVER v AS segment_no FROM k WINDOW v AS (PARTITION BY session_id ORDER BY t, sequence ROWS UNBOUNDED PRECEDING)),
w AS (SELECT *, CASE WHEN lead(t) OVER v IS NULL THEN 20.0 ELSE least(40.0, lead(t) OVER v - t) END AS weight FROM s WHERE usable WINDOW v AS (PARTITION BY session_id, segment_no ORDER BY t, sequence)),
g AS (SELECT session_id, segment_no, min(continuity_no) AS continuity_no, min(source) AS source, max(lost) AS lost, max(clip) AS clip, count(*) AS n_frames, min(t) AS start_ms, max(t) AS last_ms, sum(weight) AS duration_ms, sum(CASE WHEN active THEN weight ELSE 0 END) AS active_ms, sum(CASE WHEN pitched THEN weight ELSE 0 END) AS pitched_ms, sum((active AND nucleus)::INT) AS nuclei FROM w GROUP BY session_id, segment_no),
a AS (SELECT *, least(1.0, n_frames / (floor((last_ms - start_ms) / {STEP_MS}) + 1), 1 - lost) AS coverage FROM g WHERE n_frames >= 2 AND duration_ms >= 2000 AND active_ms >= 1000)"""
#: What follows in the plain queries, with this step and with the failures of sessions that do not occur there.
JOINT_SQL = FRAMES_SQL + voice_lane.JOINT_SQL.removeprefix(voice_lane.FRAMES_SQL).replace("10.0 ELSE", "20.0 ELSE")
METRICS_SQL = "WITH " + JOINT_SQL + (
    voice_lane.METRICS_SQL.removeprefix("WITH " + voice_lane.JOINT_SQL).replace("10.0 ELSE", "20.0 ELSE").replace("sum(nuclei) AS nuclei FROM b", "sum(nuclei) AS nuclei, count(DISTINCT source) AS tracks FROM b")
    .replace("CASE WHEN segments IS NULL THEN 'no-usable-signal' WHEN", "CASE WHEN calibration < 2000 THEN 'quality-threshold-failed' WHEN segments IS NULL THEN 'no-usable-signal' WHEN tracks > 1 THEN 'quality-threshold-failed' WHEN")
    .replace("(SELECT DISTINCT session_id FROM f) s", "(SELECT session_id, min(calibration) AS calibration FROM f GROUP BY session_id) s")
)


@query(
    "varied_voice_gates",
    f"""WITH {FRAMES_SQL}, r AS (SELECT session_id, {GATES}[1 + q] AS reason FROM f WHERE q IS NOT NULL UNION ALL SELECT session_id, 'speech-snr-pitch-only' FROM f WHERE active AND snr < 15) SELECT session_id, reason, count(*) AS frames FROM r GROUP BY session_id, reason""",
)
def varied_voice_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = varied_frames(spark, sf_dir)
    return voice.gate_failure_counts(frames, varied_sessions(frames))


@query(
    "varied_voice_screening",
    f"""WITH {FRAMES_SQL}, i AS (SELECT session_id, sum((t < start)::INT) AS ignored FROM fa GROUP BY session_id)
SELECT session_id, count(*) AS frames, CAST(any_value(ignored) AS BIGINT) AS ignored, CAST(sum((usable AND NOT coalesce(active AND snr < 15, false))::INT) AS BIGINT) AS usable, CAST(sum(active::INT) AS BIGINT) AS active, CAST(sum(periodic::INT) AS BIGINT) AS periodic_frames FROM u JOIN i USING (session_id) GROUP BY session_id""",
)
def varied_voice_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = varied_frames(spark, sf_dir)
    return voice.screening(frames, varied_sessions(frames))


@query(
    "varied_voice_segments",
    f"WITH {FRAMES_SQL} SELECT session_id, CAST(n_frames AS BIGINT) AS n_frames, start_ms, round(duration_ms, 4) AS duration_ms, round(active_ms, 4) AS active_ms, round(pitched_ms, 4) AS pitched_ms, round(coverage, 6) AS coverage, split_part(source, '|', 2) AS track_segment_id, CAST(split_part(source, '|', 1) AS BIGINT) AS capture_epoch FROM a WHERE coverage >= 0.9",
)
def varied_voice_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = varied_frames(spark, sf_dir)
    accepted, _ = voice.segments(frames, varied_sessions(frames))
    r = lambda c, n=4: F.round(c, n).alias(c)
    return accepted.select("session_id", "n_frames", "start_ms", r("duration_ms"), r("active_ms"), r("pitched_ms"), r("coverage", 6), "track_segment_id", "capture_epoch")


@query(
    "varied_voice_evidence",
    f"""WITH {JOINT_SQL}, n AS (SELECT session_id, count(*) AS segments, CAST(sum(n_frames) AS BIGINT) AS samples, sum(duration_ms) AS eligible_ms, count(DISTINCT source) AS tracks, max(lost) AS lost, max(clip) AS clip, quantile_cont(coverage, 0.5) AS cov FROM b GROUP BY session_id),
m AS (SELECT session_id, quantile_cont(snr, 0.5) FILTER (WHERE active) AS snr FROM w JOIN b USING (session_id, segment_no) GROUP BY session_id)
SELECT session_id, segments, samples, round(eligible_ms, 3) AS eligible_ms, tracks, round(0.35 * cov + 0.3 * greatest(0, least(1, (snr - 15) / 15)) + 0.2 * (1 - least(1, clip / 0.01)) + 0.15 * (1 - least(1, lost / 0.05)), 6) AS quality FROM n JOIN m USING (session_id)""",
)
def varied_voice_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = varied_frames(spark, sf_dir)
    found = voice.evidence(*voice.segments(frames, varied_sessions(frames)))
    return found.select("session_id", "segments", "samples", F.round("eligible_ms", 3).alias("eligible_ms"), "tracks", F.round("quality", 6).alias("quality"))


@query("varied_voice_metrics", METRICS_SQL)
def varied_voice_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = varied_frames(spark, sf_dir)
    return voice.metrics(frames, varied_sessions(frames)).select("session_id", "metric_code", "status", "reason_code", F.round("value", 6).alias("value"))


@query(
    "varied_voice_tiers",
    f"""WITH {FRAMES_SQL}, x AS (SELECT session_id, coalesce(q NOT IN (3, 4, 5, 8), true) AND rms >= 0.003 AS timing, coalesce(snr >= 15, true) AND coalesce(q <> 6, true) AS loud, coalesce(snr >= 20, false) AND coalesce(q <> 2, true) AND e % 1709 <> 17 AS fine FROM (SELECT fa.*, f0.e AS e FROM fa JOIN f0 ON f0.s::VARCHAR = fa.session_id AND f0.k = fa.sequence))
SELECT session_id, CAST(sum(timing::INT) AS BIGINT) AS timing_frames, CAST(sum((timing AND loud)::INT) AS BIGINT) AS general_frames, CAST(sum((timing AND loud AND fine)::INT) AS BIGINT) AS fine_frames FROM x GROUP BY session_id""",
)
def varied_voice_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames usable for timing, in general, and for fine measures; some with browser processing on."""
    tiers = gates.voice_quality_tiers()
    return varied_frames(spark, sf_dir).groupBy("session_id").agg(*[F.sum(tiers[f"{t}_usable"].cast("long")).alias(f"{t}_frames") for t in ("timing", "general", "fine")])
