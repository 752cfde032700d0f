"""Queries over voice frames that events make up: gates, segments, runs and the seven voice metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gates, voice
from .catalog import query, table

#: Frames to a session, ten milliseconds each.
FRAMES = 6000


def voice_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voice_frames_of(table(spark, sf_dir, "events"))


def voice_frames_of(events: DataFrame) -> DataFrame:
    """A frame for each event: its place by event_id, its measures from event_id and value."""
    e, k = F.col("event_id"), F.col("event_id") % FRAMES
    whole = F.floor("value")
    active = (F.expr(f"(event_id % {FRAMES}) div 60") % 4) != 3
    return events.select(
        F.expr(f"cast(event_id div {FRAMES} as string)").alias("session_id"), (k * 10.0).alias("t_ms"), (k * 10.0).alias("acquired_at_ms"), F.lit(1).cast("long").alias("capture_epoch"), k.alias("sequence"), (k * 480).alias("absolute_sample_index"),
        F.lit("ambient-speech-turn").alias("task_context"), F.lit("mic-1").alias("track_segment_id"), F.lit("dsp@1").alias("processor_ref"), active.alias("speech_active"), (e % 7 != 0).alias("periodic"), (e % 23 == 0).alias("syllabic_nucleus"),
        F.when(active, 0.02 + (e % 11) / 100.0).otherwise(0.002 + (e % 13) / 1000.0).alias("rms"), F.when(active, 100.0 + whole % 60).alias("f0_hz"), (0.6 + (e % 40) / 100.0).alias("f0_confidence"), (0.72 + (e % 25) / 100.0).alias("estimator_agreement"),
        (14.0 + whole % 20).alias("snr_db"), F.lit(0.001).alias("dc_offset"), F.lit(0.0).alias("spectral_flux"), F.lit(10.0).alias("cepstral_peak_prominence_db"), F.when(e % 1403 == 0, 0.02).otherwise(0.0).alias("clipped_sample_fraction"), F.lit(0.01).alias("lost_block_fraction"),
        F.lit(10.0).alias("block_gap_ms"), F.lit(48000.0).alias("sample_rate_hz"), F.struct(*[F.lit(False).alias(x) for x in (
            "echo_cancellation", "noise_suppression", "auto_gain_control"
        )]).alias("browser_processing"),
        F.when(e % 2801 == 0, F.array(F.lit("audio-frame-gap"))).otherwise(F.array().cast("array<string>")).alias("quality_reasons"),
    )


def voice_sessions(frames: DataFrame) -> DataFrame:
    return frames.select("session_id").distinct().select("session_id", F.lit(0.0).alias("session_started_at_ms"), F.lit(2500.0).alias("noise_calibration_duration_ms"))


FRAMES_SQL = f"""f AS (SELECT CAST(event_id // {FRAMES} AS VARCHAR) AS session_id, (event_id % {FRAMES}) * 10.0::DOUBLE AS t, event_id % {FRAMES} AS sequence, ((event_id % {FRAMES}) // 60) % 4 <> 3 AS active, event_id % 7 <> 0 AS periodic, event_id % 23 = 0 AS nucleus,
  CASE WHEN ((event_id % {FRAMES}) // 60) % 4 <> 3 THEN 0.02 + (event_id % 11) / 100.0 ELSE 0.002 + (event_id % 13) / 1000.0 END AS rms, CASE WHEN ((event_id % {FRAMES}) // 60) % 4 <> 3 THEN 100.0 + floor(value) % 60 END AS f0, 14 + floor(value) % 20 AS snr,
  event_id % 1403 = 0 AS clipped, event_id % 2801 = 0 AS gapped FROM events),
u AS (SELECT *, NOT clipped AND NOT gapped AS usable, active AND periodic AND f0 IS NOT NULL AND snr >= 15 AS pitched, floor(t / 10000) AS bucket FROM f),
k AS (SELECT *, CASE WHEN usable AND lag(usable) OVER v AND t - lag(t) OVER v <= 40 THEN 0 ELSE 1 END AS hard, CASE WHEN usable AND lag(usable) OVER v AND t - lag(t) OVER v <= 40 AND bucket = lag(bucket) OVER v THEN 0 ELSE 1 END AS soft FROM u WINDOW v AS (PARTITION BY session_id ORDER BY t, sequence)),
s AS (SELECT *, sum(hard) OVER v AS continuity_no, sum(soft) OVER v AS segment_no FROM k WINDOW v AS (PARTITION BY session_id ORDER BY t, sequence ROWS UNBOUNDED PRECEDING)),
w AS (SELECT *, CASE WHEN lead(t) OVER v IS NULL THEN 10.0 ELSE least(40.0, lead(t) OVER v - t) END AS weight FROM s WHERE usable WINDOW v AS (PARTITION BY session_id, segment_no ORDER BY t, sequence)),
g AS (SELECT session_id, segment_no, min(continuity_no) AS continuity_no, count(*) AS n_frames, min(t) AS start_ms, max(t) AS last_ms, sum(weight) AS duration_ms, sum(CASE WHEN active THEN weight ELSE 0 END) AS active_ms, sum(CASE WHEN pitched THEN weight ELSE 0 END) AS pitched_ms, sum((active AND nucleus)::INT) AS nuclei FROM w GROUP BY session_id, segment_no),
a AS (SELECT *, least(1.0, n_frames / (floor((last_ms - start_ms) / 10) + 1), 0.99) AS coverage FROM g WHERE n_frames >= 2 AND duration_ms >= 2000 AND active_ms >= 1000)"""


@query(
    "voice_segments",
    f"WITH {FRAMES_SQL} SELECT session_id, CAST(n_frames AS BIGINT) AS n_frames, start_ms, round(duration_ms, 4) AS duration_ms, round(active_ms, 4) AS active_ms, round(pitched_ms, 4) AS pitched_ms, round(coverage, 6) AS coverage FROM a WHERE coverage >= 0.9"
)
def voice_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = voice_frames(spark, sf_dir)
    accepted, _ = voice.segments(frames, voice_sessions(frames))
    r = lambda c, n=4: F.round(c, n).alias(c)
    return accepted.select("session_id", "n_frames", "start_ms", r("duration_ms"), r("active_ms"), r("pitched_ms"), r("coverage", 6))


@query(
    "voice_gate_failures",
    f"""WITH {FRAMES_SQL}, r AS (SELECT session_id, unnest(list_filter([CASE WHEN clipped THEN 'clipping' END, CASE WHEN active AND snr < 15 THEN 'speech-snr-pitch-only' END, CASE WHEN gapped THEN 'quality:audio-frame-gap' END], lambda x: x IS NOT NULL)) AS reason FROM f)
SELECT session_id, reason, count(*) AS frames FROM r GROUP BY session_id, reason""",
)
def voice_gate_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = voice_frames(spark, sf_dir)
    return voice.gate_failure_counts(frames, voice_sessions(frames))


@query(
    "voice_screening",
    f"WITH {FRAMES_SQL} SELECT session_id, count(*) AS frames, CAST(0 AS BIGINT) AS ignored, CAST(sum((usable AND NOT (active AND snr < 15))::INT) AS BIGINT) AS usable, CAST(sum(active::INT) AS BIGINT) AS active, CAST(sum(periodic::INT) AS BIGINT) AS periodic_frames FROM u GROUP BY session_id",
)
def voice_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = voice_frames(spark, sf_dir)
    return voice.screening(frames, voice_sessions(frames))


JOINT_SQL = f"""{FRAMES_SQL}, b AS (SELECT * FROM a WHERE coverage >= 0.9),
jb AS (SELECT *, CASE WHEN start_ms - lag(last_ms) OVER v <= 40 AND continuity_no = lag(continuity_no) OVER v THEN 0 ELSE 1 END AS opens FROM b WINDOW v AS (PARTITION BY session_id ORDER BY start_ms)),
j AS (SELECT *, sum(opens) OVER (PARTITION BY session_id ORDER BY start_ms ROWS UNBOUNDED PRECEDING) AS joint_no FROM jb),
jf AS (SELECT w.session_id, w.t, w.sequence, w.active, w.periodic, w.nucleus, w.rms, j.joint_no FROM w JOIN j USING (session_id, segment_no)),
jw AS (SELECT *, CASE WHEN lead(t) OVER v IS NULL THEN 10.0 ELSE least(40.0, lead(t) OVER v - t) END AS weight, CASE WHEN active IS DISTINCT FROM lag(active) OVER v OR row_number() OVER v = 1 THEN 1 ELSE 0 END AS turn FROM jf WINDOW v AS (PARTITION BY session_id, joint_no ORDER BY t, sequence)),
jr AS (SELECT *, sum(turn) OVER (PARTITION BY session_id, joint_no ORDER BY t, sequence ROWS UNBOUNDED PRECEDING) AS run_no FROM jw),
rr AS (SELECT session_id, joint_no, run_no, bool_or(active) AS active, min(t) AS start_ms, sum(weight) AS duration_ms, sum(CASE WHEN periodic THEN weight ELSE 0 END) AS phonated_ms, max(rms) AS peak, min(rms) AS floor FROM jr GROUP BY session_id, joint_no, run_no),
e AS (SELECT *, run_no = 1 OR run_no = max(run_no) OVER (PARTITION BY session_id, joint_no) AS edge FROM rr),
ev AS (SELECT *, CASE WHEN active THEN NULL WHEN edge THEN 'truncated' WHEN duration_ms >= 150 AND floor > 0 AND peak >= 2.5 * floor THEN 'breath' ELSE 'hesitation' END AS pause_kind, NOT active AND NOT edge AND duration_ms BETWEEN 200 AND 1999 AS counted FROM e)"""


@query(
    "voice_runs",
    f"WITH {JOINT_SQL} SELECT session_id, start_ms, active, round(duration_ms, 4) AS duration_ms, round(phonated_ms, 4) AS phonated_ms, round(peak, 6) AS peak_level, pause_kind, counted AS counted_pause FROM ev"
)
def voice_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = voice_frames(spark, sf_dir)
    accepted, cut = voice.segments(frames, voice_sessions(frames))
    _, joint = voice.rejoined(accepted, cut)
    r = lambda c, n=4: F.round(c, n).alias(c)
    return voice.run_events(joint).select("session_id", "start_ms", "active", r("duration_ms"), r("phonated_ms"), r("peak_level", 6), "pause_kind", "counted_pause")


METRICS_SQL = f"""WITH {JOINT_SQL}, n AS (SELECT session_id, count(*) AS segments, sum(duration_ms) AS eligible, sum(active_ms) AS active, sum(pitched_ms) AS pitched, sum(nuclei) AS nuclei FROM b GROUP BY session_id),
m AS (SELECT session_id, segment_no, quantile_cont(f0, 0.5) AS m FROM w JOIN b USING (session_id, segment_no) WHERE pitched AND b.pitched_ms >= 1000 GROUP BY ALL),
p AS (SELECT session_id, count(*) AS f0_n, quantile_cont(m, 0.5) AS f0 FROM m GROUP BY session_id),
q AS (SELECT session_id, count(*) FILTER (WHERE counted) AS pauses, quantile_cont(duration_ms / 1000, 0.5) FILTER (WHERE counted) AS pause_s, count(*) FILTER (WHERE active) AS runs, quantile_cont(duration_ms / 1000, 0.5) FILTER (WHERE active) AS run_s FROM ev GROUP BY session_id),
pb AS (SELECT w.session_id, w.segment_no, floor((w.t - b.start_ms) / 500) AS bin, w.t, w.sequence, w.f0, w.pitched FROM w JOIN b USING (session_id, segment_no) WHERE b.pitched_ms >= 1000),
pw AS (SELECT *, CASE WHEN lead(t) OVER v IS NULL THEN 10.0 ELSE least(40.0, lead(t) OVER v - t) END AS weight FROM pb WINDOW v AS (PARTITION BY session_id, segment_no, bin ORDER BY t, sequence)),
pm AS (SELECT session_id, segment_no, bin, quantile_cont(f0, 0.5) FILTER (WHERE pitched) AS pitch FROM pw GROUP BY ALL HAVING sum(weight) >= 400 AND sum(CASE WHEN pitched THEN weight ELSE 0 END) >= 300 AND count(*) FILTER (WHERE pitched) >= 2),
pc AS (SELECT session_id, segment_no, quantile_cont(pitch, 0.5) AS c FROM pm GROUP BY ALL),
pv AS (SELECT session_id, segment_no, stddev_pop(12 * log2(pitch / c)) AS sd FROM pm JOIN pc USING (session_id, segment_no) GROUP BY ALL HAVING count(*) >= 4),
pe AS (SELECT session_id, count(*) AS v_n, quantile_cont(sd, 0.5) AS v, sum(b.pitched_ms) AS v_pitched, sum(b.pitched_ms) / sum(b.active_ms) AS v_cov FROM pv JOIN b USING (session_id, segment_no) GROUP BY session_id),
x AS (SELECT s.session_id, n.*, p.f0_n, p.f0, q.*, pe.*, CASE WHEN segments IS NULL THEN 'no-usable-signal' WHEN segments < 3 THEN 'insufficient-segments' WHEN eligible < 30000 THEN 'insufficient-duration' WHEN n.active < 15000 THEN 'insufficient-active-speech' END AS common
  FROM (SELECT DISTINCT session_id FROM f) s LEFT JOIN n ON n.session_id = s.session_id LEFT JOIN p ON p.session_id = s.session_id LEFT JOIN q ON q.session_id = s.session_id LEFT JOIN pe ON pe.session_id = s.session_id),
y AS (SELECT *, coalesce(common, CASE WHEN coalesce(f0_n, 0) < 3 OR pitched < 10000 OR pitched / active < 0.6 THEN 'insufficient-pitched-speech' END) AS pf FROM x),
o AS (SELECT session_id, 'ambient.voice.f0.median' AS metric_code, pf AS reason_code, f0 AS value FROM y UNION ALL
  SELECT session_id, 'ambient.voice.f0.variability', coalesce(pf, CASE WHEN coalesce(v_n, 0) >= 3 AND (v_pitched < 10000 OR v_cov < 0.6) THEN 'insufficient-pitched-speech' WHEN coalesce(v_n, 0) < 3 THEN 'insufficient-pitch-bins' END), v FROM y UNION ALL
  SELECT session_id, 'ambient.voice.speech_activity_fraction', common, active / eligible FROM y UNION ALL SELECT session_id, 'ambient.voice.pause_rate', common, pauses / (eligible / 60000) FROM y UNION ALL
  SELECT session_id, 'ambient.voice.pause_duration.median', coalesce(common, CASE WHEN coalesce(pauses, 0) < 5 THEN 'insufficient-events' END), pause_s FROM y UNION ALL
  SELECT session_id, 'ambient.voice.speech_run_duration.median', coalesce(common, CASE WHEN coalesce(runs, 0) < 5 THEN 'insufficient-events' END), run_s FROM y UNION ALL
  SELECT session_id, 'ambient.voice.acoustic_nucleus_rate', coalesce(common, CASE WHEN coalesce(nuclei, 0) < 30 THEN 'insufficient-nuclei' END), nuclei / (active / 1000) FROM y)
SELECT session_id, metric_code, CASE WHEN reason_code IS NULL THEN 'measured' ELSE 'withheld' END AS status, reason_code, CASE WHEN reason_code IS NULL THEN round(value, 6) END AS value FROM o"""


@query("voice_metrics", METRICS_SQL)
def voice_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = voice_frames(spark, sf_dir)
    return voice.metrics(frames, voice_sessions(frames)).select("session_id", "metric_code", "status", "reason_code", F.round("value", 6).alias("value"))


@query(
    "voice_evidence",
    f"""WITH {JOINT_SQL}, n AS (SELECT session_id, count(*) AS segments, CAST(sum(n_frames) AS BIGINT) AS samples, sum(duration_ms) AS eligible_ms, sum(active_ms) AS active_ms, sum(pitched_ms) AS pitched_ms, min(coverage) AS timing_coverage, min(duration_ms) AS segment_span_ms, quantile_cont(coverage, 0.5) AS cov FROM b GROUP BY session_id),
m AS (SELECT session_id, quantile_cont(snr, 0.5) FILTER (WHERE active) AS snr FROM w JOIN b USING (session_id, segment_no) GROUP BY session_id)
SELECT session_id, segments, samples, round(eligible_ms, 3) AS eligible_ms, round(active_ms, 3) AS active_ms, round(pitched_ms, 3) AS pitched_ms, round(timing_coverage, 6) AS timing_coverage, round(segment_span_ms, 3) AS segment_span_ms, round(pitched_ms / active_ms, 6) AS pitch_coverage,
  round(0.35 * cov + 0.3 * greatest(0, least(1, (snr - 15) / 15)) + 0.2 + 0.15 * (1 - 0.01 / 0.05), 6) AS quality FROM n JOIN m USING (session_id)""",
)
def voice_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = voice_frames(spark, sf_dir)
    found = voice.evidence(*voice.segments(frames, voice_sessions(frames)))
    r = lambda c, n=3: F.round(c, n).alias(c)
    return found.select("session_id", "segments", "samples", r("eligible_ms"), r("active_ms"), r("pitched_ms"), r("timing_coverage", 6), r("segment_span_ms"), r("pitch_coverage", 6), r("quality", 6))


@query(
    "voice_quality_tiers",
    f"""WITH {FRAMES_SQL} SELECT session_id, CAST(sum((NOT clipped AND NOT gapped AND rms >= 0.003)::INT) AS BIGINT) AS timing_frames, CAST(sum((NOT clipped AND NOT gapped AND rms >= 0.003 AND snr >= 15)::INT) AS BIGINT) AS general_frames,
CAST(sum((NOT clipped AND NOT gapped AND rms >= 0.003 AND snr >= 20)::INT) AS BIGINT) AS fine_frames FROM f GROUP BY session_id""",
)
def voice_quality_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiers = gates.voice_quality_tiers()
    return voice_frames(spark, sf_dir).groupBy("session_id").agg(*[F.sum(tiers[f"{t}_usable"].cast("long")).alias(f"{t}_frames") for t in ("timing", "general", "fine")])
