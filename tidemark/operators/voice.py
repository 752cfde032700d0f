"""Voice metrics of many sessions at once: segments, runs and pauses, seven outcomes measured or withheld.

Frames follow sources.schemas.VOICE_FRAMES; sessions need session_id and session_started_at_ms. All windows
are within a session, so one shuffle by session_id serves them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources import registry
from ..sources.scratch import SHUFFLED, materialize
from . import gates, robust, sessionize

# Fixed values of the voice metrics.
MAX_CAPTURE_MS = 300_000
SEGMENT_MAX_MS, SEGMENT_MIN_MS, SEGMENT_ACTIVE_MIN_MS = 10_000, 2_000, 1_000
MIN_COVERAGE, MIN_SEGMENTS = 0.9, 3
TIMING_MIN_MS, ACTIVE_MIN_MS, PITCH_MIN_MS, MIN_PITCH_COVERAGE = 30_000, 15_000, 10_000, 0.6
PITCH_BIN_MS, PITCH_BIN_COVERED_MS, PITCH_BIN_PITCHED_MS, MIN_PITCH_BINS = 500, 400, 300, 4
MIN_PAUSE_MS, MAX_PAUSE_MS, MIN_EVENTS, MIN_NUCLEI = 200, 1_999, 5, 30
BREATH_RATIO, BREATH_MIN_MS = 2.5, 150
NOISE_CALIBRATION_MS = 2_000
METRICS = registry.codes("voice")

KEY = ["session_id"]
ORDER = ["t_ms", "sequence"]
PROVENANCE = ["capture_epoch", "processor_ref", "track_segment_id"]


def in_range(frames: DataFrame, sessions: DataFrame) -> DataFrame:
    """Frames with in_range: within the session's first five minutes. The others are only counted."""
    start = F.col("session_started_at_ms")
    return frames.join(sessions.select("session_id", "session_started_at_ms"), "session_id").withColumn(
        "in_range", S.finite("t_ms") & (F.col("t_ms") >= start) & (F.col("t_ms") < start + MAX_CAPTURE_MS)
    )


def _weighted(frames: DataFrame, keys: list[str]) -> DataFrame:
    return robust.frame_weights(frames, keys, ORDER, "t_ms", float(gates.MAX_BLOCK_GAP_MS), 10.0)


def _summary(frames: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each accepted group of weighted frames."""
    w = F.col("weight_ms")
    grouped = frames.groupBy(*keys).agg(
        F.count("*").alias("n_frames"), F.min("t_ms").alias("start_ms"), F.max("t_ms").alias("last_ms"), F.first("nominal_ms").alias("nominal_ms"), F.sum(w).alias("duration_ms"),
        F.sum(F.when(F.col("speech_active"), w).otherwise(0.0)).alias("active_ms"), F.sum(F.when(F.col("pitched"), w).otherwise(0.0)).alias("pitched_ms"),
        F.max("lost_block_fraction").alias("lost"), F.max("clipped_sample_fraction").alias("clipped"), F.sum((F.col("speech_active") & F.col("syllabic_nucleus")).cast("long")).alias("nuclei"),
        *[F.first(c).alias(c) for c in PROVENANCE], F.first("continuity_no").alias("continuity_no"),
    )
    expected = F.floor((F.col("last_ms") - F.col("start_ms")) / F.col("nominal_ms")) + 1
    covered = grouped.withColumn("coverage", F.least(F.lit(1.0), F.col("n_frames") / expected, 1 - F.col("lost"))).withColumn("end_ms", F.col("last_ms") + F.col("nominal_ms"))
    return covered.filter((F.col("n_frames") >= 2) & (F.col("duration_ms") >= SEGMENT_MIN_MS) & (F.col("active_ms") >= SEGMENT_ACTIVE_MIN_MS) & (F.col("coverage") >= MIN_COVERAGE))


def segments(frames: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted segments, their weighted frames): stretches of usable frames within ten seconds, gap and provenance."""
    ranged = in_range(frames, sessions).filter("in_range").withColumn("usable", gates.voice_timing_usable()).withColumn("pitched", gates.valid_pitch())
    bucket = F.floor((F.col("t_ms") - F.col("session_started_at_ms")) / float(SEGMENT_MAX_MS))
    cut = sessionize.usable_segments(ranged, KEY, ORDER, "t_ms", "usable", PROVENANCE, gates.MAX_BLOCK_GAP_MS, bucket)
    weighted = _weighted(cut, [*KEY, "segment_no"])
    accepted = _summary(weighted, [*KEY, "segment_no"])
    accepted = accepted.withColumn("window_ref", S.window_ref("voice", "capture_epoch", "track_segment_id", "start_ms", "end_ms"))
    return accepted, weighted.join(accepted.select(*KEY, "segment_no", F.col("start_ms").alias("segment_start_ms")), [*KEY, "segment_no"])


def rejoined(accepted: DataFrame, frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Neighbouring segments of one continuity and provenance no further apart than a block gap, joined, weighted and accepted anew."""
    w = Window.partitionBy(*KEY).orderBy("start_ms", "segment_no")
    gap = F.col("start_ms") - F.lag("last_ms").over(w)
    joint = sessionize.islands(
        accepted, KEY, ["start_ms", "segment_no"],
        (gap <= 0) | (gap > gates.MAX_BLOCK_GAP_MS) | sessionize.changes(KEY, ["start_ms", "segment_no"], "continuity_no", *PROVENANCE), "joint_no"
    )
    cut = frames.drop("nominal_ms", "weight_ms", "step_before", "step_after").join(joint.select(*KEY, "segment_no", "joint_no"), [*KEY, "segment_no"])
    weighted = _weighted(cut, [*KEY, "joint_no"])
    whole = _summary(weighted, [*KEY, "joint_no"])
    return whole, weighted.join(whole.select(*KEY, "joint_no"), [*KEY, "joint_no"])


def run_events(frames: DataFrame) -> DataFrame:
    """Ordered speech runs and pauses of the rejoined segments; a pause is truncated (at an edge), breath or hesitation."""
    keys = [*KEY, "joint_no"]
    numbered = sessionize.runs(frames, keys, ORDER, "speech_active")
    level = F.when(S.finite("rms"), F.col("rms")).otherwise(0.0)
    grouped = numbered.groupBy(*keys, "run_no").agg(
        F.first("speech_active").alias("active"), F.min("t_ms").alias("start_ms"), F.max_by(
            F.col("t_ms") + F.col("weight_ms"), F.struct("t_ms", "sequence")
        ).alias("end_ms"), F.sum("weight_ms").alias("duration_ms"),
        F.sum(F.when(F.col("periodic"), F.col("weight_ms")).otherwise(0.0)).alias("phonated_ms"), F.sum(F.col("syllabic_nucleus").cast("long")).alias("nuclei"), F.avg(level).alias("mean_level"), F.max(level).alias("peak_level"), F.min(level).alias("floor_level"),
    )
    edge = (F.col("run_no") == 1) | (F.col("run_no") == F.max("run_no").over(Window.partitionBy(*keys)))
    breath = (F.col("duration_ms") >= BREATH_MIN_MS) & (F.col("floor_level") > 0) & (F.col("peak_level") >= BREATH_RATIO * F.col("floor_level"))
    kind = F.when(~F.col("active"), S.first_reason([(edge, "truncated"), (breath, "breath")], F.lit("hesitation")))
    return grouped.withColumn("pause_kind", kind).withColumn(
        "counted_pause", ~F.col("active") & ~edge & F.col("duration_ms").between(MIN_PAUSE_MS, MAX_PAUSE_MS)
    ).withColumn("mean_level", F.least("mean_level", "peak_level"))


def pitch_bins(frames: DataFrame) -> DataFrame:
    """Half-second parts of segments with enough cover and pitch, and their median pitch."""
    keys = [*KEY, "segment_no", "pitch_bin"]
    binned = frames.drop("nominal_ms", "weight_ms", "step_before", "step_after").withColumn("pitch_bin", F.floor((F.col("t_ms") - F.col("segment_start_ms")) / float(PITCH_BIN_MS)))
    f0 = F.when(F.col("pitched"), F.col("f0_hz"))
    grouped = _weighted(binned, keys).groupBy(*keys).agg(
        F.sum("weight_ms").alias("covered_ms"), F.sum(F.when(F.col("pitched"), F.col("weight_ms")).otherwise(0.0)).alias("pitched_ms"),
        F.count(f0).alias("n_pitch"), robust.median(f0).alias("pitch")
    )
    return grouped.filter((F.col("covered_ms") >= PITCH_BIN_COVERED_MS) & (F.col("pitched_ms") >= PITCH_BIN_PITCHED_MS) & (F.col("n_pitch") >= 2))


def _score(frames_median_snr: Column, coverage: Column, clipped: Column, lost: Column) -> Column:
    snr = F.coalesce(S.clamp01((frames_median_snr - 15) / 15), F.lit(0.0))
    return S.clamp01(0.35 * coverage + 0.3 * snr + 0.2 * (1 - S.clamp01(clipped / gates.MAX_CLIPPED_FRACTION)) + 0.15 * (1 - S.clamp01(lost / gates.MAX_LOST_BLOCK_FRACTION)))


def evidence(accepted: DataFrame, frames: DataFrame) -> DataFrame:
    """Sums and worst cases over a session's segments, and the technical quality score."""
    snr = frames.groupBy(*KEY).agg(
        robust.median(F.when(F.col("speech_active"), F.col("snr_db"))).alias("median_snr"),
        F.min(F.when(F.col("pitched"), F.col("f0_confidence"))).alias("estimator_quality"),
        F.min(F.when(F.col("pitched"), F.col("estimator_agreement"))).alias("estimator_agreement")
    )
    sums = accepted.groupBy(*KEY).agg(
        F.count("*").alias("segments"), F.sum("n_frames").alias("samples"), F.sum("duration_ms").alias("eligible_ms"), F.sum("active_ms").alias("active_ms"), F.sum("pitched_ms").alias("pitched_ms"), F.sum("nuclei").alias("nuclei"),
        F.min("coverage").alias("timing_coverage"), F.min("duration_ms").alias("segment_span_ms"), F.min("active_ms").alias("active_per_segment_ms"), F.countDistinct("processor_ref").alias("processors"),
        F.countDistinct("capture_epoch", "track_segment_id").alias("tracks"), robust.median("coverage").alias("median_coverage"), F.max("clipped").alias("clipped"), F.max("lost").alias("lost"), S.sorted_unique("processor_ref").alias("processor_refs"),
        F.array_sort(F.collect_set("window_ref")).alias("window_refs"),
    )
    joined = sums.join(snr, KEY, "left")
    return joined.withColumn(
        "pitch_coverage", F.when(F.col("active_ms") > 0, F.col("pitched_ms") / F.col("active_ms")).otherwise(0.0)
    ).withColumn("quality", _score(F.col("median_snr"), F.col("median_coverage"), F.col("clipped"), F.col("lost")))


def common_failure() -> Column:
    """The first reason, over a session's evidence, why no voice metric can be published."""
    c = F.col
    return S.first_reason([
        (F.coalesce(c("noise_calibration_duration_ms"), F.lit(0.0)) < NOISE_CALIBRATION_MS, "quality-threshold-failed"), (F.coalesce(c("segments"), F.lit(0)) == 0, "no-usable-signal"),
        (
            (c("processors") > 1) | (c("tracks") > 1), "quality-threshold-failed"
        ), (c("segments") < MIN_SEGMENTS, "insufficient-segments"), (c("eligible_ms") < TIMING_MIN_MS, "insufficient-duration"), (c("active_ms") < ACTIVE_MIN_MS, "insufficient-active-speech"),
    ])


def _two_level(df: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """median and spread of the groups' medians, by session."""
    each = df.groupBy(*KEY, group).agg(robust.median(value).alias("m"))
    return robust.median_and_mad(each, KEY, "m", F.count("*").alias("n")).select(
        *KEY, F.col("median_value").alias(name), F.when(F.col("n") >= 2, F.col("mad_value")).alias(f"{name}_mad"), F.col("n").alias(f"{name}_n")
    )


def metrics(frames: DataFrame, sessions: DataFrame) -> DataFrame:
    """session_id, metric_code, status, reason_code, value, technical_quality_score and dispersion; seven rows for each session."""
    accepted, cut = segments(frames, sessions)
    accepted = materialize(accepted)
    cut = materialize(cut.drop("browser_processing", "quality_reasons")).join(accepted.select(*KEY, "segment_no", F.col("pitched_ms").alias("segment_pitched_ms")).hint(SHUFFLED), [*KEY, "segment_no"])
    whole, joint = rejoined(accepted, cut.drop("segment_pitched_ms"))
    runs, whole = materialize(run_events(joint)), materialize(whole)
    proof = evidence(accepted, cut)

    pitch = _two_level(cut.filter("pitched and segment_pitched_ms >= 1000"), "segment_no", "f0_hz", "f0")
    bins = pitch_bins(cut.filter("segment_pitched_ms >= 1000").drop("segment_pitched_ms"))
    centre = F.percentile("pitch", F.lit(0.5)).over(Window.partitionBy(*KEY, "segment_no"))
    varied = bins.withColumn("tone", S.semitones(F.col("pitch"), centre)).groupBy(*KEY, "segment_no").agg(
        F.count("*").alias("bins"), robust.population_sd("tone").alias("sd")
    ).filter(F.col("bins") >= MIN_PITCH_BINS)
    contributing = accepted.join(varied.select(*KEY, "segment_no"), [*KEY, "segment_no"])
    variability = _two_level(varied, "segment_no", "sd", "variability").join(
        evidence(contributing, cut.join(varied.select(*KEY, "segment_no"), [*KEY, "segment_no"])).select(
            *KEY, F.col("pitched_ms").alias("v_pitched_ms"), F.col("pitch_coverage").alias("v_coverage"), F.col("quality").alias("v_quality")
        ), KEY
    )
    pause = runs.filter("counted_pause").withColumn("s", F.col("duration_ms") / 1000)
    speech = runs.filter("active").withColumn("s", F.col("duration_ms") / 1000)
    pauses = pause.groupBy(*KEY).agg(F.count("*").alias("pauses"), robust.median("s").alias("pause_s")).join(_two_level(pause, "joint_no", "s", "pause_each"), KEY)
    speeches = speech.groupBy(*KEY).agg(F.count("*").alias("runs"), robust.median("s").alias("run_s")).join(_two_level(speech, "joint_no", "s", "run_each"), KEY)
    per_joint = whole.join(pause.groupBy(*KEY, "joint_no").agg(F.count("*").alias("k")), [*KEY, "joint_no"], "left").withColumn("rate", F.coalesce("k", F.lit(0)) / (F.col("duration_ms") / 60_000))
    rates = _two_level(per_joint, "joint_no", "rate", "rate_each")
    per_segment = accepted.withColumn("fraction", F.col("active_ms") / F.col("duration_ms")).withColumn("nucleus_rate", F.col("nuclei") / (F.col("active_ms") / 1000))
    fractions, nucleus = _two_level(per_segment, "segment_no", "fraction", "fraction_each"), _two_level(per_segment, "segment_no", "nucleus_rate", "nucleus_each")
    row = sessions.select("session_id", "noise_calibration_duration_ms").join(proof, KEY, "left")
    for more in (pitch, variability, pauses, speeches, rates, fractions, nucleus):
        row = row.join(more, KEY, "left")

    c, zero = F.col, F.lit(0)
    common = common_failure()
    pitch_failure = F.coalesce(common, F.when((F.coalesce("f0_n", zero) < MIN_SEGMENTS) | (c("pitched_ms") < PITCH_MIN_MS) | (c("pitch_coverage") < MIN_PITCH_COVERAGE), "insufficient-pitched-speech"))
    few_bins = F.coalesce("variability_n", zero) < MIN_SEGMENTS
    varied_failure = F.coalesce(
        pitch_failure, F.when(~few_bins & ((c("v_pitched_ms") < PITCH_MIN_MS) | (c("v_coverage") < MIN_PITCH_COVERAGE)), "insufficient-pitched-speech"),
        F.when(few_bins, "insufficient-pitch-bins")
    )
    few = lambda n, least, reason: F.coalesce(common, F.when(F.coalesce(n, zero) < least, reason))
    outcomes = [
        (METRICS[0], pitch_failure, c("f0"), c("f0_mad"), c("quality")),
        (METRICS[1], varied_failure, c("variability"), c("variability_mad"), c("v_quality")),
        (METRICS[2], common, c("active_ms") / c("eligible_ms"), c("fraction_each_mad"), c("quality")),
        (METRICS[3], common, F.coalesce("pauses", zero) / (c("eligible_ms") / 60_000), c("rate_each_mad"), c("quality")),
        (METRICS[4], few("pauses", MIN_EVENTS, "insufficient-events"), c("pause_s"), c("pause_each_mad"), c("quality")),
        (METRICS[5], few("runs", MIN_EVENTS, "insufficient-events"), c("run_s"), c("run_each_mad"), c("quality")),
        (METRICS[6], few("nuclei", MIN_NUCLEI, "insufficient-nuclei"), c("nuclei") / (c("active_ms") / 1000), c("nucleus_each_mad"), c("quality")),
    ]
    kept = lambda reason, x: F.when(reason.isNull(), x.cast("double"))
    each = [
        F.struct(
            F.lit(code).alias("metric_code"), F.when(reason.isNull(), "measured").otherwise("withheld").alias("status"), reason.alias("reason_code"),
            kept(reason, value).alias("value"), kept(reason, quality).alias("technical_quality_score"), kept(reason, spread).alias("dispersion")
        )
        for code, reason, value, spread, quality in outcomes
    ]
    return row.select("session_id", F.inline(F.array(*each)))


def screening(frames: DataFrame, sessions: DataFrame) -> DataFrame:
    """Counts by session: frames in range and ignored, usable, active, periodic."""
    ranged = in_range(frames, sessions).withColumn("failures", gates.voice_gate_failures())
    count = lambda c: F.sum((F.col("in_range") & c).cast("long"))
    return ranged.groupBy(*KEY).agg(
        count(F.lit(True)).alias("frames"), F.sum((~F.col("in_range")).cast("long")).alias("ignored"), count(F.size("failures") == 0).alias("usable"), count(F.coalesce("speech_active", F.lit(False))).alias("active"), count(F.coalesce("periodic", F.lit(False))).alias("periodic_frames")
    )


def gate_failure_counts(frames: DataFrame, sessions: DataFrame) -> DataFrame:
    """How many frames in range fail each gate; a frame can fail several."""
    ranged = in_range(frames, sessions).filter("in_range")
    return ranged.select("session_id", F.explode(gates.voice_gate_failures()).alias("reason")).groupBy("session_id", "reason").agg(F.count("*").alias("frames"))
