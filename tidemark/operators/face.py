"""Facial metrics of many sessions at once: resting pose, five-second bins, bin medians, blinks, expressions.

Frames follow sources.schemas.FACE_FRAMES; sessions need session_id, session_started_at_ms and
face_calibration. All windows are within a session.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources import registry
from ..sources.scratch import SHUFFLED, materialize
from . import detect, gates, robust, sessionize

# Fixed values of the face metrics.
MAX_CAPTURE_MS = 300_000
BIN_MS, MIN_BIN_DATA_MS, MIN_BIN_SPAN_MS, MIN_BIN_FRAMES, MAX_GAP_MS, MAX_SIZE_RATIO = 5_000, 4_000, 4_800, 80, 200, 1.15
MIN_BINS, MIN_SPAN_MS, CALIBRATION_MS = 3, 30_000, 1_500
DEFAULT_STEP_MS = 1000 / 30
BLINK_EXPOSURE_MS, BLINK_CADENCE_HZ, BLINK_P95_GAP_MS, MIN_EXPRESSIONS = 60_000, 24, 75, 3
LOW_BIN_SHARE = 0.25
#: Of each registered face metric, in their order: its kind, the name of its value, and the bins that it rests on.
_HOW = [
    ("bins", "eye_left", "base"),
    ("bins", "eye_right", "base"),
    ("bins", "eye_asymmetry", "base"),
    ("bins", "mouth_width", "base"),
    ("bins", "mouth_median", "base"),
    ("bins", "mouth_p90", "base"),
    ("bins", "corner_asymmetry", "base"),
    ("bins", "movement", "movement"),
    ("blinks", "blink_rate", "base"),
    ("expressions", "rest_corner", "base"),
    ("expressions", "rest_eye", "base"),
    ("expressions", "event_rate", "base"),
    ("expressions", "excursion_p90", "base"),
    ("expressions", "excursion_asymmetry", "base"),
    ("expressions", "coupling", "base"),
    ("bins", "brow_left", "brow_left"),
    ("bins", "brow_right", "brow_right"),
    ("bins", "brow_asymmetry", "brow_asymmetry"),
    ("bins", "closure_left", "lid_left"),
    ("bins", "closure_right", "lid_right"),
]
METRICS = [(code, *how) for code, how in zip(registry.codes("face"), _HOW, strict=True)]
#: Bins of their own frames: those that carry the value.
SPECIAL = ["movement", "brow_left", "brow_right", "brow_asymmetry"]

KEY = ["session_id"]
ORDER = ["t_ms", "sequence"]


def resting_pose(frames: DataFrame) -> DataFrame:
    """session_id and resting (yaw, pitch and roll medians over eligible frames); null where one is out of bounds or none is eligible."""
    axes = ["yaw_degrees", "pitch_degrees", "roll_degrees"]
    pose = F.col("pose")
    eligible = gates.resting_pose_usable() & S.finite(pose[axes[0]]) & S.finite(pose[axes[1]]) & S.finite(pose[axes[2]])
    medians = frames.groupBy(*KEY).agg(*[robust.median(F.when(eligible, pose[a])).alias(a) for a in axes])
    sound = F.lit(True)
    for a in axes:
        sound = sound & (F.abs(a) <= gates.MAX_RESTING[a])
    return medians.select(*KEY, F.when(sound, F.struct(*axes)).alias("resting"))


def in_range(frames: DataFrame, sessions: DataFrame) -> DataFrame:
    """The frames of the face task within a session's time, with session_started_at_ms, face_calibration and bin."""
    start = F.col("session_started_at_ms")
    timed = frames.join(
        sessions.select(*KEY, "session_started_at_ms", "face_calibration"), "session_id"
    ).filter(F.col("task_context").eqNullSafe(F.lit(gates.FACE_TASK)) & S.finite("t_ms") & (F.col("t_ms") >= start) & (F.col("t_ms") < start + MAX_CAPTURE_MS))
    return timed.withColumn("bin", F.floor((F.col("t_ms") - start) / float(BIN_MS)).cast("int"))


def gated(frames: DataFrame, sessions: DataFrame) -> DataFrame:
    """Frames in range with resting, failures, bin and usable (no failures). A session's frames come together here; bins need no further shuffle."""
    ranged = in_range(frames, sessions).repartition(*KEY)
    posed = ranged.join(resting_pose(ranged), "session_id", "left")
    calibration, resting = F.col("face_calibration"), F.col("resting")
    return posed.withColumns({"failures": gates.face_gate_failures(calibration, resting), "usable": gates.face_usable(calibration, resting)})


def _provenances() -> Column:
    """Aggregate: 1 where all rows share processor, track and epoch, 2 where they do not, 0 where none has all three."""
    own = F.struct("processor_ref", "track_segment_id", "capture_epoch")
    known = F.when(F.col("processor_ref").isNotNull() & F.col("track_segment_id").isNotNull() & F.col("capture_epoch").isNotNull(), own)
    return F.when(F.count(known) == 0, 0).when(F.min(known) == F.max(known), 1).otherwise(2)


def qualify(usable: DataFrame, keys: list[str]) -> DataFrame:
    """One row per bin of usable frames: counts, span, step, cadence, and the first reason that fails it (null if it qualifies)."""
    w = Window.partitionBy(*keys).orderBy(*ORDER)
    size = F.sqrt(F.col("bounding_box")["width_pixels"] * F.col("bounding_box")["height_pixels"])
    gap = F.col("gap_ms")
    grouped = (
        usable.withColumn("gap_ms", F.col("t_ms") - F.lag("t_ms").over(w)).withColumn("face_size", size).groupBy(*keys)
        .agg(F.count("*").alias("frames"), _provenances().alias("provenances"), F.min(gap).alias("least_gap_ms"), F.max(gap).alias("largest_gap_ms"), F.percentile(gap, F.lit(0.95)).alias("p95_gap_ms"),
             (F.max("t_ms") - F.min("t_ms")).alias("span_ms"), F.coalesce(robust.median(F.when((gap > 0) & (gap <= MAX_GAP_MS), gap)), F.lit(DEFAULT_STEP_MS)).alias("step_ms"),
             robust.percentile("face_size", 0.1).alias("size_p10"), robust.percentile("face_size", 0.9).alias("size_p90"), F.first("processor_ref").alias("processor_ref"), F.first("track_segment_id").alias("track_segment_id"), F.first("capture_epoch").alias("capture_epoch"))
        .withColumn("data_ms", F.least(F.lit(float(BIN_MS)), F.round(F.col("frames") * F.col("step_ms"), 3)))
    )
    reason = S.first_reason([
        (F.col("frames") < MIN_BIN_FRAMES, "too-few-usable-frames"), (F.col("provenances") != 1, "mixed-provenance"), (
            (F.col("least_gap_ms") <= 0) | (F.col("largest_gap_ms") > MAX_GAP_MS), "frame-gap"
        ),
        ((F.col("span_ms") < MIN_BIN_SPAN_MS) | (F.col("data_ms") < MIN_BIN_DATA_MS), "short-bin"), (
            ~S.finite("size_p10") | (F.col("size_p10") <= 0) | (F.col("size_p90") / F.col("size_p10") > MAX_SIZE_RATIO), "scale-drift"
        ),
    ])
    return grouped.withColumn("reason", reason).withColumn("cadence_hz", F.col("frames") / (F.col("data_ms") / 1000))


#: What a bin is summed up by: the name of a value and the percentile that is taken of it.
SHARES = {
    "eye_left": 0.9, "eye_right": 0.9, "eye_asymmetry": 0.5, "mouth_width": 0.5, "mouth_median": 0.5, "mouth_p90": 0.9, "corner_asymmetry": 0.5, "movement": 0.9, "brow_left": 0.5, "brow_right": 0.5, "brow_asymmetry": 0.5,
}


def _values() -> dict[str, Column]:
    """The values of SHARES of a frame; the movement of one that follows another in its bin."""
    eye, brow = F.col("eye_aperture"), F.col("brow_height")
    moves = (F.col("inter_result_gap_ms") > 0) & (F.col("inter_result_gap_ms") <= MAX_GAP_MS) & (F.col("regional_movement_speed") >= 0)
    return {
        "eye_left": eye["left"], "eye_right": eye["right"], "eye_asymmetry": F.abs(eye["left"] - eye["right"]), "mouth_width": gates.mouth_width(), "mouth_median": F.col("mouth_aperture_ratio"),
        "mouth_p90": F.col("mouth_aperture_ratio"), "corner_asymmetry": gates.mouth_corner_asymmetry(), "movement": F.when(moves, F.col("regional_movement_speed")),
        "brow_left": brow["left"], "brow_right": brow["right"], "brow_asymmetry": brow["left"] - brow["right"],
    }


def _summed_up(t: np.ndarray, sequence: np.ndarray, value: np.ndarray, step: float, share: float) -> tuple[float, float] | None:
    """(percentile by time, least value) of one bin's values in order; each weighs until the next one, the last one step."""
    known = np.isfinite(value)
    if not known.any():
        return None
    t, sequence, value = t[known], sequence[known], value[known]
    weight = np.append(np.maximum(np.diff(t), 0.0), step)
    order = np.lexsort((sequence, t, value))
    running = np.cumsum(weight[order])
    least = float(value[order[0]])
    if running[-1] > 0:
        return float(value[order[np.flatnonzero(running >= share * running[-1])[0]]]), least
    return float(np.percentile(value, 90 if share > 0.7 else 50)), least


def bin_values(frames: DataFrame, keys: list[str], names: tuple[str, ...] = tuple(SHARES)) -> DataFrame:
    """name, bin_value and least of each bin: the percentile by time, each value weighing until the next and the last one step; the least value.

    keys: the session first. A session's frames come together once, and all of its bins are summed up there; a session lasts five minutes.
    Bins of special variants stand for their own value, the others for all but these. names: the values that are asked for; no others are summed up.
    """
    shares = {n: SHARES[n] for n in names}
    inner, fields = keys[1:], {f.name: f.dataType.simpleString() for f in frames.schema.fields}
    wide = frames.select(*keys, *ORDER, F.col("step_ms").cast("double").alias("step_ms"), *[v.cast("double").alias(n) for n, v in _values().items() if n in shares])

    def fold(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values([*inner, *ORDER], kind="stable")
        t, sequence, step = (own[c].to_numpy() for c in (*ORDER, "step_ms"))
        columns, groups = {n: own[n].to_numpy(float, copy=True) for n in shares}, own[inner]
        starts = np.flatnonzero(np.append(True, (groups.to_numpy(object)[1:] != groups.to_numpy(object)[:-1]).any(axis=1)))
        if "movement" in columns:
            columns["movement"][starts] = np.nan
        out = []
        for low, high in zip(starts, [*starts[1:], len(own)], strict=True):
            place = tuple(groups.iloc[low])
            variant = place[inner.index("variant")] if "variant" in inner else None
            for name, share in shares.items():
                if variant is None or (name == variant if variant in SPECIAL else name not in SPECIAL):
                    found = _summed_up(t[low:high], sequence[low:high], columns[name][low:high], float(step[low]), share)
                    out += [(*key, *place, name, *found)] if found else []
        return pd.DataFrame(out, columns=[*keys, "name", "bin_value", "least"])

    return wide.groupBy(keys[0]).applyInPandas(fold, ", ".join(f"{k} {fields[k]}" for k in keys) + ", name string, bin_value double, least double")


def _carries(name: str) -> Column:
    brow = F.col("brow_height")
    moves = F.coalesce((F.col("inter_result_gap_ms") > 0) & (F.col("inter_result_gap_ms") <= MAX_GAP_MS) & (F.col("regional_movement_speed") >= 0), F.lit(False)) & S.finite("regional_movement_speed")
    return {"movement": moves, "brow_left": S.finite(brow["left"]), "brow_right": S.finite(brow["right"]), "brow_asymmetry": S.finite(brow["left"]) & S.finite(brow["right"])}[name]


def accepted_frames(frames: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bins that qualify, their frames): usable frames only."""
    usable = gated(frames, sessions).filter("usable")
    bins = qualify(usable, [*KEY, "bin"]).filter("reason is null")
    return bins, usable.join(bins.select(*KEY, "bin", "step_ms").hint(SHUFFLED), [*KEY, "bin"])


def _with_variants(base: DataFrame) -> DataFrame:
    """Frames of base bins, once for each variant whose bins they may make up."""
    variants = F.array_compact(F.array(F.lit("base"), *[F.when(_carries(name), F.lit(name)) for name in SPECIAL]))
    return base.drop("step_ms").withColumn("variant", F.explode(variants))


def bins_and_frames(frames: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bins, their frames, their values) by session_id, variant and bin. Bins of special variants qualify by their own frames alone.

    lid_left and lid_right are the base bins in which that eye is seen open. Tables are written in the shared folder.
    """
    key = [*KEY, "variant", "bin"]
    usable = materialize(gated(frames, sessions).filter("usable"))
    base = usable.join(qualify(usable, [*KEY, "bin"]).filter("reason is null").select(*KEY, "bin").hint(SHUFFLED), [*KEY, "bin"])
    candidates = _with_variants(base)
    bins = materialize(qualify(candidates, key).filter("reason is null"))
    kept = materialize(candidates.join(bins.select(*key, "step_ms").hint(SHUFFLED), key))
    values = materialize(bin_values(kept, key))
    seen_open = values.filter("variant = 'base' and name in ('eye_left', 'eye_right') and bin_value > 0").select(*KEY, "bin", F.replace("name", F.lit("eye"), F.lit("lid")).alias("variant"))
    of_lids = lambda df: df.filter("variant = 'base'").drop("variant").join(seen_open.hint(SHUFFLED), [*KEY, "bin"])
    return bins.unionByName(of_lids(bins)), kept.unionByName(of_lids(kept)), values


def evidence(bins: DataFrame, kept: DataFrame) -> DataFrame:
    """What a metric rests on, by session_id and variant: amounts, the worst bin for each gate, sources, and quality in 0 to 1."""
    by = [*KEY, "variant"]
    start = F.first("session_started_at_ms")
    size = F.col("size_p90") / F.col("size_p10")
    steady = S.clamp01(1 - (size - 1) / (MAX_SIZE_RATIO - 1))
    source = F.struct("capture_epoch", "track_segment_id")
    started = kept.groupBy(*by, "bin").agg(start.alias("started"))
    low = (F.col("started") + F.col("bin") * BIN_MS).cast("long")
    ref = S.window_ref("face", "capture_epoch", "track_segment_id", low, low + BIN_MS)
    each = bins.join(started.hint(SHUFFLED), [*by, "bin"]).withColumns({"window": F.struct("bin", ref.alias("ref")), "steady": steady})
    of_bins = each.groupBy(*by).agg(
        F.count("*").alias("bins"), F.sum("data_ms").alias("eligible_ms"), F.sum("frames").alias("samples"), F.size(F.collect_set(source)).alias("segments"),
        ((F.max("bin") - F.min("bin") + 1) * float(BIN_MS)).alias("span_ms"), F.min("cadence_hz").alias("least_cadence_hz"), F.min("data_ms").alias("least_data_ms"), F.min("frames").alias("least_frames"), F.min("span_ms").alias("least_span_ms"),
        F.coalesce(F.max("largest_gap_ms"), F.lit(0.0)).alias("largest_gap_ms"), F.array_sort(F.collect_set("processor_ref")).alias("processor_refs"), F.array_sort(F.collect_set("track_segment_id")).alias("track_segment_ids"),
        F.transform(F.array_sort(F.collect_list("window")), lambda w: w["ref"]).alias("window_refs"), robust.median("cadence_hz").alias("cadence"), robust.median(F.col("data_ms") / BIN_MS).alias("coverage"), robust.median("steady").alias("steadiness"),
    )
    pose, rest = F.col("pose"), F.col("resting")
    turned = F.greatest(*[
        F.abs(pose[c] - F.coalesce(rest[c], F.lit(0.0))) / most for c,
        most in (("yaw_degrees", gates.MAX_YAW), ("pitch_degrees", gates.MAX_PITCH), ("roll_degrees", gates.MAX_ROLL))
    ])
    gap = F.col("t_ms") - F.lag("t_ms").over(Window.partitionBy(*by, "bin").orderBy(*ORDER))
    of_frames = kept.withColumn("gap_ms", gap).groupBy(*by).agg(robust.percentile("gap_ms", 0.95).alias("p95_gap_ms"), robust.median(S.clamp01(1 - turned)).alias("frontal"))
    quality = S.clamp01(0.3 * S.clamp01(F.col("cadence") / 30) + 0.3 * S.clamp01("coverage") + 0.2 * F.col("steadiness") + 0.2 * F.col("frontal"))
    return of_bins.join(of_frames.hint(SHUFFLED), by).withColumn("quality", quality).drop("cadence", "coverage", "steadiness", "frontal")


def _blink_rates(bins: DataFrame, base: DataFrame) -> DataFrame:
    """Bilateral blinks a minute of exposure, their number, and the spread of the bins' rates."""
    pairs = bilateral_blinks(blinks(base, KEY), KEY).groupBy(*KEY, "bin").agg(F.count("*").alias("pairs"))
    each = bins.select(*KEY, "bin", "data_ms").join(pairs.hint(SHUFFLED), [*KEY, "bin"], "left").withColumn("pairs", F.coalesce("pairs", F.lit(0)))
    rates = each.withColumn("rate", F.col("pairs") / (BIN_MS / 60_000))
    whole = robust.median_and_mad(rates, KEY, "rate", F.sum("pairs").alias("blinks"), F.sum("data_ms").alias("exposure_ms"), F.count("*").alias("n"))
    return whole.select(*KEY, F.col("blinks").cast("long"), (F.col("blinks") / (F.col("exposure_ms") / 60_000)).alias("value"), F.when(F.col("n") >= 2, F.col("mad_value")).alias("dispersion"))


def _expression_values(base: DataFrame, exposure: DataFrame) -> DataFrame:
    """name, value and dispersion of the six expression metrics, with events and couplings."""
    m, eye = F.col("mouth_corners"), F.col("eye_aperture")
    usable = base.filter(gates.expression_usable())
    rest = usable.groupBy(*KEY).agg(
        (robust.median(m["right"]["y"]) - robust.median(m["left"]["y"])).alias("rest_corner"),
        (robust.median(F.when(S.finite(eye["left"]), eye["left"])) - robust.median(F.when(S.finite(eye["right"]), eye["right"]))).alias("rest_eye")
    )
    e = expressions(base, KEY).withColumns({"asymmetry": detect.excursion_asymmetry(), "coupling": detect.coupling_difference(), "excursion": F.greatest("peak_left", "peak_right")})
    middle = lambda c: F.percentile(c, F.lit(0.5)).over(Window.partitionBy(*KEY))
    spread = lambda c: F.when(F.count(c) >= 2, robust.median(F.abs(F.col(c) - F.col(f"middle_{c}"))))
    shaped = e.withColumns({"middle_asymmetry": middle("asymmetry"), "middle_coupling": middle("coupling")}).groupBy(*KEY).agg(
        F.count("*").alias("events"), F.count("coupling").alias("couplings"), robust.percentile("excursion", 0.9).alias("excursion_p90"), robust.median("asymmetry").alias("excursion_asymmetry"), robust.median("coupling").alias("coupling"),
        spread("asymmetry").alias("spread_asymmetry"), spread("coupling").alias("spread_coupling"),
    )
    joined = rest.join(exposure, KEY).join(shaped, KEY, "left").fillna(0, ["events", "couplings"])
    rate = F.when(F.col("eligible_ms") > 0, F.col("events") / (F.col("eligible_ms") / 60_000))
    none = F.lit(None).cast("double")
    named = [
        ("rest_corner", F.col("rest_corner"), none), ("rest_eye", F.col("rest_eye"), none), ("event_rate", rate, none),
        ("excursion_p90", F.col("excursion_p90"), none), ("excursion_asymmetry", F.col("excursion_asymmetry"), F.col("spread_asymmetry")),
        ("coupling", F.col("coupling"), F.col("spread_coupling"))
    ]
    return joined.select(*KEY, "events", "couplings", F.inline(F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value"), d.alias("dispersion")) for n, v, d in named])))


def metrics(frames: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row per session and registered metric, measured or withheld with a reason: value, dispersion, quality (if measured) and evidence.

    Tables are written in the shared folder while the result is being planned.
    """
    bins, kept, values = bins_and_frames(frames, sessions)
    proof = materialize(evidence(bins, kept)).hint(SHUFFLED)
    base, base_bins = kept.filter("variant = 'base'"), bins.filter("variant = 'base'")
    binned = robust.median_and_mad(values, [*KEY, "name"], "bin_value", F.count("*").alias("n"))
    lids = values.filter("variant = 'base' and name in ('eye_left', 'eye_right') and bin_value > 0").groupBy(*KEY, "name").agg(
        robust.median("bin_value").alias("open"), robust.percentile("least", LOW_BIN_SHARE).alias("shut")
    )
    none = F.lit(None).cast("double")
    found = (
        binned.select(*KEY, "name", F.col("median_value").alias("value"), F.when(F.col("n") >= 2, F.col("mad_value")).alias("dispersion"))
        .unionByName(lids.select(*KEY, F.replace("name", F.lit("eye"), F.lit("closure")).alias("name"), S.clamp01(1 - F.col("shut") / F.col("open")).alias("value"), none.alias("dispersion")))
    )
    blinking = _blink_rates(base_bins, base).withColumn("name", F.lit("blink_rate"))
    expressive = _expression_values(base, proof.filter("variant = 'base'").select(*KEY, "eligible_ms"))
    found = found.unionByName(blinking, allowMissingColumns=True).unionByName(expressive, allowMissingColumns=True)
    whole = base_bins.groupBy(*KEY).agg(
        F.count("*").alias("base_bins"), F.size(F.collect_set("processor_ref")).alias("processors"),
        F.size(F.collect_set(F.struct("capture_epoch", "track_segment_id"))).alias("tracks"), (F.max("bin") - F.min("bin") + 1).alias("base_span")
    )
    ranged = in_range(frames, sessions).groupBy(*KEY).agg(
        F.sum((F.coalesce("face_count", F.lit(0)) > 1).cast("long")).alias("several_faces"), F.min("t_ms").alias("observed_start_ms"),
        F.max("t_ms").alias("observed_end_ms")
    )
    listed = F.array(*[
        F.struct(F.lit(k).alias("metric_no"), F.lit(code).alias("metric_code"), F.lit(kind).alias("kind"), F.lit(name).alias("name"), F.lit(variant).alias("variant")) for k,
        (code, kind, name, variant) in enumerate(METRICS)
    ])
    every = sessions.select(*KEY, "face_calibration", F.inline(listed))
    rows = every.join(ranged, KEY, "left").join(whole, KEY, "left").join(proof, [*KEY, "variant"], "left").join(found, [*KEY, "name"], "left")
    calibration = F.col("face_calibration")
    calibrated = (calibration["duration_ms"] >= CALIBRATION_MS) & (calibration["baseline_box_width_pixels"] > 0) & (calibration["baseline_box_height_pixels"] > 0)
    is_kind = lambda k: F.col("kind") == k
    few_events = F.col("name").isin("excursion_p90", "excursion_asymmetry", "coupling") & (F.coalesce("events", F.lit(0)) < MIN_EXPRESSIONS)
    few_couplings = (F.col("name") == "coupling") & (F.coalesce("couplings", F.lit(0)) < MIN_EXPRESSIONS)
    reason = S.first_reason([
        (~F.coalesce(calibrated, F.lit(False)), "quality-threshold-failed"), (
            F.col("base_bins").isNull() & (F.col("several_faces") > 0), "multiple-faces"
        ), (F.col("base_bins").isNull(), "no-usable-signal"),
        (
            (F.col("processors") > 1) | (F.col("tracks") > 1), "quality-threshold-failed"
        ), (F.col("base_bins") < MIN_BINS, "insufficient-bins"), (F.col("base_span") * BIN_MS < MIN_SPAN_MS, "insufficient-duration"),
        (is_kind("bins") & (F.coalesce("bins", F.lit(0)) < MIN_BINS), "insufficient-bins"), (is_kind("bins") & (F.col("span_ms") < MIN_SPAN_MS), "insufficient-duration"),
        (is_kind("blinks") & (F.col("eligible_ms") < BLINK_EXPOSURE_MS), "insufficient-exposure"), (is_kind("blinks") & (F.col("least_cadence_hz") < BLINK_CADENCE_HZ), "insufficient-frame-cadence"),
        (is_kind("blinks") & (F.col("p95_gap_ms") > BLINK_P95_GAP_MS), "quality-threshold-failed"), (few_events | few_couplings, "insufficient-events"), (~S.finite("value"), "no-usable-signal"),
    ])
    measured = reason.isNull()
    amounts = ["bins", "samples", "segments"]
    return rows.select(
        "session_id", "metric_no", "metric_code", F.when(measured, "measured").otherwise("withheld").alias("status"), reason.alias("reason_code"), F.when(measured, F.col("value")).alias("value"), F.when(measured, F.col("dispersion")).alias("dispersion"),
        F.when(measured, F.col("quality")).alias("quality"), "observed_start_ms", "observed_end_ms", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in amounts], *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("eligible_ms", "span_ms")],
        "least_cadence_hz", "least_data_ms", "least_frames", "least_span_ms", "p95_gap_ms", "largest_gap_ms", "processor_refs", "track_segment_ids", "window_refs", F.when(is_kind("blinks"), F.col("blinks")).alias("blink_count"),
        F.when(is_kind("expressions"), F.col("events")).alias("expression_count"), F.when(is_kind("expressions"), F.col("couplings")).alias("coupled_count"),
    )


def diagnostics(frames: DataFrame, sessions: DataFrame) -> DataFrame:
    """Of each session: frames, usable frames, medians and 95th percentiles of the pose angles' sizes, bins considered and accepted, and bins rejected by reason."""
    marked = materialize(gated(frames, sessions))
    pose = F.col("pose")
    sizes = [(f"{axis}_p{round(100 * p)}", F.percentile(F.abs(pose[f"{axis}_degrees"]), F.lit(p))) for axis in ("yaw", "pitch", "roll") for p in (0.5, 0.95)]
    whole = marked.groupBy(*KEY).agg(
        F.count("*").alias("frames"), F.sum(F.col("usable").cast("long")).alias("usable_frames"),
        F.size(F.collect_set("bin")).cast("long").alias("bins_considered"), *[c.alias(n) for n, c in sizes]
    )
    judged = qualify(marked.filter("usable"), [*KEY, "bin"])
    every = marked.select(*KEY, "bin").distinct().join(judged.hint(SHUFFLED), [*KEY, "bin"], "left").withColumn("reason", F.when(F.col("frames").isNull(), "too-few-usable-frames").otherwise(F.col("reason")))
    counted = every.groupBy(*KEY, "reason").agg(F.count("*").alias("n"))
    rejected = F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("reason", "n"))))
    return whole.join(counted.groupBy(*KEY).agg(F.coalesce(F.sum(F.when(F.col("reason").isNull(), F.col("n"))), F.lit(0)).alias("bins_accepted"), rejected.alias("bin_rejections")), KEY)


#: Shares of usable frames that the acceptance curve asks about.
CURVE_SHARES = (1.0, 0.98, 0.95, 0.9, 0.85, 0.8)


def acceptance_curve(frames: DataFrame, sessions: DataFrame, shares: tuple[float, ...] = CURVE_SHARES) -> DataFrame:
    """For each share of usable frames that a bin might be asked for: bins of each session that would pass, and those that too few frames, a gap or a short span would lose."""
    usable = F.col("usable")
    w = Window.partitionBy(*KEY, "bin", usable).orderBy(*ORDER)
    stepped = gated(frames, sessions).withColumn("gap_ms", F.when(usable, F.col("t_ms") - F.lag("t_ms").over(w)))
    at = F.when(usable, F.col("t_ms"))
    each = stepped.groupBy(*KEY, "bin").agg(
        F.avg(usable.cast("double")).alias("share"), F.sum(usable.cast("long")).alias("n"), F.coalesce(F.max("gap_ms"), F.lit(0.0)).alias("gap"),
        F.coalesce(F.max(at) - F.min(at), F.lit(0.0)).alias("span")
    )
    lost = S.first_reason([(F.col("n") < MIN_BIN_FRAMES, "samples"), (F.col("gap") > MAX_GAP_MS, "gap"), (F.col("span") < MIN_BIN_SPAN_MS, "span")], F.lit("bins"))
    asked = each.withColumn("lost", lost).withColumn("asked", F.explode(F.array(*[F.lit(x) for x in shares])))
    count = lambda what: F.sum(((F.col("lost") == what) & (F.col("share") >= F.col("asked"))).cast("long"))
    return asked.groupBy(*KEY, "asked").agg(
        count("bins").alias("bins"), count("samples").alias("lost_to_samples"), count("gap").alias("lost_to_gap"), count("span").alias("lost_to_span"),
        F.count("*").alias("of_bins")
    )


def gate_failure_counts(frames: DataFrame, sessions: DataFrame) -> DataFrame:
    return gated(frames, sessions).select("session_id", F.explode("failures").alias("reason")).groupBy("session_id", "reason").agg(F.count("*").alias("frames"))


def blinks(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Blinks of each eye, over frames with bin; keys name the stream. The open eye's reference is the 90th percentile of its apertures in the group."""
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col("eye_aperture")[s].alias("aperture")) for s in ("left", "right")])
    long = frames.select(*keys, "t_ms", "sequence", "bin", F.inline(sides))
    referred = long.withColumn("reference", F.percentile("aperture", F.lit(0.9)).over(Window.partitionBy(*keys, "side")))
    return detect.by_group(referred, [*keys, "side"], ORDER, detect.blink_fold, detect.BLINK_SCHEMA)


def bilateral_blinks(events: DataFrame, keys: list[str]) -> DataFrame:
    """Each left blink with the first right one, not yet taken, that overlaps it."""
    return detect.by_group(events, keys, ["peak_ms"], detect.pair_fold, detect.PAIR_SCHEMA)


def event_streams(frames: DataFrame, sessions: DataFrame) -> DataFrame:
    """Frames fit for events, with stream_no: a new one where provenance changes or time does not ascend."""
    ranged = gated(frames, sessions).filter(gates.event_usable())
    back = F.col("t_ms") <= F.lag("t_ms").over(Window.partitionBy(*KEY).orderBy(*ORDER))
    return sessionize.islands(ranged, KEY, ORDER, back | sessionize.changes(KEY, ORDER, "capture_epoch", "processor_ref", "track_segment_id"), "stream_no")


def within_pose(events: DataFrame, frames: DataFrame, start: str, end: str, event_keys: list[str]) -> DataFrame:
    """Events with pose_within_limits: there are frames from start to end, and none fails a pose gate. Joined by session and second, not by a bare range."""
    posed = frames.select(*KEY, "t_ms", F.floor(F.col("t_ms") / 1000).alias("second"), F.arrays_overlap("failures", F.array(*[F.lit(x) for x in ("yaw", "pitch", "roll")])).alias("off"))
    seconds = events.withColumn("second", F.explode(F.sequence(F.floor(F.col(start) / 1000), F.floor(F.col(end) / 1000))))
    spanning = seconds.join(posed, [*KEY, "second"]).filter((F.col("t_ms") >= F.col(start)) & (F.col("t_ms") <= F.col(end)))
    judged = spanning.groupBy(*event_keys).agg((~F.max("off")).alias("pose_within_limits"))
    return events.join(judged, event_keys, "left").withColumn("pose_within_limits", F.coalesce("pose_within_limits", F.lit(False)))


def expressions(streams: DataFrame, keys: list[str]) -> DataFrame:
    """Expression events over streams of frames, against each stream's own resting medians."""
    m, eye, own = F.col("mouth_corners"), F.col("eye_aperture"), Window.partitionBy(*keys)
    flat = streams.filter(gates.expression_usable()).select(
        *keys, *ORDER, m["left"]["y"].alias("left_y"), m["right"]["y"].alias("right_y"), eye["left"].alias("left_eye"), eye["right"].alias("right_eye")
    )
    rested = flat.withColumns({f"rest_{c}": F.percentile(c, F.lit(0.5)).over(own) for c in ("left_y", "right_y", "left_eye", "right_eye")})
    return detect.by_group(rested, keys, ORDER, detect.expression_fold, detect.EXPRESSION_SCHEMA)


def expression_summary(events: DataFrame, exposure: DataFrame) -> DataFrame:
    """By session, exposure giving eligible_ms: events and rate a minute (0 is measured), P90 excursion, median asymmetry and coupling (null for fewer than three)."""
    e = events.withColumn("asymmetry", detect.excursion_asymmetry()).withColumn("coupling", detect.coupling_difference()).withColumn("excursion", F.greatest("peak_left", "peak_right"))
    grouped = e.groupBy(*KEY).agg(
        F.count("*").alias("events"), robust.percentile("excursion", 0.9).alias("excursion_p90"), robust.median("asymmetry").alias("asymmetry"),
        F.count("coupling").alias("couplings"), robust.median("coupling").alias("coupling")
    )
    joined = exposure.join(grouped, KEY, "left").withColumn("events", F.coalesce("events", F.lit(0)))
    enough = F.col("events") >= MIN_EXPRESSIONS
    return joined.select(
        *KEY, "events", F.when(F.col("eligible_ms") > 0, F.col("events") / (F.col("eligible_ms") / 60_000)).alias("rate"),
        F.when(enough, F.col("excursion_p90")).alias("excursion_p90"), F.when(enough, F.col("asymmetry")).alias("asymmetry"),
        F.when(F.col("couplings") >= MIN_EXPRESSIONS, F.col("coupling")).alias("coupling")
    )


# Calibration of a face before and during capture.

#: A strong calibration's length in ms, share of usable frames, and analysed frames a second.
STRONG_MS, STRONG_SHARE, STRONG_HZ = 1_500, 0.8, 20


def calibration(frames: DataFrame) -> DataFrame:
    """Of each session's latest capture epoch: duration_ms, frames, usable frames and share, frame rate, median baselines, and calibration strong, limited or unavailable.

    Baselines are medians over usable frames, or over all that show a whole face where none is usable.
    """
    c = F.col
    timed = frames.filter(S.finite("acquired_at_ms") & (c("acquired_at_ms") >= 0))
    latest = timed.withColumn("newest", F.max("capture_epoch").over(Window.partitionBy(*KEY))).filter("capture_epoch = newest")
    seen = F.coalesce(c("face_visible"), F.lit(False)) & c("bounding_box").isNotNull() & c("pose").isNotNull() & c("eye_aperture").isNotNull() & c("mouth_corners").isNotNull()
    marked = latest.withColumns({"usable": F.size(gates.visual_quality_reasons()) == 0, "seen": seen})
    marked = marked.withColumn("any_usable", F.max("usable").over(Window.partitionBy(*KEY))).withColumn("based", F.when(c("any_usable"), c("usable")).otherwise(c("seen")))
    box, image = c("bounding_box"), c("image_quality")
    base = lambda x: robust.median(F.when(c("based"), x))
    grouped = marked.groupBy(*KEY).agg(
        (F.max("acquired_at_ms") - F.min("acquired_at_ms")).alias("duration_ms"), F.count("*").alias("frames"), robust.median("analyzed_frame_rate").alias("told_rate"), F.sum(c("usable").cast("long")).alias("usable_frames"), F.max("based").alias("based"), base(box["width_pixels"]).alias("baseline_box_width_pixels"), base(box["height_pixels"]).alias("baseline_box_height_pixels"),
        base(image["illumination_mean"]).alias("baseline_illumination"), base(image["sharpness"]).alias("baseline_sharpness"),
    )
    rated = grouped.withColumns({"usable_share": c("usable_frames") / c("frames"), "frame_rate": F.when(c("duration_ms") > 0, (c("frames") - 1) / (c("duration_ms") / 1000)).otherwise(c("told_rate"))})
    strong = (c("duration_ms") >= STRONG_MS) & (c("usable_share") >= STRONG_SHARE) & (c("frame_rate") >= STRONG_HZ)
    return rated.withColumn("calibration", F.when(~c("based"), "unavailable").when(strong, "strong").otherwise("limited")).drop("based", "told_rate")


def calibrated(frames: DataFrame, calibrations: DataFrame) -> DataFrame:
    """Frames with calibrated_reasons (a sharpness below half the calibrated one is blur too), usable and guidance."""
    joined = frames.join(calibrations.select(*KEY, "baseline_sharpness"), KEY, "left")
    reasons = gates.visual_quality_reasons(gates.sharpness_floor(F.col("baseline_sharpness")))
    marked = joined.withColumn("calibrated_reasons", reasons)
    return marked.withColumns({"usable": F.size("calibrated_reasons") == 0, "guidance": gates.guidance(F.col("calibrated_reasons"))}).drop("baseline_sharpness")
