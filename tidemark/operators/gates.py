"""Frame gates: why a frame cannot be used, as ordered reason codes; predicates derived from them.

All functions give columns over frames of the schemas in sources.schemas.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import scalars as S

# Fixed values of the voice gates.
VOICE_TASK = "ambient-speech-turn"
MIN_SAMPLE_RATE_HZ = 44_100
MAX_BLOCK_GAP_MS = 40
MAX_LOST_BLOCK_FRACTION = 0.05
MAX_CLIPPED_FRACTION = 0.01
MAX_DC_OFFSET = 0.02
MIN_SPEECH_SNR_DB = 15
FINE_SNR_DB = 20
MIN_SIGNAL_RMS = 0.003
MIN_F0_HZ, MAX_F0_HZ = 50, 700
MIN_PITCH_CONFIDENCE, MIN_PITCH_AGREEMENT = 0.55, 0.7
VOICE_BLOCKING = ["microphone-unavailable", "audio-worklet-unavailable", "audio-frame-gap", "sample-rate-below-minimum", "audio-clipping", "dc-offset", "voice-worker-unavailable", "document-hidden"]
TIMING_BLOCKERS = ["microphone-unavailable", "audio-worklet-unavailable", "audio-frame-gap", "signal-too-quiet", "audio-clipping", "voice-worker-unavailable"]
GENERAL_BLOCKERS = [*TIMING_BLOCKERS, "snr-below-minimum", "dc-offset"]
FINE_BLOCKERS = [*GENERAL_BLOCKERS, "sample-rate-below-minimum", "audio-processing-enabled"]

# Fixed values of the face gates.
FACE_TASK = "ambient-frontal"
VISUAL_ORDER = [
    "document-hidden", "camera-unavailable", "worker-unavailable", "face-not-visible", "face-too-small", "face-too-large", "face-edge-margin", "pose-out-of-range",
    "illumination-out-of-range", "blur", "frame-rate-below-minimum", "visual-frame-gap", "too-many-skipped-frames",
]
MAX_YAW, MAX_PITCH, MAX_ROLL = 7, 10, 5
MAX_RESTING = {"yaw_degrees": 10, "pitch_degrees": 20, "roll_degrees": 15}
MAX_FACE_GAP_MS = 200
SIZE_TOLERANCE = 0.2


def _listed(reasons: Column, names: list[str]) -> Column:
    return F.array_intersect(F.coalesce(reasons, F.array().cast("array<string>")), F.array(*[F.lit(x) for x in names]))


def _bad(c: str, over: Column) -> Column:
    """Not finite, or over the limit."""
    return ~S.finite(c) | F.coalesce(over, F.lit(True))


def voice_gate_failures() -> Column:
    """Every gate that a voice frame fails, in order; empty for a usable one."""
    c = F.col
    snr = S.finite("snr_db")
    own = S.reasons([
        (~c("task_context").eqNullSafe(F.lit(VOICE_TASK)), "task-context"),
        (F.coalesce(F.length("track_segment_id"), F.lit(0)) == 0, "no-track-id"),
        (~S.finite("t_ms"), "no-timestamp"),
        (_bad("sample_rate_hz", c("sample_rate_hz") < MIN_SAMPLE_RATE_HZ), "sample-rate"),
        (_bad("block_gap_ms", c("block_gap_ms") > MAX_BLOCK_GAP_MS), "block-gap"),
        (_bad("lost_block_fraction", c("lost_block_fraction") > MAX_LOST_BLOCK_FRACTION), "lost-blocks"),
        (_bad("clipped_sample_fraction", c("clipped_sample_fraction") > MAX_CLIPPED_FRACTION), "clipping"),
        (_bad("dc_offset", F.abs("dc_offset") > MAX_DC_OFFSET), "dc-offset"),
        (~snr, "non-finite-snr"),
        (snr & c("speech_active") & (c("snr_db") < MIN_SPEECH_SNR_DB), "speech-snr-pitch-only"),
    ])
    return F.concat(own, F.transform(_listed(c("quality_reasons"), VOICE_BLOCKING), lambda r: F.concat(F.lit("quality:"), r)))


def voice_timing_usable() -> Column:
    """Usable for timing: every gate but the floor on speech SNR, and both flags known."""
    hard = F.filter(voice_gate_failures(), lambda r: r != "speech-snr-pitch-only")
    return (F.size(hard) == 0) & F.col("speech_active").isNotNull() & F.col("periodic").isNotNull()


def valid_pitch() -> Column:
    c = F.col
    good = c("speech_active") & c("periodic") & c("f0_hz").between(MIN_F0_HZ, MAX_F0_HZ) & (c("f0_confidence") >= MIN_PITCH_CONFIDENCE) & (c("estimator_agreement") >= MIN_PITCH_AGREEMENT) & (c("snr_db") >= MIN_SPEECH_SNR_DB)
    return F.coalesce(good, F.lit(False)) & S.finite("f0_confidence") & S.finite("estimator_agreement") & S.finite("snr_db")


def browser_processing_enabled() -> Column:
    b = F.col("browser_processing")
    return F.coalesce(b["echo_cancellation"] | b["noise_suppression"] | b["auto_gain_control"], F.lit(False))


def voice_quality_reasons() -> Column:
    c = F.col
    own = S.reasons([
        ((c("block_gap_ms") > MAX_BLOCK_GAP_MS) | (c("lost_block_fraction") > MAX_LOST_BLOCK_FRACTION), "audio-frame-gap"), (c("sample_rate_hz") < MIN_SAMPLE_RATE_HZ, "sample-rate-below-minimum"),
        (browser_processing_enabled(), "audio-processing-enabled"), (c("snr_db") < MIN_SPEECH_SNR_DB, "snr-below-minimum"), (c("rms") < MIN_SIGNAL_RMS, "signal-too-quiet"),
        (c("clipped_sample_fraction") > MAX_CLIPPED_FRACTION, "audio-clipping"), (F.abs("dc_offset") > MAX_DC_OFFSET, "dc-offset"),
    ])
    return F.array_distinct(F.concat(F.coalesce(c("quality_reasons"), F.array().cast("array<string>")), own))


def voice_quality_tiers() -> dict[str, Column]:
    """timing_usable, general_usable and fine_usable."""
    reasons = voice_quality_reasons()
    free = lambda names: F.size(_listed(reasons, names)) == 0
    return {"timing_usable": free(TIMING_BLOCKERS), "general_usable": free(GENERAL_BLOCKERS), "fine_usable": S.finite("snr_db") & F.coalesce(F.col("snr_db") >= FINE_SNR_DB, F.lit(False)) & free(FINE_BLOCKERS)}


def acquisition_usable(min_rms: float = 1e-4, max_gap_ms: float = MAX_BLOCK_GAP_MS) -> Column:
    """Usable for calibrating passive noise: all measures known and in range, nothing lost or clipped, no browser processing."""
    c, b = F.col, F.col("browser_processing")
    known = F.lit(True)
    for name in (
        "acquired_at_ms", "rms", "f0_confidence", "estimator_agreement", "spectral_flux", "cepstral_peak_prominence_db", "clipped_sample_fraction", "dc_offset",
        "block_gap_ms", "lost_block_fraction", "sample_rate_hz"
    ):
        known = known & S.finite(name)
    sound = (
        (c("sample_rate_hz") >= 16_000) & c("rms").between(min_rms, 1) & c("f0_confidence").between(0, 1) & c("estimator_agreement").between(0, 1) & (c("spectral_flux") >= 0)
        & (c("clipped_sample_fraction") == 0) & (F.abs("dc_offset") <= 0.005) & c("block_gap_ms").between(0, max_gap_ms) & (c("lost_block_fraction") == 0)
        & (c("processor_ref") != "") & (c("track_segment_id") != "") & ~b["echo_cancellation"] & ~b["noise_suppression"] & ~b["auto_gain_control"]
    )
    return known & F.coalesce(sound, F.lit(False))


class VisualPolicy:
    """Thresholds of visual quality."""

    min_width_pixels, min_height_pixels = 180, 220
    max_width_fraction, max_height_fraction = 0.7, 0.9
    min_edge_margin = 0.02
    max_yaw, max_pitch, max_roll = 15, 15, 10
    illumination = (0.12, 0.9)
    max_dark_clipping, max_bright_clipping = 0.2, 0.2
    min_sharpness, sharpness_fraction = 0.0008, 0.5
    min_frame_rate = 20
    max_frame_gap_ms = 200
    max_skipped_fraction = 0.25


def sharpness_floor(baseline_sharpness: Column | None = None, policy: type[VisualPolicy] = VisualPolicy) -> Column:
    least = F.lit(float(policy.min_sharpness))
    return least if baseline_sharpness is None else F.greatest(least, F.coalesce(baseline_sharpness, F.lit(0.0)) * policy.sharpness_fraction)


def _visual_checks(floor: Column | None, policy: type[VisualPolicy]) -> list[tuple[Column, str]]:
    c, box, pose, image = F.col, F.col("bounding_box"), F.col("pose"), F.col("image_quality")
    floor = sharpness_floor(None, policy) if floor is None else floor
    seen = F.coalesce(c("face_visible"), F.lit(False)) & box.isNotNull() & pose.isNotNull() & c("eye_aperture").isNotNull() & c("mouth_corners").isNotNull()
    bad = lambda value, over: ~S.finite(value) | F.coalesce(over, F.lit(True))
    beyond = lambda axis, limit: bad(pose[axis], F.abs(pose[axis]) > limit)
    light = image["illumination_mean"]
    return [
        (~seen, "face-not-visible"),
        (seen & (bad(box["width_pixels"], box["width_pixels"] < policy.min_width_pixels) | bad(box["height_pixels"], box["height_pixels"] < policy.min_height_pixels)), "face-too-small"),
        (seen & (bad(box["width"], box["width"] > policy.max_width_fraction) | bad(box["height"], box["height"] > policy.max_height_fraction)), "face-too-large"),
        (seen & bad(box["edge_margin_fraction"], box["edge_margin_fraction"] < policy.min_edge_margin), "face-edge-margin"),
        (seen & (beyond("yaw_degrees", policy.max_yaw) | beyond("pitch_degrees", policy.max_pitch) | beyond("roll_degrees", policy.max_roll)), "pose-out-of-range"),
        (
            bad(light, ~light.between(*policy.illumination))
            | bad(image["dark_clipping_fraction"], image["dark_clipping_fraction"] > policy.max_dark_clipping)
            | bad(image["bright_clipping_fraction"], image["bright_clipping_fraction"] > policy.max_bright_clipping),
            "illumination-out-of-range",
        ),
        (bad(image["sharpness"], image["sharpness"] < floor), "blur"),
        (bad(c("analyzed_frame_rate"), c("analyzed_frame_rate") < policy.min_frame_rate), "frame-rate-below-minimum"),
        (c("inter_result_gap_ms").isNotNull() & bad(c("inter_result_gap_ms"), c("inter_result_gap_ms") > policy.max_frame_gap_ms), "visual-frame-gap"),
        (bad(c("skipped_frame_fraction"), c("skipped_frame_fraction") > policy.max_skipped_fraction), "too-many-skipped-frames"),
    ]


def visual_quality_reasons(floor: Column | None = None, policy: type[VisualPolicy] = VisualPolicy) -> Column:
    """Reason codes of a facial frame in their fixed order, those it came with included."""
    own = S.reasons(_visual_checks(floor, policy))
    return S.in_listed_order(F.array_union(F.coalesce("quality_reasons", F.array().cast("array<string>")), own), VISUAL_ORDER)


def image_sound(floor: Column | None = None, policy: type[VisualPolicy] = VisualPolicy) -> Column:
    """Whether visual_quality_reasons() has none but pose-out-of-range, without the list."""
    came = F.coalesce(F.arrays_overlap("quality_reasons", F.array(*[F.lit(r) for r in VISUAL_ORDER if r != "pose-out-of-range"])), F.lit(False))
    return ~came & S.none_of([(c, r) for c, r in _visual_checks(floor, policy) if r != "pose-out-of-range"])


def mouth_width() -> Column:
    m = F.col("mouth_corners")
    return F.hypot(m["left"]["x"] - m["right"]["x"], m["left"]["y"] - m["right"]["y"])


def mouth_corner_asymmetry() -> Column:
    """Distance from the mirror image: 0 where the corners lie evenly about the midline."""
    m = F.col("mouth_corners")
    return F.hypot(m["left"]["x"] + m["right"]["x"], m["left"]["y"] - m["right"]["y"])


def complete_geometry() -> Column:
    eye, ratio = F.col("eye_aperture"), F.col("mouth_aperture_ratio")
    signs = F.coalesce((eye["left"] >= 0) & (eye["right"] >= 0) & (ratio >= 0), F.lit(False))
    return signs & S.finite(eye["left"]) & S.finite(eye["right"]) & S.finite(ratio) & S.finite(F.abs(eye["left"] - eye["right"])) & S.finite(mouth_width()) & S.finite(mouth_corner_asymmetry())


def calibrated_size_usable(calibration: Column) -> Column:
    """Width and height within a fifth of the calibrated ones."""
    box = F.col("bounding_box")
    near = lambda a, b: F.try_divide(a, b).between(1 - SIZE_TOLERANCE, 1 + SIZE_TOLERANCE)
    return F.coalesce(near(box["width_pixels"], calibration["baseline_box_width_pixels"]) & near(box["height_pixels"], calibration["baseline_box_height_pixels"]), F.lit(False))


def _attributed() -> Column:
    return F.col("task_context").eqNullSafe(F.lit(FACE_TASK)) & F.col("face_count").eqNullSafe(F.lit(1)) & (F.coalesce(F.length("track_segment_id"), F.lit(0)) > 0)


def resting_pose_usable() -> Column:
    return _attributed() & F.coalesce(F.col("face_visible"), F.lit(False)) & complete_geometry() & image_sound()


def event_usable() -> Column:
    """Usable for events: attributed, complete and of sound image; pose and scale do not matter."""
    return _attributed() & complete_geometry() & image_sound()


def expression_usable() -> Column:
    m = F.col("mouth_corners")
    return F.coalesce(F.col("face_visible"), F.lit(False)) & S.finite(m["left"]["y"]) & S.finite(m["right"]["y"]) & S.finite("t_ms")


def _face_checks(calibration: Column, resting: Column) -> list[tuple[Column, str]]:
    pose = F.col("pose")
    off = lambda axis, limit: pose.isNotNull() & (~S.finite(pose[axis]) | F.coalesce(F.abs(pose[axis] - F.coalesce(resting[axis], F.lit(0.0))) > limit, F.lit(True)))
    return [
        (~F.col("task_context").eqNullSafe(F.lit(FACE_TASK)), "task-context"), (~F.col("face_count").eqNullSafe(F.lit(1)), "face-count"), (
            F.coalesce(F.length("track_segment_id"), F.lit(0)) == 0, "no-track-id"
        ),
        (~image_sound(), "image-quality"), (pose.isNull(), "no-pose"), (off("yaw_degrees", MAX_YAW), "yaw"), (off("pitch_degrees", MAX_PITCH), "pitch"), (off("roll_degrees", MAX_ROLL), "roll"),
        (~calibrated_size_usable(calibration), "face-scale"), (~complete_geometry(), "incomplete-geometry"),
    ]


def face_gate_failures(calibration: Column, resting: Column) -> Column:
    """Every gate that a facial frame fails, in order. resting: the session's resting pose, or null for frontal."""
    return S.reasons(_face_checks(calibration, resting))


def face_usable(calibration: Column, resting: Column) -> Column:
    """Whether a facial frame fails none of its gates."""
    return S.none_of(_face_checks(calibration, resting))


def audio_calibration_class(reliable: Column, energy: Column) -> Column:
    """strong with 8 frames of reliable pitch, limited with any speech energy, else unavailable."""
    return F.when(reliable >= 8, "strong").when(energy > 0, "limited").otherwise("unavailable")


def guidance(reasons: Column) -> Column:
    """What to ask of the person in front of the camera, by the first reason that matters."""
    any_of = lambda *names: F.arrays_overlap(reasons, F.array(*[F.lit(n) for n in names]))
    return S.first_reason([
        (
            any_of("face-not-visible", "camera-unavailable", "worker-unavailable", "document-hidden"), "Move into view"
        ), (any_of("pose-out-of-range"), "Face the camera"), (any_of("face-too-small"), "Move closer"),
        (any_of("face-too-large"), "Move farther back"), (any_of("face-edge-margin"), "Center your face"), (
            any_of("illumination-out-of-range"), "Please turn on a light"
        ), (any_of("blur"), "Hold still"),
        (any_of("frame-rate-below-minimum", "visual-frame-gap", "too-many-skipped-frames"), "Camera needs a moment"),
    ], F.lit("Face ready"))
