"""The registered metrics: code, modality, context, unit and group, in their order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .histories import definition_table

_VOICE, _FACE = ("voice", "ambient-speech-turn"), ("face", "ambient-frontal")
_NORMALISED = "inter-eye-normalized-distance"
# Fixed values.
METRICS = [
    ("ambient.voice.f0.median", *_VOICE, "Hz", "pitch"),
    ("ambient.voice.f0.variability", *_VOICE, "semitone-SD", "pitch"),
    ("ambient.voice.speech_activity_fraction", *_VOICE, "ratio", "speech-timing"),
    ("ambient.voice.pause_rate", *_VOICE, "pauses/minute", "speech-timing"),
    ("ambient.voice.pause_duration.median", *_VOICE, "seconds", "speech-timing"),
    ("ambient.voice.speech_run_duration.median", *_VOICE, "seconds", "speech-timing"),
    ("ambient.voice.acoustic_nucleus_rate", *_VOICE, "nuclei/active-speech-second", "speech-timing"),
    ("ambient.face.eye_aperture.left", *_FACE, "eye-width-ratio", "eye-geometry"),
    ("ambient.face.eye_aperture.right", *_FACE, "eye-width-ratio", "eye-geometry"),
    ("ambient.face.eye_aperture.asymmetry", *_FACE, "eye-width-ratio", "symmetry"),
    ("ambient.face.mouth_width", *_FACE, _NORMALISED, "mouth-geometry"),
    ("ambient.face.mouth_aperture.median", *_FACE, "mouth-width-ratio", "mouth-geometry"),
    ("ambient.face.mouth_aperture.p90", *_FACE, "mouth-width-ratio", "mouth-geometry"),
    ("ambient.face.mouth_corner_position.asymmetry", *_FACE, _NORMALISED, "symmetry"),
    ("ambient.face.landmark_speed.p90", *_FACE, "inter-eye-distances/second", "movement"),
    ("ambient.face.blink_rate.bilateral", *_FACE, "events/minute", "blink-behavior"),
    ("ambient.face.rest_mouth_corner_asymmetry.signed", *_FACE, _NORMALISED, "symmetry"),
    ("ambient.face.rest_eye_aperture_asymmetry.signed", *_FACE, "eye-width-ratio", "symmetry"),
    ("ambient.face.spontaneous_event_rate", *_FACE, "events/minute", "expression-dynamics"),
    ("ambient.face.spontaneous_excursion.p90", *_FACE, _NORMALISED, "expression-dynamics"),
    ("ambient.face.spontaneous_excursion_asymmetry.median", *_FACE, "signed-excursion-ratio", "expression-dynamics"),
    ("ambient.face.oculo_oral_synkinesis_index", *_FACE, "signed-coupling-ratio", "expression-dynamics"),
    ("ambient.face.brow_height.left", *_FACE, _NORMALISED, "brow-geometry"),
    ("ambient.face.brow_height.right", *_FACE, _NORMALISED, "brow-geometry"),
    ("ambient.face.brow_height_asymmetry.signed", *_FACE, _NORMALISED, "brow-geometry"),
    ("ambient.face.lid_closure_completeness.left", *_FACE, "closure-ratio", "blink-behavior"),
    ("ambient.face.lid_closure_completeness.right", *_FACE, "closure-ratio", "blink-behavior"),
]


# Why a metric may be withheld: reasons of all, of a modality, and of single metrics.
ANY_REASONS = ["modality-unavailable", "processor-unavailable", "asset-integrity-failed", "quality-threshold-failed", "insufficient-duration", "session-ended-early"]
MODALITY_REASONS = {
    "voice": ["no-usable-signal", "insufficient-segments", "insufficient-active-speech"],
    "face": ["no-usable-signal", "multiple-faces", "insufficient-bins", "pose-out-of-range", "face-scale-out-of-range"],
}
OWN_REASONS = {
    "ambient.voice.f0.median": ["insufficient-pitched-speech", "pitch-estimator-disagreement"],
    "ambient.voice.f0.variability": ["insufficient-pitched-speech", "insufficient-pitch-bins"],
    "ambient.voice.speech_activity_fraction": ["insufficient-events"],
    "ambient.voice.pause_rate": ["insufficient-events"],
    "ambient.voice.pause_duration.median": ["insufficient-events"],
    "ambient.voice.speech_run_duration.median": ["insufficient-events"],
    "ambient.voice.acoustic_nucleus_rate": ["insufficient-nuclei"],
    "ambient.face.blink_rate.bilateral": ["insufficient-exposure", "insufficient-frame-cadence"],
    "ambient.face.spontaneous_excursion.p90": ["insufficient-events"],
    "ambient.face.spontaneous_excursion_asymmetry.median": ["insufficient-events"],
    "ambient.face.oculo_oral_synkinesis_index": ["insufficient-events"],
}


def codes(modality: str) -> list[str]:
    """The metric codes of a modality, in their order."""
    return [m[0] for m in METRICS if m[1] == modality]


def allowed_reasons(spark: SparkSession) -> DataFrame:
    """metric_code and allowed_reasons."""
    rows = [(code, [*ANY_REASONS, *MODALITY_REASONS[modality], *OWN_REASONS.get(code, [])]) for code, modality, *_ in METRICS]
    return spark.createDataFrame(rows, "metric_code string, allowed_reasons array<string>")


def metrics(spark: SparkSession) -> DataFrame:
    """place, metric_code, modality, context, unit, metric_group and digest."""
    return definition_table(spark, METRICS, "metric_code string, modality string, context string, unit string, metric_group string")
