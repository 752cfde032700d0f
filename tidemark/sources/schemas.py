"""Explicit schemas of the input tables; nothing is inferred. Null means not observed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOICE_FRAMES = (
    "session_id string, t_ms double, acquired_at_ms double, capture_epoch long, sequence long, absolute_sample_index long, task_context string, track_segment_id string, processor_ref string, "
    "speech_active boolean, periodic boolean, syllabic_nucleus boolean, rms double, f0_hz double, f0_confidence double, estimator_agreement double, snr_db double, dc_offset double, spectral_flux double, "
    "cepstral_peak_prominence_db double, clipped_sample_fraction double, lost_block_fraction double, block_gap_ms double, sample_rate_hz double, "
    "browser_processing struct<echo_cancellation: boolean, noise_suppression: boolean, auto_gain_control: boolean>, quality_reasons array<string>"
)
_PAIR = "struct<left: double, right: double>"
_POINTS = "struct<left: struct<x: double, y: double>, right: struct<x: double, y: double>>"
FACE_FRAMES = (
    "session_id string, t_ms double, acquired_at_ms double, sequence long, capture_epoch long, task_context string, processor_ref string, track_segment_id string, face_count int, face_visible boolean, "
    "bounding_box struct<x: double, y: double, width: double, height: double, width_pixels: double, height_pixels: double, edge_margin_fraction: double>, "
    "pose struct<yaw_degrees: double, pitch_degrees: double, roll_degrees: double>, "
    f"eye_aperture {_PAIR}, brow_height {_PAIR}, fissure_width {_PAIR}, fissure_height {_PAIR}, iris_diameter {_PAIR}, mouth_corners {_POINTS}, gaze_offset {_POINTS}, "
    "mouth_aperture_ratio double, mouth_midline_offset double, regional_movement_speed double, inter_result_gap_ms double, "
    "image_quality struct<illumination_mean: double, dark_clipping_fraction: double, bright_clipping_fraction: double, sharpness: double>, "
    "analyzed_frame_rate double, skipped_frame_fraction double, processing_latency_ms double, quality_reasons array<string>"
)
SESSIONS = (
    "session_id string, protocol_version string, protocol_sha256 string, session_started_at_ms double, noise_calibration_duration_ms double, "
    "face_calibration struct<duration_ms: double, baseline_box_width_pixels: double, baseline_box_height_pixels: double>"
)
WORKFLOW_EVENTS = (
    "event_id string, sequence int, occurred_at timestamp, session_id string, subject_ref string, protocol_ref struct<pack_id: string, version: string, content_sha256: string>, "
    "actor struct<kind: string, id: string, version: string>, type string, stage string, summary string, "
    "payload struct<metric_code: string, observation_id: string, report_id: string, reason_code: string, modality: string, code: string, recoverable: boolean>, evidence_refs array<struct<kind: string, id: string>>, caused_by_event_id string"
)
ENCOUNTER_INPUTS = "id string, episode_id string, revision int, kind string, logical_id string, replaces_record_id string, idempotency_key string, content_hash string, payload string, source_provenance string, actor_id string, recorded_at timestamp"

#: Names that no sink may write: raw media, landmarks and identifying vectors.
PRIVATE_NAMES = ["landmarks", "mouth_corners", "eye_aperture", "pcm", "waveform", "embedding", "voiceprint", "samples"]


def read(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """A table with exactly this schema; NaN becomes null, so that it is never taken for a value."""
    df = spark.read.schema(schema).format(fmt).load(path)
    return df.withColumns({f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema if isinstance(f.dataType, T.DoubleType)})


def private_columns(schema: T.StructType, names: list[str] = PRIVATE_NAMES, at: str = "") -> list[str]:
    """Paths of the columns, nested ones included, that carry a private name."""
    out = []
    for f in schema:
        path = f"{at}{f.name}"
        if f.name.lower().replace("_", "") in {n.replace("_", "") for n in names}:
            out.append(path)
        kind = f.dataType
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        if isinstance(kind, T.MapType):
            kind = kind.valueType
        if isinstance(kind, T.StructType):
            out += private_columns(kind, names, f"{path}.")
    return out


def assert_no_private_columns(df: DataFrame) -> DataFrame:
    if found := private_columns(df.schema):
        raise ValueError(f"private columns may not be written: {', '.join(found)}")
    return df


def append_once(df: DataFrame, path: str, keys: list[str], partition_by: list[str]) -> int:
    """Appends the rows whose key is not there yet, never changing what is; returns how many keys were new.

    A path has one writer at a time: what is there is read before what is new is written, so two at once could both write a key.
    """
    spark = df.sparkSession
    new = assert_no_private_columns(df).dropDuplicates(keys)
    try:
        held = spark.read.parquet(path).select(*keys)
    except Exception as e:  # noqa: BLE001  (the error class differs by store)
        if "PATH_NOT_FOUND" not in str(e):
            raise
        held = None
    if held is not None:
        new = new.join(held, keys, "left_anti")
    new = new.cache()
    n = new.count()
    if n:
        new.write.mode("append").partitionBy(*partition_by).parquet(path)
    new.unpersist()
    return n


def publish_runs(runs: DataFrame, path: str, engine_version: str, revisions: DataFrame) -> int:
    """Appends results that are still current, one for each (episode_id, input_revision, engine_version); returns how many were new. revisions: episode_id and revision as they stand."""
    now = revisions.select("episode_id", F.col("revision").alias("input_revision"))
    current = runs.join(now, ["episode_id", "input_revision"], "left_semi").withColumn("engine_version", F.lit(engine_version))
    return append_once(current, path, ["episode_id", "input_revision", "engine_version"], ["engine_version"])


def canonical(df: DataFrame, *order: str) -> DataFrame:
    """df in the order in which an artefact lists its rows; for small results that are written for people or digests."""
    return df.orderBy(*order)
