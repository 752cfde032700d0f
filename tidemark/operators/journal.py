"""Event journals: sequence audit, allowed stages, replay to the state of each session."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

#: The stages in which each type of event may occur.
ALLOWED_STAGES = {
    "consent.recorded": ["requesting-permission"],
    "capture.permission.requested": ["requesting-permission"],
    "capture.calibration.started": ["calibrating"],
    "capture.lane.ready": ["calibrating"],
    "capture.started": ["observing"],
    "capture.quality.changed": ["observing"],
    "measurement.recorded": ["observing", "finalizing"],
    "measurement.withheld": ["observing", "finalizing"],
    "capture.finalizing": ["finalizing"],
    "capture.discarded": ["discarded"],
    "observation.created": ["finalizing"],
    "report.created": ["report"],
    "capture.error": ["error"],
}


def sequence_audit(events: DataFrame, session: str, sequence: str, event_id: str, at: str, cause: str | None = None, same: list[str] | None = None, first: int = 1, evidence: str | None = None) -> DataFrame:
    """Events with problems: a gap in the numbers, a repeated id, a time before the last, another subject or protocol than the first event's, a cause that is not earlier.

    evidence: an array of structs, references whose fields are named like the event's own columns; one that differs in any of these crosses the
    event's scope.
    """
    ordered = Window.partitionBy(session).orderBy(sequence, event_id)
    by_id = Window.partitionBy(session, event_id).orderBy(sequence)
    checks = [
        (F.col(sequence) != F.row_number().over(ordered) - 1 + first, "sequence-not-contiguous"),
        (F.row_number().over(by_id) > 1, "duplicate-event-id"),
        (F.col(at) < F.lag(at).over(ordered), "timestamp-regressed"),
    ]
    if same:
        whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        checks.append((~F.struct(*same).eqNullSafe(F.first(F.struct(*same)).over(whole)), "foreign-event"))
    if evidence:
        fields = events.schema[evidence].dataType.elementType.names
        unlike = lambda ref: functools.reduce(Column.__or__, [~ref[f].eqNullSafe(F.col(f)) for f in fields])
        checks.append((F.exists(evidence, unlike), "evidence-crosses-scope"))
    marked = events.withColumn("problems", S.reasons(checks))
    if cause is None:
        return marked
    earlier = events.groupBy(F.col(session).alias("cause_session"), F.col(event_id).alias("cause_event")).agg(F.min(sequence).alias("cause_sequence"))
    joined = marked.join(earlier, (F.col(session) == F.col("cause_session")) & (F.col(cause) == F.col("cause_event")), "left")
    late = F.col(cause).isNotNull() & (F.col("cause_sequence").isNull() | (F.col("cause_sequence") >= F.col(sequence)))
    return joined.withColumn("problems", F.concat("problems", S.reasons([(late, "cause-not-earlier")]))).drop("cause_session", "cause_event", "cause_sequence")


def disallowed(events: DataFrame, kind: str, stage: str, allowed: DataFrame) -> DataFrame:
    """The events whose (type, stage) is not in the table of allowed pairs."""
    return events.join(allowed, [kind, stage], "left_anti")


def allowed_stages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, s) for k, stages in ALLOWED_STAGES.items() for s in stages], "type string, stage string")


def replay(events: DataFrame, session: str, sequence: str, stage: str, event_id: str, kind: str, metric: str, observation: str, report: str) -> DataFrame:
    """The state of each session after its last event."""
    last = lambda c, when=None: F.max_by(c, F.when(when, F.col(sequence)) if when is not None else F.col(sequence))
    created = F.col(kind).isin("observation.created", "report.created")
    codes = lambda t: F.array_sort(F.collect_set(F.when(F.col(kind) == t, F.col(metric))))
    return events.groupBy(session).agg(
        last(stage).alias("stage"), F.count("*").alias("event_count"), F.max(sequence).alias("last_sequence"), last(event_id).alias("last_event_id"),
        last(observation, created).alias("observation_id"), last(report, F.col(kind) == "report.created").alias("report_id"),
        codes("measurement.recorded").alias("recorded_metric_codes"), codes("measurement.withheld").alias("withheld_metric_codes"),
    )
