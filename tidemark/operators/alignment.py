"""Alignment of observation histories to a treatment: one call for all participants of a cohort.

Input tables share the columns of `scope` (such as participant); times are microseconds (long).

observations: observation_id, revision_id, supersedes_revision_id, encounter_id, consent_id, binding_id, recorded_at, started_at, ended_at,
  status, measurement_protocol, source_kind, clock_uncertainty_ms, clock_kind, capture (anything that tells how it was captured)
metrics: revision_id, metric_code, unit, context, modality, algorithm_version, processor_ref, status, value, usable_ms, quality
consents: consent_id, capture, derived_analysis, derived_retention, modalities, granted_at, withdrawn_at, expires_at
bindings: binding_id, encounter_id, status, verification_method, recorded_at, revoked_at
treatments: treatment_id, revision_id, supersedes_revision_id, course_id, recorded_at, earliest, latest, precision, status, verification, kind
contexts: context_id, revision_id, supersedes_revision_id, recorded_at, earliest, latest, status, kind
wanted: anchor_treatment_id and as_of, one row for each scope

Nothing that was recorded after as_of is used. An identity whose revision chain is unsound has no current revision.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.scratch import materialize
from . import history

DAY = history.DAY_US


@dataclass(frozen=True)
class Metric:
    """What a protocol asks of one metric."""

    metric_code: str
    unit: str
    modality: str
    context: str
    algorithm_version: str
    least_usable_ms: float = 30_000
    least_quality: float = 0.5


@dataclass(frozen=True)
class Specification:
    """Windows in days about the anchor, and what an observation must fulfil."""

    metrics: Sequence[Metric]
    measurement_protocol: str
    source_kinds: Sequence[str] = ("patient-local-pre-codec", "synthetic")
    baseline: tuple[float, float] = (-56, 0)
    least_observations: int = 2
    least_encounters: int = 2
    followup_end: float = 112
    phases: Sequence[tuple[str, float, float, int]] = (("days-0-to-14", 0, 14, 1), ("days-14-to-42", 14, 42, 1), ("days-42-to-112", 42, 112, 1))
    most_clock_ms: float = 1000
    exclude_after_change: bool = False
    anchor_kind: str = "botulinum-injection"


@dataclass(frozen=True)
class Start:
    """What a run knows before it looks at metrics."""

    observed: DataFrame
    anchors: DataFrame
    changes: DataFrame
    cycles: DataFrame
    flags: DataFrame


@dataclass(frozen=True)
class Alignment:
    """The tables of a run."""

    anchors: DataFrame
    flags: DataFrame
    exclusions: DataFrame
    points: DataFrame
    rows: DataFrame
    coverage: DataFrame
    scope: list[str] = field(default_factory=list)


def parameter_tables(spark: SparkSession, spec: Specification) -> tuple[DataFrame, DataFrame]:
    """(metrics, phases) of a specification as small tables, each row with the digest of its content."""
    metrics = spark.createDataFrame(
        [(m.metric_code, m.unit, m.modality, m.context, m.algorithm_version, float(m.least_usable_ms), float(m.least_quality)) for m in spec.metrics],
        "metric_code string, unit string, modality string, context string, algorithm_version string, least_usable_ms double, least_quality double"
    )
    phases = spark.createDataFrame([(p, float(a), float(b), n) for p, a, b, n in spec.phases], "phase_id string, start_day double, end_day double, minimum_count int")
    return tuple(t.withColumn("digest", S.digest({c: c for c in t.columns})) for t in (metrics, phases))


def _current(histories: dict[str, DataFrame], scope: list[str]) -> tuple[DataFrame, ...]:
    """Each history (by the column of its identities) with is_current: whether a record is its identity's current revision. One audit for all of them."""
    links = [
        records.select(*scope, F.lit(identity).alias("history"), F.col(identity).cast("string").alias("record"), "revision_id", "supersedes_revision_id", "recorded_at")
        for identity, records in histories.items()
    ]
    audit = history.chain_audit(functools.reduce(DataFrame.unionByName, links), [*scope, "history"], "record", "revision_id", "supersedes_revision_id", "recorded_at")
    leaves = materialize(audit.select(*scope, "history", "record", F.col("leaf").alias("current_revision")))

    def marked(identity: str, records: DataFrame) -> DataFrame:
        own = leaves.filter(F.col("history") == identity).drop("history")
        joined = records.withColumn("record", F.col(identity).cast("string")).join(own, [*scope, "record"], "left")
        return materialize(joined.withColumn("is_current", F.col("revision_id").eqNullSafe(F.col("current_revision"))).drop("current_revision", "record"))

    return tuple(marked(i, r) for i, r in histories.items())


def _anchors(treatments: DataFrame, wanted: DataFrame, scope: list[str]) -> DataFrame:
    current = treatments.filter("is_current").drop("is_current", "as_of").withColumnRenamed("treatment_id", "anchor_treatment_id").withColumn("treatment_id", F.col("anchor_treatment_id"))
    joined = wanted.join(current, [*scope, "anchor_treatment_id"], "left")
    marked = joined.withColumn("reasons", history.anchor_reasons(F.col("as_of")))
    sound = F.size("reasons") == 0
    return marked.select(
        *scope, "as_of", "anchor_treatment_id", F.col("revision_id").alias("anchor_revision"), F.col("course_id").alias("anchor_course"),
        F.when(sound, F.col("earliest")).alias("anchor_start"), F.when(sound, F.col("latest")).alias("anchor_end"), "reasons"
    )


def _changes(treatments: DataFrame, contexts: DataFrame, anchors: DataFrame, scope: list[str], spec: Specification) -> tuple[DataFrame, DataFrame]:
    """(flags of other treatments and contexts: revision_id, kind, reason, relevant, at; starts of the next cycle)."""
    own = anchors.select(*scope, "anchor_treatment_id", "anchor_course", "anchor_start", "anchor_end")
    beyond = F.coalesce(F.col("earliest") > F.col("anchor_end") + int(spec.followup_end * DAY), F.lit(False))
    others = treatments.filter("is_current and status = 'administered'").join(own, scope).filter((F.col("treatment_id") != F.col("anchor_treatment_id")) & ~beyond)
    prior = F.coalesce(F.col("latest") < F.col("anchor_start"), F.lit(False))
    reason = F.when(F.col("earliest").isNull(), "other-treatment-time-unknown").when(prior, "prior-treatment-carryover-not-estimated").otherwise("concurrent-or-subsequent-treatment")
    relevant = F.col("earliest").isNull() | F.coalesce(F.col("latest") >= F.col("anchor_start"), F.lit(False))
    flags = others.select(*scope, "revision_id", "kind", reason.alias("reason"), relevant.alias("relevant"), F.col("earliest").alias("at"))
    cycles = others.filter((F.col("kind") == spec.anchor_kind) & (F.col("course_id") == F.col("anchor_course")) & (F.col("verification") == "verified") & (F.col("earliest") > F.col("anchor_end")))
    before = F.coalesce(F.col("latest") < F.col("anchor_start") + int(spec.baseline[0] * DAY), F.lit(False))
    told = contexts.filter("is_current and status = 'active'").join(own, scope).filter(~beyond & ~before)
    flags = flags.unionByName(told.select(*scope, "revision_id", "kind", F.lit("clinical-context-not-causally-adjusted").alias("reason"), F.lit(True).alias("relevant"), F.col("earliest").alias("at")))
    return flags, cycles.groupBy(*scope).agg(F.min("earliest").alias("next_cycle"))


def _all_flags(flags: DataFrame, anchors: DataFrame, histories: Sequence[DataFrame], scope: list[str]) -> DataFrame:
    """revision_id, kind and reason of all that an interpretation must know."""
    columns = [*scope, "revision_id", "kind", "reason"]
    out = flags.select(columns)
    for records in histories:
        out = out.unionByName(records.filter("is_current and supersedes_revision_id is not null").select(
            *scope, "revision_id", F.lit("source-correction").alias("kind"), F.lit("analysis-input-history-includes-corrected-source").alias("reason")
        ))
    prior = flags.filter("reason = 'prior-treatment-carryover-not-estimated'").select(*scope).distinct()
    unwashed = anchors.filter("anchor_start is not null").join(prior, scope, "left_anti")
    return out.unionByName(unwashed.select(
        *scope, F.col("anchor_revision").alias("revision_id"), F.lit("treatment-history").alias("kind"),
        F.lit("absence-of-recorded-prior-treatment-does-not-establish-washout").alias("reason")
    ))


def fingerprint() -> Column:
    """What must be alike for values to be compared: protocol, capture (but for the clock's uncertainty) and metric definition."""
    parts = ["measurement_protocol", "source_kind", "clock_kind", "capture", "metric_code", "m_modality", "m_unit", "m_context", "m_algorithm_version", "m_processor_ref"]
    return S.digest({p: p for p in parts})


def _judged(observations: DataFrame, metrics: DataFrame, consents: DataFrame, bindings: DataFrame, spec: Specification, scope: list[str]) -> DataFrame:
    """Each observation and metric of the protocol, with days, period and reasons."""
    c, as_of = F.col, F.col("as_of")
    given = lambda df, prefix, kept: df.select(*[F.col(x).alias(x if x in scope or x in kept else f"{prefix}_{x}") for x in df.columns if x != "as_of"])
    consented = given(consents, "c", ["capture_allowed", "derived_analysis", "derived_retention", "modalities", "granted_at", "withdrawn_at", "expires_at"])
    bound = given(bindings, "b", ["verification_method", "revoked_at"])
    asked = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in (("metric_code", m.metric_code), ("d_unit", m.unit), ("d_modality", m.modality), ("d_context", m.context), ("d_algorithm_version", m.algorithm_version), ("least_usable_ms", float(m.least_usable_ms)), ("least_quality", float(m.least_quality)))]) for m in spec.metrics])
    told = given(metrics, "m", ["revision_id"]).withColumn("found", F.lit(True))
    listed = told.groupBy(*scope, "revision_id").agg(F.collect_list(F.struct(*[x for x in told.columns if x not in (*scope, "revision_id")])).alias("held"))
    own = F.filter("held", lambda m: m["m_metric_code"] == c("metric_code"))  # a revision's metrics come together, so that its row is shuffled once, not once a metric asked for
    each = (
        observations.join(consented.withColumn("consent_id", c("c_consent_id")), [*scope, "consent_id"], "left")
        .join(bound.withColumn("binding_id", c("b_binding_id")), [*scope, "binding_id"], "left")
        .join(listed, [*scope, "revision_id"], "left")
        .select("*", F.inline(asked)).select("*", F.inline_outer(own)).drop("held", "m_metric_code")
    )
    clock = c("clock_uncertainty_ms") * 1000
    first, last = history.day_bounds(c("started_at"), c("ended_at"), clock, c("anchor_start"), c("anchor_end"))
    each = each.withColumns({"first_day": first, "last_day": last}).withColumn("period", history.period(c("first_day"), c("last_day"), spec.baseline[0], spec.baseline[1], spec.followup_end))
    found, measured, later = c("found").isNotNull(), c("m_status") != "withheld", c("anchor_start").isNotNull() & (c("period") != "baseline")
    differs = F.lit(False)
    for x in ("unit", "modality", "context", "algorithm_version"):
        differs = differs | ~c(f"m_{x}").eqNullSafe(c(f"d_{x}"))
    changed = c("unknown_change") | (c("ended_at") + clock >= c("first_change"))
    reasons = S.reasons([
        (~c("is_current"), "superseded"), (c("status") == "entered-in-error", "entered-in-error"), (~found, "metric-missing"),
        *[(found & r, code) for r, code in history.consent_reasons(c("m_modality"), c("started_at"), c("ended_at"), as_of, "capture_allowed")],
        *[(found & r, code) for r, code in history.binding_reasons(c("encounter_id"), c("source_kind"), c("started_at"), as_of)],
        (found & ~c("source_kind").isin(*spec.source_kinds), "source-kind-not-permitted"), (found & (c("measurement_protocol") != spec.measurement_protocol), "measurement-protocol-mismatch"),
        (found & ((c("clock_uncertainty_ms") > spec.most_clock_ms) | ((c("clock_kind") == "synthetic") & (c("source_kind") != "synthetic"))), "clock-uncertain"),
        (found & differs, "metric-definition-mismatch"), (found & ~measured, "metric-withheld"), (found & measured & (c("m_usable_ms") < c("least_usable_ms")), "insufficient-usable-duration"),
        (
            found & measured & (c("m_quality").isNull() | (c("m_quality") < c("least_quality"))), "technical-quality-failed"
        ), (c("period") == "treatment-time-overlap", "treatment-time-overlap"), (c("period") == "outside-analysis-window", "outside-analysis-window"),
        (later & F.lit(spec.exclude_after_change) & changed, "concurrent-treatment-change"), (later & (c("ended_at") + clock >= c("next_cycle")), "subsequent-treatment-cycle"),
    ])
    judged = each.withColumn("reasons", reasons)
    return judged.select(
        *scope, "metric_code", "observation_id", "revision_id", "encounter_id", "started_at", "ended_at", "period", "first_day", "last_day", "m_value", "reasons",
        F.when(F.size("reasons") == 0, fingerprint()).alias("fingerprint")
    )


def start(observations: DataFrame, treatments: DataFrame, contexts: DataFrame, wanted: DataFrame, spec: Specification, scope: list[str]) -> Start:
    """Current revisions, anchors, changes and flags. Tables are written in the shared folder while the result is being planned."""
    cut = wanted.select(*scope, "as_of")
    known = lambda records: history.known_at(records, cut, scope, "recorded_at", "as_of").drop("as_of")
    observed, treated, told = _current({i: known(r) for r, i in ((observations, "observation_id"), (treatments, "treatment_id"), (contexts, "context_id"))}, scope)
    anchors = materialize(_anchors(treated, wanted, scope))
    flags, cycles = _changes(treated, told, anchors, scope, spec)
    changes = history.first_change(flags.filter("relevant"), scope, "at")
    return Start(observed, anchors, changes, cycles, _all_flags(flags, anchors, (observed, treated, told), scope))


def align(
    observations: DataFrame, metrics: DataFrame, consents: DataFrame, bindings: DataFrame, treatments: DataFrame, contexts: DataFrame, wanted: DataFrame,
    spec: Specification, scope: list[str]
) -> Alignment:
    """The whole run. Tables are written in the shared folder while the result is being planned."""
    cut = wanted.select(*scope, "as_of")
    known = lambda records, at="recorded_at": history.known_at(records, cut, scope, at, "as_of")
    begun = start(observations, treatments, contexts, wanted, spec, scope)
    anchors = begun.anchors
    placed = begun.observed.join(anchors.select(*scope, "as_of", "anchor_start", "anchor_end"), scope).join(begun.changes, scope, "left").join(begun.cycles, scope, "left")
    judged = materialize(_judged(placed, metrics, known(consents.withColumnRenamed("capture", "capture_allowed"), "granted_at"), known(bindings), spec, scope))
    row, order = [*scope, "metric_code"], ["started_at", "revision_id"]
    candidates = materialize(history.reference_stratum(
        judged.filter(F.size("reasons") == 0).withColumn("is_baseline", F.coalesce(F.col("period") == "baseline", F.lit(False))), row, "fingerprint", "is_baseline", order
    ))
    alike = F.col("fingerprint") == F.col("reference_fingerprint")
    compatible = candidates.filter(alike)
    baselines = history.baseline(compatible.filter("is_baseline"), row, "encounter_id", "m_value", spec.least_observations, spec.least_encounters)
    valued = compatible.join(baselines.select(*row, "baseline_value"), row, "left").withColumn("delta", F.col("m_value") - F.col("baseline_value"))
    wild = F.col("delta").isNotNull() & ~S.finite("delta")
    points = valued.filter(~wild).select(
        *row, "observation_id", "revision_id", "encounter_id", "started_at", "ended_at", "period", "is_baseline", "first_day", "last_day",
        F.col("m_value").alias("value"), "delta"
    )
    one = lambda df, code: df.select(*row, "observation_id", "revision_id", F.array(F.lit(code)).alias("reasons"))
    exclusions = judged.filter(F.size("reasons") > 0).select(*row, "observation_id", "revision_id", "reasons").unionByName(one(candidates.filter(~alike), "source-incompatible")).unionByName(one(valued.filter(wild), "non-finite-delta"))
    codes = F.array(*[F.lit(m.metric_code) for m in spec.metrics])
    every = anchors.select(*scope, "anchor_start", F.explode(codes).alias("metric_code"))
    counted = points.groupBy(*row).agg(F.count("*").alias("points"), F.sum((F.col("first_day") >= 0).cast("long")).alias("followups"))
    strata = candidates.groupBy(*row).agg(F.first("reference_fingerprint").alias("fingerprint"))
    joined = every.join(counted, row, "left").join(baselines, row, "left").join(strata, row, "left").fillna(0, ["points", "followups", "baseline_n", "baseline_encounters"])
    short = S.first_reason([
        (F.col("anchor_start").isNull(), "anchor-unavailable"), (F.col("baseline_n") < spec.least_observations, "insufficient-baseline-observations"),
        (F.col("baseline_encounters") < spec.least_encounters, "insufficient-baseline-encounters")
    ])
    rows = joined.select(
        *row, "points", history.row_status(F.col("points"), F.col("baseline_value"), F.col("followups")).alias("status"), "baseline_value", "baseline_n",
        "baseline_encounters", short.alias("baseline_reason"), "fingerprint"
    )
    phases = parameter_tables(observations.sparkSession, spec)[1].drop("digest")
    coverage = history.phase_coverage(points.filter(~F.col("is_baseline") & F.col("first_day").isNotNull()), every, phases, row, "encounter_id", "first_day", "last_day")
    return Alignment(anchors, begun.flags, exclusions, points, rows, coverage, scope)


def latest_points(points: DataFrame, row: list[str]) -> DataFrame:
    """The last point of each row, by its end."""
    last = F.max_by(F.struct(*[c for c in points.columns if c not in row]), F.struct("ended_at", "revision_id")).alias("last")
    return points.groupBy(*row).agg(last).select(*row, "last.*")


def run_status(run: Alignment) -> DataFrame:
    """One row for each scope: anchor-unavailable, available (some row is observed) or insufficient-data."""
    observed = run.rows.groupBy(*run.scope).agg(F.max(F.col("status") == "observed").alias("observed"))
    status = F.when(F.size("reasons") > 0, "anchor-unavailable").when(F.col("observed"), "available").otherwise("insufficient-data")
    return run.anchors.join(observed, run.scope, "left").select(*run.scope, status.alias("status"), "reasons")


def row_violations(rows: DataFrame, points: DataFrame, exclusions: DataFrame, coverage: DataFrame, row: list[str]) -> DataFrame:
    """What is wrong with the tables of a run, by row: baseline without value or the reverse, deltas that are not value less baseline, points that are excluded too, phases whose status belies their count."""
    part = rows.select(*row, S.reasons([
        (
            F.col("baseline_value").isNotNull() & F.col("baseline_reason").isNotNull(), "baseline-with-reason"
        ), (F.col("baseline_value").isNull() & F.col("baseline_reason").isNull(), "baseline-without-reason"),
        ((F.col("points") == 0) != (F.col("status") == "no-comparable-data"), "status-mismatch"),
    ]).alias("violations"))
    delta = points.join(rows.select(*row, "baseline_value"), row).filter(~F.col("delta").eqNullSafe(F.col("value") - F.col("baseline_value")))
    both = points.join(exclusions.select(*row, "revision_id").distinct(), [*row, "revision_id"], "left_semi")
    claimed = F.when(F.col("encounters") == 0, "missing").when(F.col("encounters") < F.col("minimum_count"), "sparse").otherwise("sufficient")
    belied = coverage.filter(F.col("status") != claimed)
    one = lambda df, code: df.select(*row).distinct().withColumn("violations", F.array(F.lit(code)))
    every = part.unionByName(one(delta, "delta-mismatch")).unionByName(one(both, "point-also-excluded")).unionByName(one(belied, "phase-status-mismatch"))
    return every.groupBy(*row).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("violations")))).alias("violations"))
