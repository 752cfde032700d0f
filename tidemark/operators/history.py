"""Append-only, revisioned histories: revision chains, as-of snapshots, validity, and alignment to an anchor.

Times are microseconds (long); null means unknown. A scope is the list of key columns that no record may
cross, such as tenant, study and participant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.scratch import materialize
from . import robust

DAY_US = 86_400_000_000

#: Exclusion reasons of an observation, in the order in which they are listed.
EXCLUSION_REASONS = [
    "superseded", "entered-in-error", "metric-missing", "consent-missing", "consent-not-applicable", "binding-missing", "binding-not-verified", "binding-encounter-mismatch",
    "source-kind-not-permitted", "measurement-protocol-mismatch", "clock-uncertain", "metric-definition-mismatch", "metric-withheld", "insufficient-usable-duration", "technical-quality-failed",
    "treatment-time-overlap", "outside-analysis-window", "concurrent-treatment-change", "subsequent-treatment-cycle", "source-incompatible", "non-finite-delta",
]


def latest_version(records: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last record of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return records.withColumn("version_rank", F.row_number().over(w)).filter("version_rank = 1").drop("version_rank")


def known_at(records: DataFrame, snapshots: DataFrame, scope: list[str], recorded: str, as_of: str) -> DataFrame:
    """Each snapshot's records: those of its scope that were recorded by its as-of time."""
    return records.join(snapshots, scope).filter(F.col(recorded) <= F.col(as_of))


def chain_audit(records: DataFrame, scope: list[str], identity: str, revision: str, supersedes: str, recorded: str) -> DataFrame:
    """One row per identity: n, leaf (its current revision, null if unsound), and problems of its revision chain.

    A sound chain has one root and one leaf, no revision with two successors, no predecessor that is missing,
    of another identity or recorded later, and no cycle. Only links between revisions of one time can close a
    cycle, so these, and no others, are followed up by pointer doubling. The links, and the tables of the doubling where there are tied ones, are
    written while the result is being planned.
    """
    key = [*scope, identity]
    before = records.select(*[F.col(c).alias(f"p_{c}") for c in key], F.col(revision).alias("p_revision"), F.col(recorded).alias("p_recorded"))
    linked = records.join(before, [*[F.col(c) == F.col(f"p_{c}") for c in scope], F.col(supersedes) == F.col("p_revision")], "left")
    sound = F.col("p_revision").isNotNull() & (F.col(identity) == F.col(f"p_{identity}")) & (F.col("p_recorded") <= F.col(recorded))
    linked = linked.withColumn("sound", F.coalesce(sound, F.lit(False))).withColumn("tied", F.col("sound") & (F.col("p_recorded") == F.col(recorded)))
    linked = materialize(linked.select(*key, revision, supersedes, "p_revision", "sound", "tied"))
    successors = linked.filter("sound").groupBy(*scope, F.col("p_revision").alias(revision)).agg(F.count("*").alias("successors"))
    marked = linked.select(*key, revision, supersedes, "sound").join(successors, [*scope, revision], "left")
    grouped = marked.groupBy(*key).agg(
        F.count("*").alias("n"), F.sum(F.col(supersedes).isNull().cast("int")).alias("roots"), F.sum(F.col("successors").isNull().cast("int")).alias("leaves"),
        F.sum(F.col("sound").cast("int")).alias("links"), (F.max(F.coalesce("successors", F.lit(0))) > 1).alias("forked"), F.max(F.when(F.col("successors").isNull(), F.col(revision))).alias("leaf"),
    )
    tied = linked.filter("tied").select(*key, F.col(revision).alias("at"), F.col("p_revision").alias("up"))
    grouped = grouped.withColumn("cyclic", F.lit(False)) if tied.isEmpty() else grouped.join(_cyclic(tied, key), key, "left")
    problems = S.reasons([
        (F.col("roots") != 1, "no-single-root"), (F.col("leaves") != 1, "no-single-leaf"), (F.col("forked"), "revision-fork"),
        (F.col("links") != F.col("n") - F.col("roots"), "invalid-link"), (F.col("cyclic"), "revision-cycle"),
    ])
    return grouped.select(*key, "n", F.when(F.size(problems) == 0, F.col("leaf")).alias("leaf"), problems.alias("problems"))


def _cyclic(tied: DataFrame, key: list[str]) -> DataFrame:
    """The identities whose tied links (at, up) run in a circle, with cyclic = true.

    Each round doubles the way that a hop covers and keeps the hops that still lead on; the rows of a round
    are written, so that plans stay small. A hop that covers more links than its identity has tied ones runs in a circle.
    """
    count = tied.groupBy(*key).agg(F.count("*").alias("most"))
    hops, covered, found = tied.join(count, key).select(*key, "at", "up", "most"), 1, None
    while True:
        seen = Observation()
        hops = materialize(hops.observe(seen, F.coalesce(F.sum((F.col("most") >= covered).cast("long")), F.lit(0)).alias("open")))
        circling = hops.filter(F.col("most") < covered).select(*key)
        found = circling if found is None else found.union(circling)
        if not seen.get["open"]:
            return found.distinct().withColumn("cyclic", F.lit(True))
        going = hops.filter(F.col("most") >= covered)
        ahead = going.select(*key, F.col("at").alias("up"), F.col("up").alias("next"))
        hops, covered = going.join(ahead, [*key, "up"]).select(*key, "at", F.col("next").alias("up"), "most"), 2 * covered


def consent_reasons(modality: Column, start: Column, end: Column, as_of: Column, capture: str = "capture") -> list[tuple[Column, str]]:
    """Over an observation left-joined with its consent (consent_id, capture, derived_analysis, derived_retention, modalities, granted_at, withdrawn_at, expires_at)."""
    given = F.col("c_consent_id").isNotNull()
    permitted = F.col(capture) & F.col("derived_analysis") & F.col("derived_retention") & F.array_contains("modalities", modality)
    ended = (F.col("withdrawn_at") <= as_of) | (F.col("expires_at") <= F.greatest(end, as_of))
    return [(~given, "consent-missing"), (given & (~F.coalesce(permitted, F.lit(False)) | (F.col("granted_at") > start) | F.coalesce(ended, F.lit(False))), "consent-not-applicable")]


def binding_reasons(encounter: Column, source_kind: Column, start: Column, as_of: Column) -> list[tuple[Column, str]]:
    """Over an observation left-joined with its binding (b_binding_id, b_encounter_id, status, verification_method, b_recorded_at, revoked_at)."""
    given = F.col("b_binding_id").isNotNull()
    unverified = (F.col("b_status") != "verified") | (F.col("verification_method") == "unverified") | ((F.col("verification_method") == "synthetic-fixture") & (source_kind != "synthetic")) | (F.col("b_recorded_at") > start)
    revoked = F.coalesce(F.col("revoked_at") <= as_of, F.lit(False))
    return [(~given, "binding-missing"), (given & (unverified | revoked), "binding-not-verified"), (given & (F.col("b_encounter_id") != encounter), "binding-encounter-mismatch")]


def anchor_reasons(as_of: Column) -> Column:
    """Why a treatment (left-joined by the anchor's id; status, kind, verification, precision, latest) cannot be an anchor."""
    given = F.col("treatment_id").isNotNull()
    return S.reasons([
        (~given, "treatment-missing"), (given & (F.col("status") != "administered"), "treatment-not-administered"), (given & (F.col("kind") != "botulinum-injection"), "treatment-kind-not-supported"),
        (
            given & (F.col("verification") != "verified"), "treatment-not-verified"
        ), (given & (F.col("precision") == "unknown"), "treatment-time-unknown"), (given & (F.col("latest") > as_of), "treatment-time-in-future"),
    ])


def day_bounds(start: Column, end: Column, uncertainty_us: Column, anchor_start: Column, anchor_end: Column) -> tuple[Column, Column]:
    """First and last possible day since the anchor, widened by the clock's uncertainty."""
    return (start - uncertainty_us - anchor_end) / float(DAY_US), (end + uncertainty_us - anchor_start) / float(DAY_US)


def period(first: Column, last: Column, baseline_start: float, baseline_end: float, followup_end: float) -> Column:
    """baseline, followup, treatment-time-overlap or outside-analysis-window; null without an anchor."""
    return (
        F.when(first.isNull() | last.isNull(), None)
        .when((last < 0) & (first >= baseline_start) & (last <= baseline_end), "baseline")
        .when((first >= 0) & (last <= followup_end), "followup")
        .when((first < 0) & (last >= 0), "treatment-time-overlap")
        .otherwise("outside-analysis-window")
    )


def first_change(changes: DataFrame, scope: list[str], at: str) -> DataFrame:
    """The earliest change of each scope, and whether one has an unknown time: all that later rows need, so none fans out."""
    return changes.groupBy(*scope).agg(F.min(at).alias("first_change"), F.max(F.col(at).isNull()).alias("unknown_change"))


def reference_stratum(candidates: DataFrame, keys: list[str], fingerprint: str, is_baseline: str, order: list[str]) -> DataFrame:
    """With reference_fingerprint: that of the first baseline candidate, else of the first candidate."""
    rank = F.struct((~F.col(is_baseline)).alias("late"), *[F.col(c) for c in order])
    return candidates.withColumn("reference_fingerprint", F.min_by(fingerprint, rank).over(Window.partitionBy(*keys)))


def baseline(candidates: DataFrame, keys: list[str], encounter: str, value: str, least_observations: int, least_encounters: int) -> DataFrame:
    """The median of the encounters' medians, null where there are too few; and the reason why."""
    each = candidates.groupBy(*keys, encounter).agg(F.count("*").alias("n"), robust.median(value).alias("m"))
    grouped = each.groupBy(*keys).agg(F.sum("n").alias("baseline_n"), F.count("*").alias("baseline_encounters"), robust.median("m").alias("m"))
    reason = S.first_reason([(F.col("baseline_n") < least_observations, "insufficient-baseline-observations"), (F.col("baseline_encounters") < least_encounters, "insufficient-baseline-encounters")])
    return grouped.withColumn("baseline_reason", reason).withColumn("baseline_value", F.when(reason.isNull(), F.col("m"))).drop("m")


def phases_of(points: DataFrame, phases: DataFrame, first: str, last: str) -> DataFrame:
    """Each point with each phase that holds it: first >= start_day and last < end_day. phases is a small parameter table."""
    return points.join(phases, (F.col(first) >= F.col("start_day")) & (F.col(last) < F.col("end_day")))


def phase_coverage(points: DataFrame, rows: DataFrame, phases: DataFrame, keys: list[str], encounter: str, first: str, last: str) -> DataFrame:
    """For each row and phase: distinct encounters and missing, sparse or sufficient; phases without points too."""
    held = phases_of(points, phases, first, last).groupBy(*keys, "phase_id").agg(F.countDistinct(encounter).alias("encounters"))
    every = rows.select(*keys).crossJoin(phases.select("phase_id", "minimum_count"))  # a fixed handful of phases
    counted = every.join(held, [*keys, "phase_id"], "left").withColumn("encounters", F.coalesce("encounters", F.lit(0)).cast("long"))
    return counted.withColumn("status", F.when(F.col("encounters") == 0, "missing").when(F.col("encounters") < F.col("minimum_count"), "sparse").otherwise("sufficient"))


def row_status(n_points: Column, baseline_value: Column, n_followup: Column) -> Column:
    return F.when(n_points == 0, "no-comparable-data").when(baseline_value.isNull(), "insufficient-baseline").when(n_followup > 0, "observed").otherwise("insufficient-followup")
