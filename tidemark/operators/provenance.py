"""Audits of provenance: references that must resolve, thresholds that must hold, claims against what was seen.

Each audit gives rows with an array column `violations`, empty where nothing is wrong.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import robust

#: Sixteen times the spacing of doubles at 1, within which a rate must equal its count over its denominator.
RATE_TOLERANCE = 16 * 2.0**-52


def resolve_refs(refs: DataFrame, targets: DataFrame, keys: list[str], equal: list[str]) -> DataFrame:
    """refs with violations: each must name exactly one target by `keys`, and agree with it in the columns `equal` (t_<name> in targets)."""
    counted = targets.groupBy(*keys).agg(F.count("*").alias("target_n"), *[F.first(c).alias(f"t_{c}") for c in equal])
    joined = refs.join(counted, keys, "left")
    one = F.col("target_n") == 1
    checks = [(F.col("target_n").isNull(), "dangling-reference"), (F.col("target_n") > 1, "ambiguous-reference")] + [(one & ~F.col(c).eqNullSafe(F.col(f"t_{c}")), f"{c}-differs") for c in equal]
    return joined.withColumn("violations", S.reasons(checks)).drop("target_n", *[f"t_{c}" for c in equal])


def resolve_typed_refs(refs: DataFrame, targets: dict[str, DataFrame], scope: str, position: str) -> DataFrame:
    """refs (kind, target_id, scope, position) with violations, by one join against the targets of all kinds.

    targets, by kind: target_id, the scope that they belong to and the position at which they were recorded; a null scope is any, a null
    position always. A reference must name a known kind and exactly one target of it, in its own scope and recorded before its
    own position.
    """
    each = [df.select(F.lit(kind).alias("kind"), F.col("target_id").cast("string").alias("target_id"), F.col(scope).alias("t_scope"), F.col(position).alias("t_position")) for kind, df in targets.items()]
    counted = functools.reduce(DataFrame.unionByName, each).groupBy("kind", "target_id").agg(F.count("*").alias("t_n"), F.max("t_scope").alias("t_scope"), F.max("t_position").alias("t_position"))
    joined = refs.withColumn("target_id", F.col("target_id").cast("string")).join(counted, ["kind", "target_id"], "left")
    known, one = F.coalesce(F.col("kind").isin(*targets), F.lit(False)), F.col("t_n") == 1
    same = F.coalesce(F.col("t_scope").eqNullSafe(F.col(scope)) | F.col("t_scope").isNull(), F.lit(True))
    return joined.withColumn("violations", S.reasons([
        (~known, "unknown-kind"), (known & F.col("t_n").isNull(), "dangling-reference"), (F.col("t_n") > 1, "ambiguous-reference"), (one & ~same, "crosses-scope"),
        (one & same & ~F.coalesce(F.col("t_position") < F.col(position), F.lit(False)) & F.col("t_position").isNotNull(), "recorded-later"),
    ])).drop("t_n", "t_scope", "t_position")


def definition_errors(outcomes: DataFrame, registry: DataFrame, code: str, fields: list[str]) -> DataFrame:
    """outcomes with violations against the registry's row of their code, field by field, null being a value."""
    own = registry.select(code, *[F.col(f).alias(f"d_{f}") for f in fields], F.lit(True).alias("registered"))  # the library's own table of a few dozen metrics
    joined = outcomes.join(own, code, "left")
    known = F.coalesce("registered", F.lit(False))
    checks = [(~known, "unregistered-metric")] + [(known & ~F.col(f).eqNullSafe(F.col(f"d_{f}")), f"{f}-mismatch") for f in fields]
    return joined.withColumn("violations", S.reasons(checks)).drop("registered", *[f"d_{f}" for f in fields])


def threshold_errors(outcomes: DataFrame, requirements: str, facts: str) -> DataFrame:
    """outcomes with violations: each requirement minimumX or maximumX of a map must be met by the fact of that name; a missing fact is one."""

    def judge(name: Column, limit: Column) -> Column:
        fact = F.try_element_at(F.col(facts), name)
        return (
            F.when(fact.isNull(), F.concat(F.lit("missing:"), name))
            .when(name.startswith("minimum") & (fact < limit), F.concat(F.lit("below:"), name))
            .when(name.startswith("maximum") & (fact > limit), F.concat(F.lit("above:"), name))
        )

    entries = F.array_sort(F.map_entries(F.col(requirements)))
    return outcomes.withColumn("violations", F.coalesce(F.array_compact(F.transform(entries, lambda e: judge(e["key"], e["value"]))), F.array().cast("array<string>")))


def rate_holds(value: Column, count: Column, denominator: Column) -> Column:
    exact = F.try_divide(count.cast("double"), denominator.cast("double"))
    return F.coalesce(F.abs(value - exact) <= F.lit(RATE_TOLERANCE) * F.greatest(F.abs(value), F.abs(exact), F.lit(1.0)), F.lit(False))


def window_claims(claims: DataFrame, refs: DataFrame, windows: DataFrame, key: list[str], window: str, start: str, end: str) -> DataFrame:
    """claims with violations against the eligible ones of the windows that they refer to: distinct references, their union and their extent.

    claims: key, window_count, claimed_duration, and, each null where nothing is asked or said: minimum_span and claimed_span, minimum_exposure and
    claimed_exposure. A span or an exposure is held against the windows only where a minimum is asked. windows: window, start, end, and
    status where not all are eligible.
    """
    asked = {c: F.col(c) if c in claims.columns else F.lit(None).cast("double") for c in ("minimum_span", "claimed_span", "minimum_exposure", "claimed_exposure")}
    eligible = F.col("status") == "eligible" if "status" in windows.columns else F.lit(True)
    known = windows.select(window, F.when(eligible, F.col(start)).alias(start), F.when(eligible, F.col(end)).alias(end))
    resolved = refs.select(*key, window).distinct().join(known.withColumn("there", F.lit(True)), window, "left")
    union = robust.interval_union(resolved, key, start, end)
    counted = resolved.groupBy(*key).agg(F.count("*").alias("unique_refs"), F.count("there").alias("resolved"))
    counted = counted.join(refs.groupBy(*key).agg(F.count("*").alias("refs")), key)
    joined = claims.join(counted, key, "left").join(union, key, "left")
    zero = F.lit(0)
    unique, duration = F.coalesce("unique_refs", zero), F.coalesce("union_length", zero)
    span = F.coalesce(F.col("cover_end") - F.col("cover_start"), zero)
    beyond = lambda minimum, claimed, found: asked[minimum].isNotNull() & F.coalesce(asked[claimed] > found, F.lit(True))
    return joined.withColumn("violations", S.reasons([
        (F.coalesce("refs", zero) != unique, "repeated-window"), (F.col("window_count") != unique, "window-count"),
        ((F.col("claimed_duration") > duration) | (F.coalesce("resolved", zero) != unique), "duration-exceeds-windows"),
        (beyond("minimum_span", "claimed_span", span), "span-exceeds-windows"), (span < asked["minimum_span"], "span-below-minimum"),
        (beyond("minimum_exposure", "claimed_exposure", duration), "exposure-exceeds-windows"), (duration < asked["minimum_exposure"], "exposure-below-minimum"),
    ])).select(*claims.columns, "violations")


# Rules of single records: columns of violations.


def metric_rules() -> Column:
    """A metric is measured with value and quality and no reason, or withheld with neither value nor quality and a reason."""
    c = F.col
    measured, withheld = c("status") == "measured", c("status") == "withheld"
    return S.reasons([
        (~(measured | withheld), "unknown-status"), (measured & ~S.finite("value"), "measured-without-value"), (measured & (F.size("reason_codes") > 0), "measured-with-reason"),
        (withheld & c("value").isNotNull(), "withheld-with-value"), (withheld & (F.coalesce(F.size("reason_codes"), F.lit(0)) <= 0), "withheld-without-reason"),
        (~c("technical_quality_score").between(0, 1), "quality-out-of-range"),
    ])


def effective_time_rules(earliest: Column, latest: Column, precision: Column) -> Column:
    return S.reasons([
        ((precision == "unknown") & (earliest.isNotNull() | latest.isNotNull()), "unknown-with-bounds"), ((precision != "unknown") & (earliest.isNull() | latest.isNull()), "known-without-bounds"),
        (earliest > latest, "bounds-reversed"), ((precision == "instant") & (earliest != latest), "instant-with-range"), ((precision == "day") & (earliest == latest), "day-without-range"),
    ])


def consent_rules() -> Column:
    c = F.col
    return S.reasons([(c("expires_at") <= c("granted_at"), "expires-before-grant"), (c("withdrawn_at") < c("granted_at"), "withdrawn-before-grant")])


def modality_rules() -> Column:
    """Modalities are named once each, and by a consent to capture at all."""
    m = F.col("modalities")
    return S.reasons([((F.size(m) != F.size(F.array_distinct(m))) | (F.col("capture") & (F.size(m) == 0)), "modalities")])


def binding_rules() -> Column:
    c = F.col
    return S.reasons([
        ((c("status") == "verified") & (c("verification_method") == "unverified"), "verified-without-method"), ((c("status") == "revoked") & c("revoked_at").isNull(), "revoked-without-time"),
        ((c("status") != "revoked") & c("revoked_at").isNotNull(), "time-without-revocation"), (c("revoked_at") < c("recorded_at"), "revoked-before-record"),
    ])


def phase_rules(phases: DataFrame, key: list[str], followup_end: str) -> DataFrame:
    """phases (start_day, end_day) with violations: forward, not overlapping the one before, inside the follow-up."""
    w = Window.partitionBy(*key).orderBy("start_day", "end_day")
    checks = [
        (F.col("end_day") <= F.col("start_day"), "not-forward"), (F.lag("end_day").over(w) > F.col("start_day"), "overlaps-previous"),
        (F.col("end_day") > F.col(followup_end), "outside-followup")
    ]
    return phases.withColumn("violations", S.reasons(checks))


def observation_rules(observations: DataFrame, windows: DataFrame, metrics: DataFrame, revision: str = "revision_id") -> DataFrame:
    """observations with violations: chronology, window bounds, repeated windows and metric codes, usable time beyond the union of eligible windows."""
    held = windows.join(observations.select(revision, (F.col("ended_at") - F.col("started_at")).alias("length")), revision)
    bounds = held.groupBy(revision).agg(
        F.max((F.col("start_ms") < 0) | (F.col("end_ms") <= F.col("start_ms")) | (F.col("end_ms") > F.col("length"))).alias("bad_bounds"),
        (F.count("*") != F.countDistinct("window_id")).alias("repeated_window")
    )
    union = robust.interval_union(windows.filter("status = 'eligible'"), [revision], "start_ms", "end_ms").select(revision, "union_length")
    measured = metrics.groupBy(revision).agg((F.count("*") != F.countDistinct("metric_code")).alias("repeated_metric"), F.max("usable_duration_ms").alias("most_usable"))
    joined = observations.join(bounds, revision, "left").join(union, revision, "left").join(measured, revision, "left")
    return joined.withColumn("violations", S.reasons([
        (F.col("ended_at") <= F.col("started_at"), "ends-before-start"), (
            F.col("recorded_at") < F.col("ended_at"), "recorded-before-end"
        ), (F.col("bad_bounds"), "window-bounds"), (F.col("repeated_window"), "repeated-window"),
        (F.col("repeated_metric"), "repeated-metric"), (F.col("most_usable") > F.coalesce("union_length", F.lit(0)), "usable-exceeds-windows"),
    ])).drop("bad_bounds", "repeated_window", "repeated_metric", "most_usable", "union_length")


def scope_violations(records: DataFrame, scope: list[str], expected: DataFrame, key: list[str], record_id: str) -> DataFrame:
    """records with violations: another scope than its snapshot's, or an id that its list holds twice."""
    wanted = expected.select(*key, *[F.col(c).alias(f"x_{c}") for c in scope])
    crossed = F.lit(False)
    for c in scope:
        crossed = crossed | ~F.col(c).eqNullSafe(F.col(f"x_{c}"))
    repeated = F.count("*").over(Window.partitionBy(*key, record_id)) > 1
    return records.join(wanted, key).withColumn("repeated", repeated).withColumn(
        "violations", S.reasons([(crossed, "scope-crossed"), (F.col("repeated"), "repeated-record")])
    ).drop("repeated", *[f"x_{c}" for c in scope])
