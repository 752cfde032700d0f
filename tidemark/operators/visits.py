"""Comparison of two visits of a subject, metric by metric, and the evidence card that shows it.

visits: observation_id and the columns that VISIT_CHECKS and the chronology name. outcomes: observation_id, metric_code, context, modality, unit,
algorithm_version, processor_ref, status, value, quality. processors: observation_id, processor_ref, modality, runtime, runtime_version, asset_path,
asset_sha256, integrity_verified. definitions: metric_code, context, modality, unit, algorithm_version. pairs: reference_id and current_id.

Definitions and profiles have a row for each metric and are sent to all tasks: shuffled by metric, each metric would be one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.scratch import dealt

#: Reasons why two visits or metrics cannot be compared, in the order in which they are listed.
REASONS = [
    "subject-mismatch", "profile-id-mismatch", "profile-version-mismatch", "profile-digest-mismatch", "asserted-side-mismatch", "protocol-pack-id-mismatch", "protocol-version-mismatch", "protocol-digest-mismatch",
    "metric-missing", "metric-definition-mismatch", "modality-mismatch", "context-mismatch", "unit-mismatch", "algorithm-version-mismatch", "processor-ref-mismatch", "processor-provenance-missing", "processor-provenance-ambiguous",
    "processor-runtime-mismatch", "processor-runtime-version-mismatch", "processor-asset-path-mismatch", "processor-asset-digest-mismatch", "processor-asset-integrity-mismatch", "capture-adapter-id-mismatch", "capture-adapter-version-mismatch",
    "reference-withheld", "current-withheld", "reference-not-before-current", "non-finite-delta",
]
#: Columns that must be alike on both sides of a pair; several in one check must all be alike.
VISIT_CHECKS = [
    (["subject", "observed_subject"], "subject-mismatch"), (["profile_id"], "profile-id-mismatch"), (["profile_version"], "profile-version-mismatch"), (["profile_digest"], "profile-digest-mismatch"), (["side"], "asserted-side-mismatch"),
    (["protocol_id", "observed_protocol_id"], "protocol-pack-id-mismatch"), (
        ["protocol_version", "observed_protocol_version"], "protocol-version-mismatch"
    ), (["protocol_digest", "observed_protocol_digest"], "protocol-digest-mismatch"),
    (["adapter_id"], "capture-adapter-id-mismatch"), (["adapter_version"], "capture-adapter-version-mismatch"),
]
_DEFINED = ["context", "modality", "unit", "algorithm_version"]
_PROCESSOR = [
    ("runtime", "processor-runtime-mismatch"), ("runtime_version", "processor-runtime-version-mismatch"), ("asset_path", "processor-asset-path-mismatch"),
    ("asset_sha256", "processor-asset-digest-mismatch")
]


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}_{c}") for c in df.columns])


def global_reasons(pairs: DataFrame, visits: DataFrame) -> DataFrame:
    """pairs with global_reasons: what is unlike between the visits as such. A pair whose visit is missing is left out."""
    visits = dealt(visits, "observation_id")
    both = pairs.join(_prefixed(visits, "r"), F.col("reference_id") == F.col("r_observation_id")).join(_prefixed(visits, "c"), F.col("current_id") == F.col("c_observation_id"))
    checks = []
    for columns, reason in VISIT_CHECKS:
        first, *rest = [f"{side}_{c}" for side in ("r", "c") for c in columns]
        unlike = F.lit(False)
        for other in rest:
            unlike = unlike | ~F.col(first).eqNullSafe(F.col(other))
        checks.append((unlike, reason))
    late = (F.col("r_ended_at") >= F.col("c_started_at")) | (F.col("r_accepted_at") >= F.col("c_started_at"))
    return both.select(*pairs.columns, S.reasons([*checks, (late, "reference-not-before-current")]).alias("global_reasons"))


def resolved(outcomes: DataFrame, processors: DataFrame) -> DataFrame:
    """outcomes with found (how many processors have the outcome's reference) and processor, if it is one."""
    own = F.struct("modality", "runtime", "runtime_version", "asset_path", "asset_sha256", "integrity_verified")
    counted = dealt(processors, "observation_id", "processor_ref").groupBy("observation_id", "processor_ref").agg(F.count("*").alias("found"), F.first(own).alias("processor"))
    joined = outcomes.join(counted, ["observation_id", "processor_ref"], "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return joined.withColumn("processor", F.when(F.col("found") == 1, F.col("processor")))


def _source_reasons(side: str) -> list[tuple[Column, str]]:
    given, found = F.col(f"{side}_metric_code").isNotNull(), F.col(f"{side}_found")
    return [
        (given & (found == 0), "processor-provenance-missing"), (given & (found > 1), "processor-provenance-ambiguous"),
        (given & (found == 1) & (F.col(f"{side}_processor.modality") != F.col(f"{side}_modality")), "modality-mismatch")
    ]


def compare(pairs: DataFrame, visits: DataFrame, outcomes: DataFrame, processors: DataFrame, definitions: DataFrame, codes: list[str]) -> DataFrame:
    """One row per pair and listed metric: status (measured, withheld, incompatible), reasons, native_unit, delta, and both values and qualities.

    Incompatible beats withheld. Only a measured row shows values; the others keep their sources' identities.
    """
    defined = _prefixed(definitions, "d").withColumnRenamed("d_metric_code", "metric_code")
    unlike = F.lit(False)
    for c in _DEFINED:
        unlike = unlike | ~F.col(c).eqNullSafe(F.col(f"d_{c}"))
    sources = resolved(outcomes, processors).filter(F.col("metric_code").isin(*codes)).join(F.broadcast(defined), "metric_code", "left").withColumn("undefined", unlike).drop(*[f"d_{c}" for c in _DEFINED])
    sources = dealt(sources, "observation_id", "metric_code")
    every = global_reasons(pairs, visits).select("*", F.posexplode(F.array(*[F.lit(c) for c in codes])).alias("position", "metric_code"))
    r, c = F.col, F.col
    side = lambda p, key: _prefixed(sources, p).withColumnRenamed(f"{p}_observation_id", key).withColumn("metric_code", F.col(f"{p}_metric_code"))
    joined = every.join(side("r", "reference_id"), ["reference_id", "metric_code"], "left").join(side("c", "current_id"), ["current_id", "metric_code"], "left")
    both = r("r_metric_code").isNotNull() & c("c_metric_code").isNotNull()
    known = both & (r("r_found") == 1) & (c("c_found") == 1)
    differ = lambda x: both & ~F.col(f"r_{x}").eqNullSafe(F.col(f"c_{x}"))
    part = lambda s, x: F.col(f"{s}_processor.{x}")
    loose = F.lit(False)
    for s in ("r", "c"):
        loose = loose | ~F.coalesce(part(s, "integrity_verified"), F.lit(False)) | part(s, "asset_path").isNull() | part(s, "asset_sha256").isNull()
    own = S.reasons([
        (~both, "metric-missing"), (
            both & (r("r_undefined") | c("c_undefined")), "metric-definition-mismatch"
        ), (differ("modality"), "modality-mismatch"), (differ("context"), "context-mismatch"), (differ("unit"), "unit-mismatch"), (differ("algorithm_version"), "algorithm-version-mismatch"),
        (known & ~r("r_processor_ref").eqNullSafe(c("c_processor_ref")), "processor-ref-mismatch"), *_source_reasons("r"), *_source_reasons("c"),
        *[(known & ~part("r", x).eqNullSafe(part("c", x)), reason) for x, reason in _PROCESSOR], (known & loose, "processor-asset-integrity-mismatch"),
    ])
    listed = joined.withColumn("listed", S.in_listed_order(F.array_union("global_reasons", own), REASONS))
    withheld = S.reasons([(r("r_status") == "withheld", "reference-withheld"), (c("c_status") == "withheld", "current-withheld")])
    delta = c("c_value") - r("r_value")
    wild = (F.size("listed") == 0) & (F.size(withheld) == 0) & ~S.finite(delta)
    reasons = F.when(F.size("listed") > 0, F.col("listed")).when(wild, F.array(F.lit("non-finite-delta"))).otherwise(withheld)
    status = F.when((F.size("listed") > 0) | wild, "incompatible").when(F.size(withheld) > 0, "withheld").otherwise("measured")
    judged = listed.withColumns({"reasons": reasons, "status": status, "delta": delta})
    shown = lambda x: F.when(F.col("status") == "measured", F.col(x))
    return judged.select(
        *pairs.columns, "position", "metric_code", "status", "reasons", F.when(r("r_unit").eqNullSafe(c("c_unit")), r("r_unit")).alias("native_unit"), shown("delta").alias("delta"), shown("r_value").alias("reference_value"), shown("c_value").alias("current_value"),
        shown("r_quality").alias("reference_quality"), shown("c_quality").alias("current_quality"), r("r_processor_ref").alias("reference_processor"), c("c_processor_ref").alias("current_processor"),
    )


def summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows by status, and the least quality of the measured ones on either side."""
    count = lambda s: F.sum((F.col("status") == s).cast("long")).alias(s)
    return rows.groupBy(*keys).agg(
        count("measured"), count("withheld"), count("incompatible"), F.min("reference_quality").alias("reference_least_quality"),
        F.min("current_quality").alias("current_least_quality")
    )


def card_rows(rows: DataFrame, profile: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of a profile's metrics (metric_code, place, label, role), in its order; metrics without a row have none."""
    return rows.join(F.broadcast(profile), "metric_code").select(*keys, "place", "label", "role", *[c for c in rows.columns if c not in keys])


def row_violations() -> Column:
    """What is wrong with a comparison row as it stands: values beside the wrong status, a delta that is not current less reference, reasons out of place or order."""
    measured, delta = F.col("status") == "measured", F.col("current_value") - F.col("reference_value")
    held = F.array_contains("reasons", "reference-withheld") | F.array_contains("reasons", "current-withheld")
    return S.reasons([
        (~F.col("status").isin("measured", "withheld", "incompatible"), "unknown-status"), (
            measured & (F.col("delta").isNull() | F.col("current_value").isNull() | F.col("reference_value").isNull()), "measured-without-value"
        ),
        (measured & (F.col("delta") != delta), "delta-mismatch"), (
            ~measured & (F.col("delta").isNotNull() | F.col("current_value").isNotNull() | F.col("reference_value").isNotNull()), "excluded-with-value"
        ),
        (measured & (F.size("reasons") > 0), "measured-with-reason"), (~measured & (F.size("reasons") == 0), "excluded-without-reason"), (
            (F.col("status") == "withheld") & ~held, "withheld-without-withheld-source"
        ),
        ((F.col("status") == "incompatible") & held, "incompatible-with-withheld-reason"), (measured & F.col("native_unit").isNull(), "measured-without-unit"), (
            F.col("reasons") != S.in_listed_order("reasons", REASONS), "reasons-out-of-order"
        ),
    ])


def recomputed_violations(claimed: DataFrame, recomputed: DataFrame, keys: list[str]) -> DataFrame:
    """claimed rows with violations: their own, and status or reasons that are not those recomputed from the sources; recomputed rows that are missing."""
    again = dealt(recomputed.select(*keys, F.col("status").alias("now_status"), F.col("reasons").alias("now_reasons"), F.lit(True).alias("expected")), *keys)
    joined = claimed.withColumn("given", F.lit(True)).join(again, keys, "full")
    own = F.when(F.col("given"), row_violations()).otherwise(F.array().cast("array<string>"))
    other = S.reasons([
        (F.col("given").isNull(), "row-missing"), (F.col("expected").isNull(), "row-not-asked-for"),
        (F.col("given") & F.col("expected") & ((F.col("status") != F.col("now_status")) | (F.col("reasons") != F.col("now_reasons"))), "compatibility-not-recomputed")
    ])
    return joined.select(*keys, F.concat(own, other).alias("violations"))


def card_violations(cards: DataFrame, claimed: DataFrame, rows: DataFrame, profile: DataFrame, keys: list[str]) -> DataFrame:
    """keys and violations of cards (generated_at, compared_at, review_status, reviewed_at, and the summary's columns) against their claimed rows and the comparison's."""
    sums = [c for c in summary(rows, keys).columns if c not in keys]
    expected = summary(rows.join(F.broadcast(profile.select("metric_code")), "metric_code", "left_semi"), keys).select(*keys, *[F.col(c).alias(f"x_{c}") for c in sums])
    shown = F.struct("status", "delta", F.col("reasons").alias("reasons"))
    own = claimed.select(*keys, "place", "metric_code", shown.alias("claimed"))
    placed = own.join(F.broadcast(profile.select("metric_code", F.col("place").alias("own_place"))), "metric_code", "left").join(
        dealt(rows.select(*keys, "metric_code", shown.alias("compared")), *keys, "metric_code"), [*keys, "metric_code"], "left"
    )
    bad = placed.groupBy(*keys).agg(
        F.max(~F.col("place").eqNullSafe(F.col("own_place"))).alias("misplaced"), F.max(~F.col("claimed").eqNullSafe(F.col("compared"))).alias("altered"),
        F.count("*").alias("n")
    )
    wrong = F.lit(False)
    for c in sums:
        wrong = wrong | ~F.col(c).eqNullSafe(F.col(f"x_{c}"))
    joined = cards.join(expected, keys, "left").join(bad, keys, "left").crossJoin(profile.agg(F.count("*").alias("asked")))  # one row
    return joined.select(*keys, S.reasons([
        (F.col("generated_at") < F.col("compared_at"), "generated-before-comparison"), (
            F.col("misplaced") | ~F.col("n").eqNullSafe(F.col("asked")), "profile-order"
        ), (F.col("altered"), "row-altered"), (wrong, "summary-not-derived"),
        ((F.col("review_status") != "pending") & (F.col("reviewed_at") < F.col("generated_at")), "reviewed-before-generation"),
    ]).alias("violations"))


def reference_violations(references: DataFrame, visits: DataFrame, outcomes: DataFrame, codes: list[str]) -> DataFrame:
    """references (reference_id, subject, protocol_version, accepted_at) with violations against the observation they accept; every listed metric must be there."""
    visit = visits.select(
        F.col("observation_id").alias("reference_id"), F.col("observed_subject").alias("v_subject"), F.col("observed_protocol_version").alias("v_protocol"),
        F.col("ended_at").alias("v_ended")
    )
    held = outcomes.filter(F.col("metric_code").isin(*codes)).groupBy(F.col("observation_id").alias("reference_id")).agg(F.collect_set("metric_code").alias("held"))
    joined = references.join(visit, "reference_id", "left").join(held, "reference_id", "left")
    missing = F.array_sort(F.array_except(F.array(*[F.lit(c) for c in codes]), F.coalesce("held", F.array().cast("array<string>"))))
    seen = F.col("v_ended").isNotNull()
    listed = S.reasons([
        (~seen, "observation-missing"), (seen & ~F.col("subject").eqNullSafe(F.col("v_subject")), "subject-mismatch"),
        (seen & ~F.col("protocol_version").eqNullSafe(F.col("v_protocol")), "protocol-mismatch"),
        (F.col("accepted_at") < F.col("v_ended"), "accepted-before-completion")
    ])
    return joined.select("reference_id", F.concat(listed, F.transform(missing, lambda m: F.concat(F.lit("missing:"), m))).alias("violations"))
