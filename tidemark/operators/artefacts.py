"""Audits of whole artefacts: durable and session observations with their windows, measurements and outcomes, and protocol packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.scratch import materialize
from . import robust

#: A session lasts its stated time but for this.
DURATION_SLACK_MS = 1_000


def _repeated(df: DataFrame, key: list[str], value: str, name: str) -> DataFrame:
    return df.groupBy(*key).agg((F.count(value) != F.countDistinct(value)).alias(name))


def durable_violations(observations: DataFrame, windows: DataFrame, metrics: DataFrame, samples: DataFrame) -> DataFrame:
    """revision_id and violations of durable observations with all that hangs on them. The metrics' windows are written while the result is being planned.

    observations: revision_id, supersedes_revision_id, started_at_ms, ended_at_ms, recorded_at_ms. windows: revision_id, window_id, start_ms, end_ms, status, reason_codes.
    metrics: revision_id, metric_code, status, usable_ms, window_ids. samples: revision_id, metric_code, sample_id, start_ms, end_ms, window_ids.
    """
    key, c = ["revision_id"], F.col
    length = observations.select(*key, (c("ended_at_ms") - c("started_at_ms")).alias("length"))
    bad_window = (c("end_ms") <= c("start_ms")) | (c("end_ms") > c("length")) | ((c("w_status") == "withheld") & (F.coalesce(F.size("reason_codes"), F.lit(0)) == 0))
    own = windows.withColumnRenamed("status", "w_status")
    of_windows = own.join(length, key).groupBy(*key).agg(F.max(bad_window).alias("bad_window"), (F.count("*") != F.countDistinct("window_id")).alias("repeated_window"))
    refs = materialize(metrics.select(
        *key, "metric_code", c("status").alias("m_status"), "usable_ms", F.explode_outer("window_ids").alias("window_id")
    ).join(own.drop("reason_codes").dropDuplicates([*key, "window_id"]), [*key, "window_id"], "left"))
    lost = c("window_id").isNotNull() & (c("w_status").isNull() | ((c("m_status") == "measured") & (c("w_status") != "eligible")))
    by_metric = [*key, "metric_code"]
    attributed = refs.groupBy(*by_metric).agg(
        F.max(lost).alias("lost"), (F.count("window_id") != F.countDistinct("window_id")).alias("twice"), F.first("usable_ms").alias("usable_ms"),
        F.first("m_status").alias("m_status")
    )
    union = robust.interval_union(refs.filter("w_status = 'eligible'"), by_metric, "start_ms", "end_ms").select(*by_metric, "union_length")
    of_metrics = attributed.join(union, by_metric, "left").join(length, key).groupBy(*key).agg(
        F.max(c("lost") | c("twice") | (c("usable_ms") > c("length"))).alias("bad_metric"), F.max((c("m_status") == "measured") & (c("usable_ms") > F.coalesce("union_length", F.lit(0)))).alias("over_windows")
    )
    codes = _repeated(metrics, key, "metric_code", "repeated_metric")
    # a sample is covered if the eligible windows that it names reach from its start to its end without a hole
    named = samples.select(
        *by_metric, "sample_id", c("start_ms").alias("s0"), c("end_ms").alias("s1"), F.explode_outer("window_ids").alias("window_id")
    ).join(own.dropDuplicates([*key, "window_id"]), [*key, "window_id"], "left")
    by_sample = [*by_metric, "sample_id"]
    w = Window.partitionBy(*by_sample).orderBy("start_ms", "end_ms").rowsBetween(Window.unboundedPreceding, -1)
    fit = named.filter("w_status = 'eligible'").withColumn("reached", F.greatest(c("s0"), F.coalesce(F.max("end_ms").over(w), c("s0"))))
    holes = fit.groupBy(*by_sample).agg(F.min(F.when(c("start_ms") > c("reached"), c("reached"))).alias("hole_at"), F.max("end_ms").alias("to"))
    listed = metrics.select(*by_metric, c("status").alias("m_status"), c("window_ids").alias("m_windows"))
    judged = samples.join(listed, by_metric, "left").join(holes, by_sample, "left")
    reached = F.coalesce("hole_at", "to")
    foreign = F.size(F.array_except("window_ids", F.coalesce("m_windows", F.array().cast("array<string>")))) > 0
    bad_sample = ~c("m_status").eqNullSafe("measured") | (c("end_ms") <= c("start_ms")) | F.coalesce(reached < c("end_ms"), F.lit(True)) | (F.size("window_ids") != F.size(F.array_distinct("window_ids"))) | foreign
    of_samples = judged.groupBy(*key).agg(F.max(bad_sample).alias("bad_sample")).join(
        samples.groupBy(*by_metric).agg((F.count("*") != F.countDistinct("sample_id")).alias("x")).groupBy(*key).agg(F.max("x").alias("repeated_sample")), key
    )
    joined = observations
    for part in (of_windows, of_metrics, codes, of_samples):
        joined = joined.join(part, key, "left")
    return joined.select(*key, S.reasons([
        (
            (c("ended_at_ms") < c("started_at_ms")) | (c("recorded_at_ms") < c("ended_at_ms")), "chronology"
        ), (c("repeated_window") | c("repeated_metric"), "repeated-id"), (c("bad_window"), "window-bounds-or-reasons"), (c("bad_metric"), "metric-attribution"),
        (c("over_windows"), "usable-exceeds-windows"), (c("repeated_sample"), "repeated-sample"), (c("bad_sample"), "sample-coverage"), (
            c("revision_id").eqNullSafe(c("supersedes_revision_id")), "supersedes-itself"
        ),
    ]).alias("violations"))


def aggregate_id(prefix: str = "") -> Column:
    """The canonical identity of an outcome or measurement within its protocol and session."""
    return S.identity(
        "aggregate",
        *[f"{prefix}{c}" for c in ("protocol_id", "protocol_version", "session_id", "metric_code", "context", "unit", "algorithm_version", "processor_ref", "track_segment_id")]
    )


def measurement_id(aggregate: Column | str, window_id: Column | str, ordinal: Column | str) -> Column:
    return S.identity("measurement", aggregate, window_id, ordinal)


def session_violations(observations: DataFrame, windows: DataFrame, measurements: DataFrame, outcomes: DataFrame) -> DataFrame:
    """observation_id and violations of session observations.

    observations: observation_id, session_id, protocol_id, protocol_version, started_at_ms, ended_at_ms, duration_ms, consent_session, consent_recorded_at_ms, source_session, total_windows, eligible_windows, withheld_windows.
    windows: observation_id, window_id, session_id, end_ms, status. measurements: observation_id, measurement_id, aggregate_id, source_window_ids, ordinal and the identity's columns. outcomes: observation_id, outcome_id, aggregate_id and the identity's columns.
    """
    key, c = ["observation_id"], F.col
    parent = observations.select(*key, "session_id", "protocol_id", "protocol_version", "duration_ms")
    w = windows.withColumnRenamed("session_id", "w_session").join(parent, key)
    of_windows = w.groupBy(*key).agg(
        F.count("*").alias("n_windows"), F.sum((c("status") == "eligible").cast("long")).alias("n_eligible"),
        (F.count("*") != F.countDistinct("window_id")).alias("twice_w"),
        F.max(~c("w_session").eqNullSafe(c("session_id")) | (c("end_ms") > c("duration_ms"))).alias("outside")
    )
    bound = lambda df: df.drop("session_id", "protocol_id", "protocol_version").join(parent.drop("duration_ms"), key)
    repeated = lambda x: F.count("*") != F.size(F.collect_set(x))  # noqa: E731  (several distinct counts would shuffle each row once for each of them)
    o = bound(outcomes).groupBy(*key).agg(
        repeated("outcome_id").alias("twice_o"), repeated("aggregate_id").alias("twice_a"), repeated("metric_code").alias("twice_c"), F.max(c("aggregate_id") != aggregate_id()).alias("odd_o")
    )
    m0 = bound(measurements)
    m = m0.groupBy(*key).agg(
        (F.count("*") != F.countDistinct("measurement_id")).alias("twice_m"), F.max(c("aggregate_id") != aggregate_id()).alias("odd_a"),
        F.max(c("measurement_id") != measurement_id(aggregate_id(), F.get("source_window_ids", F.lit(0)), "ordinal")).alias("odd_m")
    )
    joined = observations.join(of_windows, key, "left").join(o, key, "left").join(m, key, "left").fillna(0, ["n_windows", "n_eligible"])
    counts = (c("total_windows") != c("n_windows")) | (c("eligible_windows") != c("n_eligible")) | (c("withheld_windows") != c("n_windows") - c("n_eligible"))
    length = c("ended_at_ms") - c("started_at_ms")
    return joined.select(*key, S.reasons([
        (length < 0, "ends-before-start"), (
            (length >= 0) & (F.abs(length - c("duration_ms")) > DURATION_SLACK_MS), "duration-mismatch"
        ), (~c("consent_session").eqNullSafe(c("session_id")), "consent-session"), (c("consent_recorded_at_ms") > c("started_at_ms"), "consent-after-start"),
        (
            ~c("source_session").eqNullSafe(c("session_id")), "source-session"
        ), (c("twice_w"), "repeated-window"), (c("twice_m"), "repeated-measurement"), (c("twice_o"), "repeated-outcome"), (c("twice_a"), "repeated-aggregate"), (c("twice_c"), "repeated-metric"),
        (counts, "window-counts"), (c("outside"), "window-outside-session"), (c("odd_o"), "outcome-identity"), (c("odd_a"), "measurement-aggregate-identity"), (c("odd_m"), "measurement-identity"),
    ]).alias("violations"))


_SAME = ["metric_code", "label", "modality", "context", "unit", "algorithm_version", "processor_ref", "track_segment_id"]
_PLACED = ["modality", "context", "processor_ref", "track_segment_id"]


def measurement_violations(measurements: DataFrame, outcomes: DataFrame, windows: DataFrame, refs: DataFrame) -> DataFrame:
    """session_id, measurement_id and violations: not referenced by an outcome, not resolving to its exact measured aggregate, or with a source window that is lost, withheld or unlike it.

    measurements: session_id, measurement_id, aggregate_id, source_window_ids and the columns that must agree. outcomes: session_id, aggregate_id, status and these. windows: session_id, window_id, status, modality, context, processor_ref, track_segment_id.
    refs: session_id and measurement_id of the outcomes' references.
    """
    key, c = ["session_id", "measurement_id"], F.col
    named = refs.select(*key).distinct().withColumn("referenced", F.lit(True))
    agg = outcomes.select("session_id", "aggregate_id", c("status").alias("o_status"), *[c(x).alias(f"o_{x}") for x in _SAME])
    unlike = lambda columns, p: F.greatest(*[(~c(x).eqNullSafe(c(f"{p}_{x}"))).cast("int") for x in columns]) == 1
    placed = windows.select("session_id", "window_id", c("status").alias("w_status"), *[c(x).alias(f"w_{x}") for x in _PLACED])
    sources = measurements.select(*key, *_PLACED, F.explode("source_window_ids").alias("window_id")).join(placed, ["session_id", "window_id"], "left")
    bad = sources.groupBy(*key).agg(F.max(c("w_status").isNull() | (c("w_status") != "eligible") | unlike(_PLACED, "w")).alias("bad_source"))
    joined = measurements.join(named, key, "left").join(agg, ["session_id", "aggregate_id"], "left").join(bad, key, "left")
    return joined.select(
        *key,
        S.reasons([
            (c("referenced").isNull(), "not-referenced"), (c("o_status").isNull() | (c("o_status") != "measured") | unlike(_SAME, "o"), "aggregate-mismatch"),
            (c("bad_source"), "source-window-mismatch")
        ]).alias("violations")
    )


def source_evidence_violations(outcomes: DataFrame, measurements: DataFrame, windows: DataFrame) -> DataFrame:
    """session_id, metric_code and violations of measured outcomes: the source windows of the measurements that they refer to must be just the windows they refer to.

    outcomes: session_id, metric_code, status, window_ids and measurement_ids (as referred to). measurements: session_id, measurement_id, source_window_ids. windows: session_id, window_id, status.
    """
    key, c = ["session_id", "metric_code"], F.col
    measured = outcomes.filter("status = 'measured'")
    named = measured.select(*key, F.explode(F.array_distinct("measurement_ids")).alias("measurement_id")).join(
        measurements.select("session_id", "measurement_id", "source_window_ids"), ["session_id", "measurement_id"]
    )
    each = named.select(*key, "measurement_id", (F.size("source_window_ids") != F.size(F.array_distinct("source_window_ids"))).alias("twice"), F.explode_outer("source_window_ids").alias("window_id"))
    known = each.join(windows.select("session_id", "window_id", c("status").alias("w_status")), ["session_id", "window_id"], "left")
    summed = known.groupBy(*key).agg(
        F.max("twice").alias("twice"), F.max(c("window_id").isNotNull() & c("w_status").isNull()).alias("lost"),
        F.max(c("w_status") != "eligible").alias("withheld"), F.collect_set("window_id").alias("covered")
    )
    joined = measured.join(summed, key, "left").withColumn("covered", F.coalesce("covered", F.array().cast("array<string>")))
    beyond, short = F.size(F.array_except("covered", "window_ids")) > 0, F.size(F.array_except("window_ids", "covered")) > 0
    return joined.select(*key, S.reasons([
        (
            F.size("measurement_ids") != F.size(F.array_distinct("measurement_ids")), "repeated-measurement-ref"
        ), (c("twice"), "repeated-source-window"), (c("lost"), "source-window-missing"), (c("withheld"), "source-window-withheld"), (beyond, "source-window-not-in-evidence"), (beyond | short, "windows-not-covered"),
    ]).alias("violations"))


def binding_violations(outcomes: DataFrame, codes: list[str]) -> DataFrame:
    """session_id, metric_code and violations for the listed metrics: more than one terminal outcome, or evidence counts that are not those of its references.

    outcomes: session_id, metric_code, window_ids, measurement_ids, window_count and measurement_count.
    """
    key, c = ["session_id", "metric_code"], F.col
    listed = outcomes.filter(c("metric_code").isin(*codes))
    wrong = (c("window_count") != F.size(F.array_distinct("window_ids"))) | (c("measurement_count") != F.size(F.array_distinct("measurement_ids")))
    grouped = listed.groupBy(*key).agg(F.count("*").alias("n"), F.max(wrong).alias("wrong"))
    return grouped.select(*key, S.reasons([(c("n") > 1, "several-outcomes"), ((c("n") == 1) & c("wrong"), "evidence-count")]).alias("violations"))


def pack_violations(packs: DataFrame, metrics: DataFrame, key: list[str]) -> DataFrame:
    """packs (content_sha256) with violations against their metrics (metric_code, report_section, report_order, definition): codes and places once each, and the digest of all definitions in order of their code."""
    place = F.struct("report_section", "report_order")
    grouped = metrics.groupBy(*key).agg((F.count("*") != F.countDistinct("metric_code")).alias("twice"), (F.count("*") != F.size(F.collect_set(place))).alias("same_place"), pack_digest().alias("now"))
    joined = packs.join(grouped, key, "left")
    return joined.select(
        *key,
        S.reasons([(F.col("twice"), "repeated-metric"), (F.col("same_place"), "repeated-report-order"), (~F.col("content_sha256").eqNullSafe(F.col("now")), "digest-mismatch")]).alias("violations")
    )


def pack_digest() -> Column:
    """Aggregate: the digest of a pack's metric definitions."""
    ordered = F.array_sort(F.collect_list(F.struct("metric_code", "report_section", "report_order", "definition")))
    return F.sha2(F.array_join(F.transform(ordered, lambda m: S.length_prefixed(m["metric_code"], m["report_section"], m["report_order"].cast("string"), m["definition"])), "|"), 256)
