"""Assembly of outcomes into observations: windows, metric rows, lane summaries, report sections, and their audits.

Outcomes are rows of session_id, metric_code, modality, status, reason_code, value, technical_quality_score,
eligible_ms, window_refs (array<string>) and processor_refs (array<string>).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .provenance import RATE_TOLERANCE

KEY = ["session_id"]


def registered_reason(reason: Column, allowed: Column, lane_available: Column, lane_reason: Column) -> Column:
    """struct(reason_code, problem): an unavailable lane overrides the extractor's reason; a reason that the metric does not list is a problem."""
    chosen = F.when(lane_available, reason).otherwise(lane_reason)
    return F.struct(chosen.alias("reason_code"), F.when(chosen.isNotNull() & ~F.array_contains(allowed, chosen), "reason-not-registered").alias("problem"))


def primary(refs: Column, modality: Column, what: str) -> Column:
    """The one reference, or <modality>-mixed-provenance for several, or <modality>-<what>-unavailable for none."""
    n = F.coalesce(F.size(refs), F.lit(0))
    return F.when(n == 1, F.get(refs, F.lit(0))).when(n > 1, F.concat(modality, F.lit("-mixed-provenance"))).otherwise(F.concat(modality, F.lit(f"-{what}-unavailable")))


def demoted(outcomes: DataFrame, processors: DataFrame) -> DataFrame:
    """Outcomes of which a measured one is withheld if its processor is not one known processor of its modality with a verified asset.

    processors: session_id, processor_ref, processor_modality, integrity_verified.
    """
    known = processors.groupBy(*KEY, "processor_ref").agg(F.count("*").alias("k"), F.min("processor_modality").alias("m"), F.min("integrity_verified").alias("v"))
    joined = outcomes.withColumn("processor_ref", primary(F.col("processor_refs"), F.col("modality"), "processor")).join(known, [*KEY, "processor_ref"], "left")
    failure = F.when(
        F.col("status") == "measured",
        S.first_reason([
            (F.coalesce(F.size("processor_refs"), F.lit(0)) > 1, "quality-threshold-failed"),
            (F.coalesce((F.col("k") != 1) | (F.col("m") != F.col("modality")), F.lit(True)), "processor-unavailable"), (~F.col("v"), "asset-integrity-failed")
        ])
    )
    kept = failure.isNull()
    return joined.withColumns({
        "reason_code": F.coalesce(failure, F.col("reason_code")), "status": F.when(kept, F.col("status")).otherwise("withheld"),
        "value": F.when(kept, F.col("value")), "technical_quality_score": F.when(kept, F.col("technical_quality_score"))
    }).drop("k", "m", "v")


def source_windows(outcomes: DataFrame) -> DataFrame:
    """The distinct windows that a session's outcomes refer to: window_id, start_ms, end_ms and violations (bounds that are none, or reversed)."""
    each = outcomes.select(*KEY, F.explode("window_refs").alias("window_ref")).distinct()
    low, high = S.window_ref_bounds(F.col("window_ref"))
    bounded = each.withColumns({"start_ms": low, "end_ms": high, "window_id": window_id(F.col("window_ref"))})
    return bounded.withColumn(
        "violations",
        S.reasons([(F.col("start_ms").isNull() | F.col("end_ms").isNull(), "malformed-reference"), ((F.col("start_ms") < 0) | (F.col("end_ms") <= F.col("start_ms")), "window-bounds")])
    )


def window_id(ref: Column) -> Column:
    return F.concat(F.lit("window-"), F.substring(F.sha2(ref, 256), 1, 24))


def metric_rows(outcomes: DataFrame) -> DataFrame:
    """Durable metric rows: value only where measured, reason_codes only where withheld, the ids of their windows."""
    measured = F.col("status") == "measured"
    return outcomes.select(
        *KEY, "metric_code", "modality", "status", F.when(measured, F.col("value")).alias("value"), F.when(measured, F.array().cast("array<string>")).otherwise(F.array_compact(F.array("reason_code"))).alias("reason_codes"),
        F.col("eligible_ms").alias("usable_duration_ms"), "technical_quality_score", F.coalesce(
            F.array_join(F.array_sort("processor_refs"), "+"), F.lit("unavailable")
        ).alias("processor_ref"), F.transform("window_refs", window_id).alias("source_window_ids"),
    )


def durable_observations(outcomes: DataFrame) -> DataFrame:
    """One row a session: fingerprint of its processors, its windows and metric rows as sorted arrays."""
    windows = source_windows(outcomes).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "window_id"))).alias("windows"))
    metrics = metric_rows(outcomes).groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("metric_code", "status", "value", "reason_codes", "source_window_ids"))).alias("metrics"))
    processors = outcomes.select(*KEY, F.explode_outer("processor_refs").alias("p")).groupBy(*KEY).agg(F.sha2(F.array_join(S.sorted_unique("p"), "|"), 256).alias("processor_fingerprint"))
    return metrics.join(processors, KEY).join(windows, KEY, "left")


def lane_summaries(outcomes: DataFrame) -> DataFrame:
    """state, eligible_ms (most), technical_quality_score (mean of the measured) and reason_codes (distinct) of each session's modality."""
    measured = F.col("status") == "measured"
    grouped = outcomes.groupBy(*KEY, "modality").agg(
        F.sum(measured.cast("long")).alias("measured"), F.max("eligible_ms").alias("eligible_ms"), F.avg(F.when(measured, F.col("technical_quality_score"))).alias("technical_quality_score"), S.sorted_unique(F.when(~measured, F.col("reason_code"))).alias("reason_codes")
    )
    return grouped.withColumn("state", F.when(F.col("measured") > 0, "ready").otherwise("withheld"))


def summary_errors(claimed: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Claimed lane summaries with violations against those of the outcomes."""
    true = lane_summaries(outcomes).select(*KEY, "modality", *[F.col(c).alias(f"t_{c}") for c in ("state", "eligible_ms", "technical_quality_score", "reason_codes")])
    near = lambda c: F.abs(F.col(c) - F.col(f"t_{c}")) <= F.lit(RATE_TOLERANCE) * F.greatest(F.lit(1.0), F.abs(c), F.abs(f"t_{c}"))
    ready = F.col("t_state") == "ready"
    score = F.col("technical_quality_score")
    joined = claimed.join(true, [*KEY, "modality"], "left")
    return joined.withColumn("violations", S.reasons([
        (
            ~F.coalesce(near("eligible_ms"), F.lit(False)), "eligible-duration"
        ), (ready & (F.col("state") != "ready"), "state-not-ready"), (~ready & (F.col("state") == "ready"), "ready-without-measurement"),
        (ready & ~F.coalesce(near("technical_quality_score"), F.lit(False)), "score"), (~ready & score.isNotNull(), "score-without-measurement"), (
            F.size(F.array_except("t_reason_codes", "reason_codes")) > 0, "reason-omitted"
        ),
    ])).select(*claimed.columns, "violations")


def report_sections(outcomes: DataFrame, sections: DataFrame, failures: DataFrame) -> DataFrame:
    """Sections (section, metric_code, position: a small table) of every session without provenance failures, their outcomes in order of position."""
    sound = outcomes.join(failures.select(*KEY).distinct(), KEY, "left_anti")
    placed = sound.join(sections, "metric_code")
    return placed.groupBy(*KEY, "section").agg(F.array_sort(F.collect_list(F.struct("position", "metric_code", "status", "value", "reason_code"))).alias("outcomes"), F.count("*").alias("n"))


def section_errors(reported: DataFrame, sections: DataFrame) -> DataFrame:
    """Reported rows (session_id, section, metric_code) with violations: another section than the metric's, or a metric that appears twice."""
    counted = reported.withColumn("times", F.count("*").over(Window.partitionBy(*KEY, "metric_code")))
    joined = counted.join(F.broadcast(sections.select("metric_code", F.col("section").alias("own_section"))), "metric_code", "left")  # by so few codes no rows are shuffled
    return joined.withColumn(
        "violations",
        S.reasons([(F.col("own_section").isNull(), "unregistered-metric"), (F.col("own_section") != F.col("section"), "wrong-section"), (F.col("times") > 1, "repeated-metric")])
    ).drop("own_section", "times")


def event_counter(code: Column) -> Column:
    """The name of the evidence count that a metric rests on, or null."""
    return S.first_reason([
        (
            code.isin("ambient.voice.pause_rate", "ambient.voice.pause_duration.median"), "pause_count"
        ), (code == "ambient.voice.speech_run_duration.median", "speech_run_count"), (code == "ambient.voice.acoustic_nucleus_rate", "nucleus_count"), (code == "ambient.face.blink_rate.bilateral", "blink_count"),
        (
            code.isin("ambient.face.spontaneous_event_rate", "ambient.face.spontaneous_excursion.p90", "ambient.face.spontaneous_excursion_asymmetry.median"),
            "expression_event_count"
        ), (code == "ambient.face.oculo_oral_synkinesis_index", "coupled_expression_event_count"),
    ])


#: The counts that event_counter() may name.
EVENT_COUNTERS = ["pause_count", "speech_run_count", "nucleus_count", "blink_count", "expression_event_count", "coupled_expression_event_count"]


def relevant_event_count(code: Column) -> Column:
    """The count that a metric rests on, 0 where it rests on none or it is unknown; over rows with the columns EVENT_COUNTERS."""
    name = event_counter(code)
    return F.coalesce(*[F.when(name == c, F.col(c)) for c in EVENT_COUNTERS], F.lit(0))


def quality_facts(names: list[str]) -> Column:
    """A map of the named numeric columns, those that are finite alone."""
    whole = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("double"))])
    return F.map_filter(whole, lambda k, v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(S.INFINITY)))
