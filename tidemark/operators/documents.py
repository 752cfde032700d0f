"""Artefacts as documents: one nested row for each session, and the rows that it was made of.

All that belongs to a session comes together in one shuffle; windows, measurements, lanes and sections are made of it by array
functions within the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .assembly import KEY, window_id

#: Modalities with a lane, and the facts of the section on capture quality with their units.
MODALITIES = ["voice", "face"]
QUALITY_SECTION = "capture-quality"
QUALITY_FACTS = [("session-duration", "milliseconds"), ("voice-lane", None), ("face-lane", None), ("eligible-windows", "windows"), ("withheld-windows", "windows")]
_OUTCOME = ["metric_code", "modality", "status", "reason_code", "value", "technical_quality_score", "eligible_ms", "window_refs", "processor_refs"]


def _measured(outcome: Column) -> Column:
    return outcome["status"] == "measured"


def _windows(outcomes: Column) -> Column:
    """The distinct windows by their reference; one that a measured outcome rests on is eligible."""
    refs = lambda some: F.array_sort(F.array_distinct(F.flatten(F.transform(some, lambda o: F.coalesce(o["window_refs"], F.array().cast("array<string>"))))))
    good = refs(F.filter(outcomes, _measured))

    def window(ref: Column, good: Column) -> Column:
        low, high = S.window_ref_bounds(ref)
        return F.struct(window_id(ref).alias("window_id"), ref.alias("ref"), low.alias("start_ms"), high.alias("end_ms"), F.when(F.array_contains(good, ref), "eligible").otherwise("withheld").alias("status"))

    # bound by a lambda of its own, the good ones are listed once a row and not once a window
    return F.flatten(F.transform(F.array(good), lambda g: F.transform(refs(outcomes), lambda ref: window(ref, g))))


def _lane(outcomes: Column, modality: str) -> Column:
    own = F.filter(outcomes, lambda o: o["modality"] == modality)
    scores = F.filter(F.transform(F.filter(own, _measured), lambda o: o["technical_quality_score"]), lambda x: x.isNotNull())
    reasons = F.filter(F.transform(F.filter(own, lambda o: ~_measured(o)), lambda o: o["reason_code"]), lambda x: x.isNotNull())
    mean = F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(scores))
    state = F.when(F.exists(own, _measured), "ready").when(F.size(own) > 0, "withheld").otherwise("absent")
    return F.struct(
        F.lit(modality).alias("modality"), state.alias("state"), F.coalesce(F.array_max(F.transform(own, lambda o: o["eligible_ms"].cast("double"))), F.lit(0.0)).alias("eligible_ms"),
        mean.alias("technical_quality_score"), F.array_sort(F.array_distinct(reasons)).alias("reason_codes"),
    )


def _facts() -> Column:
    """QUALITY_FACTS of a row with duration_ms, lanes and windows: a number or a text each."""
    state = lambda m: F.get(F.transform(F.filter("lanes", lambda x: x["modality"] == m), lambda x: x["state"]), F.lit(0))
    count = lambda s: F.size(F.filter("windows", lambda w: w["status"] == s)).cast("double")
    values = {"session-duration": F.col("duration_ms").cast("double"), "voice-lane": state("voice"), "face-lane": state("face"), "eligible-windows": count("eligible"), "withheld-windows": count("withheld")}
    none = {True: F.lit(None).cast("double"), False: F.lit(None).cast("string")}
    return F.array(*[
        F.struct(
            F.lit(code).alias("code"), (values[code] if unit else none[True]).alias("number"), (none[False] if unit else values[code]).alias("text"), F.lit(unit).cast("string").alias("unit")
        ) for code, unit in QUALITY_FACTS
    ])


def session_documents(outcomes: DataFrame, sessions: DataFrame, failures: DataFrame, sections: list[tuple[str, str, int]]) -> DataFrame:
    """One document a session that has an outcome: session_id, duration_ms, outcomes (by code), windows, measurements, lanes, provenance_failed and sections.

    sessions: session_id, duration_ms. failures: session_id of each whose provenance does not hold; it has no sections. sections: the
    protocol's (section, metric_code, position), a short list; the section on capture quality comes first and holds the facts. Outcomes of
    other metrics are in no section. A session whose length is not known has a null one.
    """
    whole = lambda df, **more: df.select(*KEY, *[more.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])
    outcome = F.struct(*_OUTCOME)
    kinds = {"outcome": outcomes.select(outcome.alias("o")).schema["o"].dataType, "duration_ms": "double", "failed": "boolean"}
    parts = whole(outcomes, outcome=outcome).unionByName(whole(sessions, duration_ms=F.col("duration_ms"))).unionByName(whole(failures, failed=F.lit(True)))
    gathered = parts.groupBy(*KEY).agg(F.sort_array(F.collect_list("outcome")).alias("outcomes"), F.max("duration_ms").alias("duration_ms"), F.coalesce(F.max("failed"), F.lit(False)).alias("provenance_failed"))
    found = gathered.filter(F.size("outcomes") > 0).withColumns({
        "windows": _windows(F.col("outcomes")),
        "measurements": F.transform(F.filter("outcomes", _measured), lambda o: F.struct(
            o["metric_code"].alias("metric_code"), o["value"].alias("value"), o["technical_quality_score"].alias("technical_quality_score"), F.transform(o["window_refs"], window_id).alias("window_ids")
        )),
        "lanes": F.array(*[_lane(F.col("outcomes"), m) for m in MODALITIES]),
    })

    def section(name: str) -> Column:
        codes = [c for _, c in sorted((p, c) for s, c, p in sections if s == name)]
        of = lambda code: F.filter("outcomes", lambda o: o["metric_code"] == code)
        placed = F.flatten(F.array(*map(of, codes))) if codes else F.slice("outcomes", 1, 0)
        facts = _facts() if name == QUALITY_SECTION else F.slice(_facts(), 1, 0)
        return F.struct(F.lit(name).alias("section"), facts.alias("facts"), F.transform(placed, lambda o: o["metric_code"]).alias("metric_codes"))

    names = [QUALITY_SECTION, *dict.fromkeys(s for s, _, _ in sections if s != QUALITY_SECTION)]
    told = F.array(*[section(n) for n in names])
    return found.withColumn("sections", F.when(~F.col("provenance_failed"), told)).select(
        *KEY, "duration_ms", "outcomes", "windows", "measurements", "lanes", "provenance_failed", "sections"
    )


def outcomes_of(documents: DataFrame) -> DataFrame:
    """The outcome rows that documents were made of."""
    return documents.select(*KEY, F.inline("outcomes"))


def windows_of(documents: DataFrame) -> DataFrame:
    return documents.select(*KEY, F.inline("windows"))


def lanes_of(documents: DataFrame) -> DataFrame:
    return documents.select(*KEY, F.inline("lanes"))


def section_rows(documents: DataFrame) -> DataFrame:
    """session_id, section, facts and metric_codes of each section; none of a session whose provenance does not hold."""
    return documents.select(*KEY, F.inline("sections"))


def facts_of(documents: DataFrame) -> DataFrame:
    """session_id, code, number, text and unit of each quality fact."""
    return section_rows(documents).select(*KEY, F.inline("facts"))
