"""Comparison of a record with the one before it: compatibility reasons, status and delta."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def with_previous(df: DataFrame, keys: list[str], order: list[str], columns: list[str], prefix: str = "prev_") -> DataFrame:
    """With the named columns of the row before, null for the first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({f"{prefix}{c}": F.lag(c).over(w) for c in columns})


def mismatch_reasons(pairs: list[tuple[str, str]], prefix: str = "prev_") -> list[tuple[Column, str]]:
    """(column, reason): the reason holds where the column differs from the previous one's, null counting as a value."""
    return [(~F.col(c).eqNullSafe(F.col(f"{prefix}{c}")), reason) for c, reason in pairs]


def comparison(reasons: Column, reference_status: Column, current_status: Column, reference: Column, current: Column) -> tuple[Column, Column, Column]:
    """(status, delta, reasons): incompatible beats withheld, and only two measured values give a delta; a delta that is not finite is incompatible."""
    delta = current - reference
    wild = (F.size(reasons) == 0) & (reference_status == "measured") & (current_status == "measured") & ~S.finite(delta)
    status = F.when((F.size(reasons) > 0) | wild, "incompatible").when((reference_status != "measured") | (current_status != "measured"), "withheld").otherwise("measured")
    return status, F.when(status == "measured", delta), F.when(wild, F.array(F.lit("non-finite-delta"))).otherwise(reasons)


def redacted(columns: list[str], status: Column, keep_when: str = "measured") -> dict[str, Column]:
    """The columns without their values in rows of any other status."""
    return {c: F.when(status == keep_when, F.col(c)) for c in columns}


def resolved_processors(outcomes: DataFrame, processors: DataFrame, keys: list[str], ref: str, modality: str) -> DataFrame:
    """Outcomes with processor_reason: provenance missing, ambiguous, of another modality, or null; and the one processor's columns."""
    found = processors.groupBy(*keys, ref).agg(F.count("*").alias("processor_n"), F.min(modality).alias("processor_modality"))
    reason = S.first_reason([
        (F.col("processor_n").isNull(), "processor-provenance-missing"), (F.col("processor_n") > 1, "processor-provenance-ambiguous"), (
            F.col("processor_modality") != F.col(modality), "modality-mismatch"
        ),
    ])
    return outcomes.join(found, [*keys, ref], "left").withColumn("processor_reason", reason).drop("processor_n")


def quality_summary(rows: DataFrame, keys: list[str], status: str, reference_quality: str, current_quality: str) -> DataFrame:
    """Counts of each status and the least quality of the measured rows on either side."""
    count = lambda s: F.sum((F.col(status) == s).cast("long")).alias(f"{s}_rows")
    least = lambda c: F.min(F.when(F.col(status) == "measured", F.col(c)))
    return rows.groupBy(*keys).agg(
        count("measured"), count("withheld"), count("incompatible"), least(reference_quality).alias("least_reference_quality"),
        least(current_quality).alias("least_current_quality")
    )
