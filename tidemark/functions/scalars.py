"""Scalar column functions: identities and digests, times, signal levels, clamps."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """Neither null, NaN nor infinite; never null itself."""
    c = col(c)
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(INFINITY)), F.lit(False))


def clamp01(c: Column | str) -> Column:
    """Within 0 and 1; null stays null."""
    return F.when(col(c).isNotNull(), F.least(F.greatest(col(c), F.lit(0.0)), F.lit(1.0)))


def safe_ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is 0 or either is null."""
    return F.try_divide(col(a), col(b))


def semitones(value: Column | str, reference: Column | str) -> Column:
    """12 log2(value / reference), null unless both are positive."""
    value, reference = col(value), col(reference)
    return F.when((value > 0) & (reference > 0), F.lit(12.0) * F.log2(value / reference))


def decibels_over(level: Column | str, floor: Column | str, least: float = 1e-4) -> Column:
    """Signal to noise in dB, not below 0; the floor counts as at least `least`."""
    given = finite(level) & finite(floor)
    return F.when(given, F.greatest(F.lit(20.0) * F.log10(F.greatest(col(level), F.lit(1e-12)) / F.greatest(F.lit(least), col(floor))), F.lit(0.0)))


def reasons(pairs: Iterable[tuple[Column, str]]) -> Column:
    """The names of all conditions that hold, in order; a null condition does not hold."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in pairs]))


def first_reason(pairs: Iterable[tuple[Column, str]], otherwise: Column | None = None) -> Column:
    """The name of the first condition that holds, or null."""
    out = None
    for c, name in pairs:
        out = F.when(c, F.lit(name)) if out is None else out.when(c, F.lit(name))
    return out.otherwise(otherwise) if otherwise is not None else out


def in_listed_order(values: Column | str, listed: Iterable[str]) -> Column:
    """The distinct values, in the order of the list; others are dropped."""
    return F.array_intersect(F.array(*[F.lit(x) for x in listed]), col(values))


def none_of(conditions: Iterable[tuple[Column, str]]) -> Column:
    """Whether no condition holds; a null one does not. What reasons() would list does not matter here, so no list is made."""
    out = lit_true = F.lit(True)
    for condition, _ in conditions:
        held = ~F.coalesce(condition, F.lit(False))
        out = held if out is lit_true else out & held
    return out


def sorted_unique(c: Column | str) -> Column:
    """Aggregate: the distinct non-empty strings in ascending order."""
    c = col(c)
    return F.array_sort(F.collect_set(F.when(c != "", c)))


def canonical_json(columns: dict[str, Column | str]) -> Column:
    """A JSON object with keys in ascending order; nulls stand as null."""
    return F.to_json(F.struct(*[col(columns[k]).alias(k) for k in sorted(columns)]), {"ignoreNullFields": "false"})


def digest(columns: dict[str, Column | str]) -> Column:
    return F.sha2(canonical_json(columns), 256)


def digest_verified(columns: dict[str, Column | str], sealed: Column | str) -> Column:
    return F.coalesce(digest(columns) == col(sealed), F.lit(False))


def length_prefixed(*parts: Column | str) -> Column:
    """Identity of several parts that no other parts share: each with its length in bytes before it; null as -1."""
    each = [F.coalesce(F.concat(F.octet_length(col(p)).cast("string"), F.lit(":"), col(p)), F.lit("-1:")) for p in parts]
    return F.concat_ws("|", *each)


def identity(prefix: str, *parts: Column | str) -> Column:
    """A deterministic id of its parts."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(length_prefixed(*[col(p).cast("string") for p in parts]), 256), 1, 24))


def window_ref(kind: str, *parts: Column | str) -> Column:
    return F.concat_ws(":", F.lit(kind), *[col(p).cast("string") for p in parts])


def window_ref_bounds(ref: Column | str) -> tuple[Column, Column]:
    """The last two parts of a window reference as start and end; null where they are no numbers."""
    parts = F.split(col(ref), ":")
    number = lambda k: F.expr("double(null)") if k is None else F.try_element_at(parts, F.lit(k)).try_cast("double")
    return number(-2), number(-1)


def clinical_time(text: Column | str, date_offset: Column | str | None = None) -> Column:
    """struct(earliest, latest, precision): an instant that names its offset, a whole day at date_offset (like -07:00, up to 14 hours), or unknown.

    date_offset is a column, or null. Without one, a day is unknown: no zone is taken from the session.
    """
    text = col(text)
    offset = F.lit(None).cast("string") if date_offset is None else col(date_offset)
    offset = F.when(offset.rlike(r"^[+-](0\d|1[0-4]):[0-5]\d$"), offset)
    instant = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$")
    at = F.when(instant, F.try_to_timestamp(text))
    day = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(F.concat(text, F.lit("T00:00:00"), offset)))
    return F.struct(
        F.coalesce(at, day).alias("earliest"), F.coalesce(at, day + F.expr("interval 1 day") - F.expr("interval 1 millisecond")).alias("latest"),
        F.when(day.isNotNull(), "day").when(at.isNotNull(), "instant").otherwise("unknown").alias("precision"),
    )


def coding_label(codings: Column | str) -> Column:
    """The first coding that has a system and a code, as system|code."""
    whole = F.filter(col(codings), lambda c: (c["system"] != "") & (c["code"] != ""))
    first = F.try_element_at(whole, F.lit(1))
    return F.concat_ws("|", first["system"], first["code"])


def positive_dose(value: Column | str, unit: Column | str) -> Column:
    """struct(value, unit) where the value is finite and positive and the unit is given, else null."""
    return F.when(finite(value) & (col(value) > 0) & (col(unit) != ""), F.struct(col(value).alias("value"), col(unit).alias("unit")))


def clock_calibration(
    received: Column | str, sent: Column | str, local_sent: Column | str, local_received: Column | str, elapsed: Column | str, source_error_ms: Column | str,
    valid_until: Column | str, slack_ms: float = 10.0, longest_ms: float = 2_000.0, lifetime_ms: float = 60_000.0
) -> Column:
    """struct(offset_ms, uncertainty_ms, expires_at_ms, error) of one probe of a clock source.

    elapsed is the round trip by a monotonic clock. The uncertainty is half of it (or of the wall clock's, if
    longer), the source's own error and 8 ms, rounded up; the source's end is brought to local time by it.
    """
    received, sent, a, b, elapsed, own, until = (col(c) for c in (received, sent, local_sent, local_received, elapsed, source_error_ms, valid_until))
    known = finite(received) & finite(sent) & finite(a) & finite(b) & finite(elapsed) & finite(own) & finite(until)
    offset = ((received - a) + (sent - b)) / 2
    uncertainty = F.ceil(F.greatest(elapsed, b - a) / 2 + own + 8).cast("double")
    expires = F.least(b + lifetime_ms, until - offset - uncertainty)
    error = first_reason([
        (~known, "invalid-probe"), (
            (elapsed < 0) | (elapsed > longest_ms) | (b < a) | (F.abs((b - a) - elapsed) > slack_ms), "local-clock-discontinuity"
        ), ((sent < received) | (sent - received > elapsed + 2), "invalid-round-trip"), (expires <= b, "source-expired"),
    ])
    kept = lambda c, name: F.when(error.isNull(), c).alias(name)
    return F.struct(kept(offset, "offset_ms"), kept(uncertainty, "uncertainty_ms"), kept(expires, "expires_at_ms"), error.alias("error"))


def selected_calibration(source: Column | str, offset_ms: Column | str, uncertainty_ms: Column | str, expires_at_ms: Column | str, now: Column | str, identity: Column | str) -> Column:
    """Aggregate: struct(id, error) of the least uncertain of several clock calibrations that hold now; they must share a source and their bounds must overlap."""
    source, offset, wide, expires, now, own = (col(c) for c in (source, offset_ms, uncertainty_ms, expires_at_ms, now, identity))
    held = expires > now
    low, high = F.max(F.when(held, offset - wide)), F.min(F.when(held, offset + wide))
    error = first_reason([(F.count(F.when(held, 1)) == 0, "none-valid"), (F.count_distinct(F.when(held, source)) > 1, "several-sources"), (low > high, "inconsistent")])
    return F.struct(F.when(error.isNull(), F.min_by(own, F.when(held, F.struct(wide, own)))).alias("id"), error.alias("error"))
