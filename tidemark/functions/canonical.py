"""Canonical JSON of nested columns, by their types: one text for one value, and its digest.

Struct fields and map keys come in the order of their names, whatever order the columns have; nulls stand as null. Numbers have the digits that
the JVM gives them: whole ones stand without a point, others without an exponent from a millionth up to 1e21. NaN and infinities are null.
Timestamps are UTC to the millisecond. Built-in expressions only.
"""

from __future__ import annotations

import json
from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The fields that are hashed of an input, and those that are left out of a review.
INPUT_FIELDS = ["kind", "logicalId", "replacesRecordId", "payload", "sourceProvenance"]
REVIEW_VOLATILE = ["reviewId", "recordedAt"]


def _quoted(text: Column) -> Column:
    """A JSON string."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _double(x: Column) -> Column:
    digits, size = x.cast("string"), F.abs(x)
    stripped = lambda scale: F.regexp_replace(F.regexp_replace(digits.try_cast(f"decimal(38,{scale})").cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    exponent = F.regexp_replace(F.regexp_replace(F.regexp_replace(digits, r"\.0E", "E"), "E-", "e-"), "E", "e+")
    return (
        F.when(F.isnan(x) | (size == F.lit(float("inf"))), "null").when(x == 0, "0").when((size < 1e21) & (x == F.rint(x)), digits.try_cast("decimal(38,0)").cast("string"))
        .when((size >= 1e-6) & (size < 1), stripped(30)).when((size >= 1) & (size < 1e21), stripped(20)).otherwise(exponent)
    )


def canonical(c: Column, kind: T.DataType, without: Collection[str] = ()) -> Column:
    """The canonical JSON of a column of that type; struct fields and map keys in without are left out at any depth."""
    if isinstance(kind, T.StructType):
        parts = [F.concat(F.lit(f"{_name(f.name)}:"), canonical(c[f.name], f.dataType, without)) for f in sorted(kind.fields, key=lambda f: f.name) if f.name not in without]
        text = F.when(c.isNotNull(), F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: canonical(x, kind.elementType, without)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType):
        entries = F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(e["key"].cast("string").alias("k"), canonical(e["value"], kind.valueType, without).alias("v"))))
        kept = F.filter(entries, lambda e: ~e["k"].isin(*without)) if without else entries
        text = F.concat(F.lit("{"), F.array_join(F.transform(kept, lambda e: F.concat(_quoted(e["k"]), F.lit(":"), e["v"])), ","), F.lit("}"))
    elif isinstance(kind, T.BooleanType | T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        text = c.cast("string")
    elif isinstance(kind, T.DoubleType):
        text = _double(c)
    elif isinstance(kind, T.FloatType):
        text = _double(c.cast("string").cast("double"))
    elif isinstance(kind, T.DecimalType):
        text = F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "") if kind.scale else c.cast("string")
    elif isinstance(kind, T.TimestampType):
        utc = F.to_utc_timestamp(c, F.current_timezone())
        text = F.concat(F.lit('"'), F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit('"'))
    elif isinstance(kind, T.BinaryType):
        text = _quoted(F.base64(c))
    elif isinstance(kind, T.VariantType):
        text = F.to_json(c)  # objects of variants have their keys in order
    else:
        text = _quoted(c.cast("string"))
    return F.coalesce(text, F.lit("null"))


def _name(name: str) -> str:
    return json.dumps(name, ensure_ascii=False)


def canonical_row(df: DataFrame, columns: list[str] | None = None, without: Collection[str] = ()) -> Column:
    """The canonical JSON of some of df's columns, or of all, as one object."""
    kind = T.StructType([f for f in df.schema.fields if columns is None or f.name in columns])
    return canonical(F.struct(*[F.col(f"`{f.name}`") for f in kind.fields]), kind, without)


def row_digest(df: DataFrame, columns: list[str] | None = None, without: Collection[str] = ()) -> Column:
    return F.sha2(canonical_row(df, columns, without), 256)


def input_digest(inputs: DataFrame) -> Column:
    """The content hash of appended inputs: INPUT_FIELDS, null where a field is null."""
    return row_digest(inputs, INPUT_FIELDS)


def review_digest(reviews: DataFrame, payload: str = "payload") -> Column:
    """The content hash of a review's payload, without what changes each time it is recorded (at the top level only)."""
    kind = reviews.schema[payload].dataType
    kept = T.StructType([f for f in kind.fields if f.name not in REVIEW_VOLATILE])
    return F.sha2(canonical(F.struct(*[F.col(payload)[f.name].alias(f.name) for f in kept.fields]), kept), 256)


def json_digest(text: Column) -> Column:
    """The digest of JSON text, whatever the order of its keys; null where it is no JSON."""
    return F.sha2(F.to_json(F.try_parse_json(text)), 256)
