"""Quality rules (9): cross-document line frequency by host, over word and line statistics of whole texts.

Each line with a word is normalised (A-Z lowered, digits alike, white space runs alike) and hashed. For
each host, the distinct documents that hold a line are counted; documents of equal text count once, so
that copies do not condemn each other. A line in more than min_docs documents and in more than max_share
of its host's documents is removed. With copies, the parameters of near_duplicates, each class of near copies
counts once instead of each text. With many_docs, a line in more documents than that goes whatever its share,
so that size does not shelter the lines of a very large host. A document that keeps less than least_left of its words is rejected,
as is one that fails the base rules: fewer than 50 words, or over half of its words in 3-word windows that
repeat. A null host is a host of its own.

Null, empty or blank text: all counts are 0, base_failed. Empty table: no rows. Repeated rows are judged
alike. Columns that the input has besides are kept by annotate(); those named as an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import neardup
from .common import Run, chain_hashes, key_hashes, lowered, materialize, mix, release_memory, span_hashes, span_keys, spans, text_slices, words

_STATS_DDL = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, lines array<struct<line: binary, words: int>>"
_LINE = pa.struct([("line", pa.binary()), ("words", pa.int32())])
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_STATS = pa.struct([*[(c, pa.int64()) for c in _COUNTS], ("base_failed", pa.bool_()), ("lines", pa.list_(_LINE))])

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
#: 1 for bytes that begin a code point and are not white space.
_CHAR = np.ones(256, np.int64)
_CHAR[_SPACES] = 0
_CHAR[0x80:0xC0] = 0
_DIGITS = np.arange(256, dtype=np.uint8)
_DIGITS[48:58] = 48
#: Parts over which a frequent line's rows are dealt, where they meet the list of frequent lines.
SALTS = 16


def _between(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(values)))[bounds])


def lines_of(data: np.ndarray, offsets: np.ndarray):
    """Lines that have a word: starts, ends, document, key of the normalised line (two halves), number of words; and the words' bounds."""
    starts, ends, bounds = words(data, offsets)
    line_starts, line_ends = spans(data != 10, offsets)
    first, last = np.searchsorted(starts, line_starts), np.searchsorted(starts, line_ends)
    full = first < last
    line_starts, line_ends, first, last = line_starts[full], line_ends[full], first[full], last[full]
    document = np.searchsorted(offsets, line_starts, "right") - 1
    even, inner = _DIGITS[lowered(data)], np.ones(len(starts), bool)
    inner[last - 1] = False
    kept = ~_SPACES[data]
    kept[ends[inner]] = True  # one space between two words of a line
    even[ends[inner]] = 32
    place = np.concatenate(([0], np.cumsum(kept)))
    return line_starts, line_ends, document, span_keys(even[kept], place[starts[first]], place[ends[last - 1]]), last - first, (starts, ends, bounds)


def text_stats(data: np.ndarray, offsets: np.ndarray) -> pa.StructArray:
    n = len(offsets) - 1
    line_starts, line_ends, document, keys, line_words, (starts, ends, bounds) = lines_of(data, offsets)
    n_words = np.diff(bounds)
    salt = lambda d: d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, once = np.unique(mix(span_hashes(data, line_starts, line_ends) + salt(document)), return_index=True)
    n_dup = np.bincount(document, minlength=n) - np.bincount(document[once], minlength=n)
    owner = np.repeat(np.arange(n), n_words)
    chained = chain_hashes(span_hashes(data, starts, ends), 3)
    covered = np.zeros(len(starts), np.int64)
    inside = np.flatnonzero(owner[2:] == owner[:-2]) if len(starts) >= 3 else np.zeros(0, np.int64)
    if len(inside):
        _, which, count = np.unique(mix(chained[inside] + salt(owner[inside])), return_inverse=True, return_counts=True)
        twice = inside[count[which] > 1]
        for k in range(3):
            covered[twice + k] = 1
    n_repeat = _between(covered, bounds)
    _, at, which = np.unique(mix(key_hashes(*keys) + salt(document)), return_index=True, return_inverse=True)
    total = np.bincount(which, weights=line_words, minlength=len(at)).astype(np.int32) if len(at) else np.zeros(0, np.int32)
    order = np.argsort(document[at], kind="stable")
    line_bounds = np.concatenate(([0], np.cumsum(np.bincount(document[at], minlength=n)))).astype(np.int32)
    raw = np.stack(keys, 1)[at[order]].tobytes()
    named = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.arange(0, len(raw) + 1, 16, np.int32)), pa.py_buffer(raw)])
    lines = pa.ListArray.from_arrays(pa.array(line_bounds), pa.StructArray.from_arrays([named, pa.array(total[order])], fields=list(_LINE)))
    failed = (n_words < 50) | (100 * n_repeat > 50 * n_words)
    columns = [n_words, _between(_CHAR[data], offsets), _between(_SYMBOL[data], offsets), n_dup, n_repeat]
    return pa.StructArray.from_arrays([*[pa.array(c.astype(np.int64)) for c in columns], pa.array(failed), lines], fields=list(_STATS))


def _stats(column: pa.Array) -> pa.Array:
    out = pa.concat_arrays([text_stats(data, offsets) for _, _, data, offsets in text_slices(column)] or [pa.array([], _STATS)])
    release_memory()
    return out


def _stripped(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Texts without the lines whose hashes are listed beside them."""
    for texts, removed in batches:
        out: list[bytes | None] = []
        valid = texts.is_valid().to_pylist()
        bad = removed.to_pylist()
        for low, _, data, offsets in text_slices(texts):
            line_starts, line_ends, document, keys, _, _ = lines_of(data, offsets)
            raw = np.stack(keys, 1).tobytes()
            at = np.searchsorted(document, np.arange(len(offsets)))
            for k in range(len(offsets) - 1):
                keep = np.ones(offsets[k + 1] - offsets[k], bool)
                if bad[low + k]:
                    gone = set(bad[low + k])
                    for line in range(at[k], at[k + 1]):
                        if raw[16 * line : 16 * line + 16] in gone:
                            keep[line_starts[line] - offsets[k] : line_ends[line] - offsets[k] + 1] = False  # with its line end
                out.append(data[offsets[k] : offsets[k + 1]][keep].tobytes() if valid[low + k] else None)
        yield pa.array(out, pa.binary()).cast(pa.string())


def _votes(held: DataFrame, copies: dict[str, int]) -> DataFrame:
    """row and print, which is alike for near copies; texts without words are alike."""
    with Run().active() as run:
        found = neardup.near_duplicates(held, "row", "text", **copies)
        votes = found.select(F.col("doc_id").alias("row"), F.when(F.col("n_shingles") > 0, F.col("component_id").cast("string")).otherwise("").alias("print"))
    kept = materialize(votes)
    run.delete(held.sparkSession)
    return kept


def annotate(
    docs: DataFrame,
    text_col: str = "text",
    host_col: str = "source",
    min_docs: int = 50,
    max_share: float = 0.01,
    least_left: float = 0.3,
    keep_text: bool = True,
    copies: dict[str, int] | None = None,
    many_docs: int | None = None,
) -> DataFrame:
    """The documents with the statistics, kept_words, base_failed, kept, and removed_lines (keys; null if none). keep_text=False leaves the text out.

    Tables are written in the shared folder while the result is being planned; they go with the session, or by the run they belong to.
    """
    outputs = [*_COUNTS, "base_failed", "kept_words", "kept", "removed_lines"]
    others = [c for c in docs.columns if c.lower() not in outputs and c != text_col]
    text, host = F.col(text_col).cast("string"), F.col(host_col).cast("string")
    held = materialize(
        docs.select(
            F.struct(F.lit(0).alias("_"), *others).alias("input"),
            *[text.alias("text")] * (keep_text or bool(copies)),
            F.arrow_udf(_stats, _STATS_DDL)(text).alias("stats"),
            F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("print"),
            F.coalesce(F.concat(F.lit("="), host), F.lit("")).alias("host"),  # a null host is one of its own
            F.monotonically_increasing_id().alias("row"),
        )
    )
    lines = held.select("row", "host", F.inline("stats.lines"))
    voters = held.select("row", "host", "print", "stats")
    if copies:
        voters = voters.drop("print").join(_votes(held.select("row", "text"), copies), "row")
    votes = voters.select("host", "print", F.inline("stats.lines"))
    distinct = lambda df, *key: df.groupBy(*key, "print").agg(F.lit(1).alias("one")).groupBy(*key).agg(F.count("*").alias("docs"))
    per_host = distinct(voters, "host").withColumnRenamed("docs", "host_docs")
    per_line = distinct(votes, "host", "line").filter(F.col("docs") > min_docs)
    limit = max_share * F.col("host_docs")
    limit = limit if many_docs is None else F.least(limit, F.lit(float(many_docs)))
    frequent = per_line.join(per_host, "host").filter(F.col("docs") > limit).select("host", "line")
    hit = _salted_join(lines, frequent).groupBy("row").agg(F.struct(F.sum("words").alias("words"), F.collect_list("line").alias("lines")).alias("hit"))
    n_words, failed = F.col("stats.n_words"), F.col("stats.base_failed")
    left = n_words - F.coalesce("hit.words", F.lit(0))
    return held.join(hit, "row", "left").select(
        *[F.col("input")[c].alias(c) for c in others],
        *[F.col("text").alias(text_col)] * keep_text,
        *[F.col(f"stats.{c}").alias(c) for c in [*_COUNTS, "base_failed"]],
        left.alias("kept_words"),
        (~failed & (left >= F.lit(least_left) * n_words)).alias("kept"),
        F.col("hit.lines").alias("removed_lines"),
    )


def _salted_join(lines: DataFrame, frequent: DataFrame) -> DataFrame:
    """lines that are frequent on their host. A frequent line is in many documents: its rows are dealt over salts by document."""
    salted = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return lines.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, ["host", "line", "salt"]).drop("salt")


def strip_lines(text, removed_lines):
    """A text column without its removed lines; JVM-side columns in and out."""
    return F.when(removed_lines.isNull(), text).otherwise(F.arrow_udf(_stripped, "string")(text, removed_lines))
