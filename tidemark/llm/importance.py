"""Target-distribution importance resampling (12): weights scored by arrays of hashed features, then an exact draw.

Features are all runs of 1 to 3 words, hashed into buckets by the CRC-32 of their UTF-8 bytes. A register of that code
after a run of words follows from the register before its last word by a shift, which is a product of tables, so that
all runs of a batch are hashed by a few gathers each. A bucket's gain is the logarithm of how much more frequent it is
in the target than in the corpus, both smoothed; a document's weight is the sum of its features' gains. Gumbel noise of
each document makes the highest scores a draw without replacement in proportion to the weights.

The draw is cut at one exact key, found by weighted medians of medians: each task gives the median of its remaining
keys and their number, the median of those medians, weighted by these numbers, is the next pivot, and the side of it
that cannot hold the cut is discarded: a quarter of all remaining keys at least. What is left is written anew
whenever it has shrunk eightfold. Only the winners are sorted.

Words are runs of digits, of a-z (A-Z lowered) and of all beyond ASCII. Null and empty texts have no features and weigh 0.
Rows count one by one, repeated ones too; a null id is written as nothing in the noise and comes last of ties. Of equal scores
and ids the fewer features come first. An empty corpus gives no rows; an empty target, gains below those of frequent buckets.
Counts cover all texts, however long.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lowered, materialize, release_memory, spans, text_slices

#: Buckets of features, and consecutive words in one.
BUCKETS, LONGEST = 10_000, 3
#: Words that a document needs to be drawn.
LEAST_WORDS = 20
#: Keys that may come to the driver for the last choice; rows to a range of sorted winners.
LAST_KEYS, RANGE_ROWS = 4096, 500_000

_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[97:123] = _INSIDE[128:] = True
_ONES = np.uint32(0xFFFFFFFF)
#: Words of more bytes than this are hashed one by one.
_SHORT = 63


def _byte_table() -> np.ndarray:
    """The register after one byte, from the reflected polynomial of CRC-32."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


class _Crc:
    """Registers of CRC-32 as linear maps: shifts over zero bytes, by tables of a register's four bytes."""

    def __init__(self) -> None:
        self.byte = _byte_table()
        shifts = [np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])]
        for _ in range(_SHORT + 1):
            shifts.append(self._step(shifts[-1]))
        self.short = np.stack(shifts[: _SHORT + 1])
        self.doubled = [shifts[_SHORT + 1]]  # 64 bytes, 128, ...
        for _ in range(40):
            last = self.doubled[-1]
            self.doubled.append(self._apply(last, last))

    def _step(self, x: np.ndarray) -> np.ndarray:
        return self.byte[x & np.uint32(255)] ^ (x >> np.uint32(8))

    @staticmethod
    def _apply(table: np.ndarray, x: np.ndarray) -> np.ndarray:
        return table[0][x & 255] ^ table[1][(x >> 8) & 255] ^ table[2][(x >> 16) & 255] ^ table[3][x >> 24]

    def shift(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Registers after n zero bytes each."""
        low = n & _SHORT
        x = self.short[low, 0, x & 255] ^ self.short[low, 1, (x >> 8) & 255] ^ self.short[low, 2, (x >> 16) & 255] ^ self.short[low, 3, x >> 24]
        high, k = n >> 6, 0
        while high.any():
            odd = np.flatnonzero(high & 1)
            x[odd] = self._apply(self.doubled[k], x[odd])
            high, k = high >> 1, k + 1
        return x

    def words(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Each word's register, begun at 0."""
        out = np.zeros(len(starts), np.uint32)
        order = np.argsort(-np.minimum(lengths, _SHORT + 1), kind="stable")
        long = order[: np.searchsorted(-lengths[order], -_SHORT)] if len(order) else order
        raw = memoryview(np.ascontiguousarray(data))
        for w in long.tolist():
            out[w] = zlib.crc32(raw[starts[w] : starts[w] + lengths[w]], 0xFFFFFFFF) ^ 0xFFFFFFFF
        short = order[len(long) :]
        at, left, x = starts[short], lengths[short], np.zeros(len(short), np.uint32)
        alive = len(short)
        for k in range(int(left[0]) if alive else 0):
            alive = int(np.searchsorted(-left, -k))  # those with a byte k: left is sorted downwards
            now = x[:alive]
            x[:alive] = self.byte[(now ^ data[at[:alive] + k]) & np.uint32(255)] ^ (now >> np.uint32(8))
        out[short] = x
        return out


_crc: list[_Crc] = []


def feature_buckets(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Of lowered texts end to end: for runs of 1 to 3 words, the buckets of all that begin at each word, which of them there are, and each document's first word."""
    if not _crc:
        _crc.append(_Crc())
    crc = _crc[0]
    starts, ends = spans(_INSIDE[data], offsets)
    first = np.searchsorted(starts, offsets)
    lengths = ends - starts
    own = crc.words(data, starts, lengths)
    spaced = crc.shift(np.full(len(own), crc.byte[32]), lengths) ^ own  # a space, then the word
    run = crc.shift(np.full(len(own), _ONES), lengths) ^ own
    there = np.ones(len(own), bool)
    rest = np.repeat(first[1:], np.diff(first)) - np.arange(len(own))  # words up to the document's end
    found, valid = [(run ^ _ONES) % np.uint32(buckets)], [there]
    for n in range(2, LONGEST + 1):
        last = np.minimum(np.arange(len(own)) + n - 1, max(len(own) - 1, 0))
        run = crc.shift(run, lengths[last] + 1) ^ spaced[last]
        found.append((run ^ _ONES) % np.uint32(buckets))
        valid.append(rest >= n)
    return found, valid, first


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """The features of all texts in each bucket. Each task sends one row a bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0)):
                found, valid, _ = feature_buckets(lowered(data), offsets, buckets)
                for own, there in zip(found, valid, strict=True):
                    total += np.bincount(own[there], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])
        release_memory()

    out = np.zeros(buckets, np.int64)
    for r in texts.select(F.col(text_col).alias("text")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[r[0]] = r[1]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of how often a bucket stands in the target against the corpus), smoothed by one for each bucket."""
    n = len(corpus)
    most, least = float(int(corpus.sum()) + n), float(int(target.sum()) + n)
    return np.array([math.floor(1000 * math.log(((t + 1.0) * most) / ((s + 1.0) * least))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """id_col, the carried columns, n_words, n_features and weight of every row."""
    buckets, kept = len(gain), [id_col, *carry]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in text_slices(batch.column(0)):
                found, valid, first = feature_buckets(lowered(data), offsets, buckets)
                total, number = np.zeros(len(offsets) - 1, np.int64), np.zeros(len(offsets) - 1, np.int64)
                for own, there in zip(found, valid, strict=True):
                    for out, values in ((total, np.where(there, gain[own], 0)), (number, there)):
                        sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
                        out += sums[first[1:]] - sums[first[:-1]]
                rest = [c.slice(low, high - low) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(np.diff(first).astype(np.int64)), pa.array(number), pa.array(total)], [f"c{k}" for k in range(len(rest))] + ["n_words", "n_features", "weight"])
        release_memory()

    taken = docs.select(F.col(text_col).alias("text"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(kept)])
    fields = ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(taken.schema[1:]))
    out = taken.mapInArrow(weigh, f"{fields}, n_words long, n_features long, weight long")
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(kept)], "n_words", "n_features", "weight")


def noise(id_column, seed: int = 42):
    """floor(-1000 ln(-ln u)), u from the first 32 bits of sha256 of seed:id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u)))


#: A row's place in the order of the draw, unique by its last column.
_KEY = ["k1", "k2", "k3", "k4"]


def _ordered(keys: np.ndarray) -> np.ndarray:
    return keys[np.lexsort(keys.T[::-1])]


def _median(keys: np.ndarray) -> np.ndarray:
    return _ordered(keys)[(len(keys) - 1) // 2]


def _at_most(keys: np.ndarray, pivot: tuple[int, ...]) -> np.ndarray:
    """Which keys are not above the pivot."""
    less, same = np.zeros(len(keys), bool), np.ones(len(keys), bool)
    for k, p in enumerate(pivot):
        less |= same & (keys[:, k] < p)
        same &= keys[:, k] == p
    return less | same


def _medians(keys: DataFrame, low: tuple | None, high: tuple | None, pivot: tuple | None) -> list[tuple[bool, int, tuple[int, ...]]]:
    """From each task: of its keys above low and up to high, on either side of the pivot, their number and their median."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            own = np.stack([c.to_numpy() for c in batch.columns], axis=1)
            keep = np.ones(len(own), bool) if high is None else _at_most(own, high)
            if low is not None:
                keep &= ~_at_most(own, low)
            parts.append(own[keep])
        own = np.concatenate(parts) if parts else np.zeros((0, len(_KEY)), np.int64)
        below = np.ones(len(own), bool) if pivot is None else _at_most(own, pivot)
        for side, some in ((True, own[below]), (False, own[~below])):
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array([side]), pa.array([len(some)]), *[pa.array([v]) for v in _median(some).tolist()]], ["below", "n", *_KEY])

    some = keys
    if low is not None:
        some = some.filter(F.col("k1") >= low[0])
    if high is not None:
        some = some.filter(F.col("k1") <= high[0])
    rows = some.select(_KEY).mapInArrow(fold, "below boolean, n long, " + ", ".join(f"{k} long" for k in _KEY)).collect()  # two a task at most
    return [(r[0], r[1], tuple(r[2:])) for r in rows]


def cutoff(keys: DataFrame, wanted: int) -> tuple[int, ...] | None:
    """The key of that rank among unique keys (_KEY, whole numbers), counted from 1; None for rank 0. keys is a written table with wanted rows or more."""
    if wanted < 1:
        return None
    low = high = pivot = None
    table, held = keys, None
    found = _medians(table, low, high, pivot)
    left = scanned = sum(n for _, n, _ in found)
    while left > LAST_KEYS:
        ranked = sorted((median, n) for _, n, median in found)
        half, at = (left + 1) // 2, 0
        for pivot, n in ranked:  # noqa: B007
            at += n
            if at >= half:
                break
        found = _medians(table, low, high, pivot)
        below = sum(n for side, n, _ in found if side)
        if wanted <= below:
            high, left = pivot, below
        else:
            low, left, wanted = pivot, left - below, wanted - below
        found = [x for x in found if x[0] == (high == pivot)]
        if left > LAST_KEYS and 8 * left <= scanned:
            smaller = materialize(table.filter(between(low, high)).select(_KEY))
            if held is not None:
                discard(held)
            table, held, scanned = smaller, smaller, left
    rest = sorted(tuple(r) for r in table.filter(between(low, high)).select(_KEY).collect())  # LAST_KEYS at most
    if held is not None:
        discard(held)
    return rest[wanted - 1]


def _up_to(key: tuple[int, ...]):
    """Whether a row's key is not above this one."""
    found = F.lit(True)
    for name, value in reversed(list(zip(_KEY, key, strict=True))):
        found = (F.col(name) < F.lit(value)) | ((F.col(name) == F.lit(value)) & found)
    return found


def between(low: tuple[int, ...] | None, high: tuple[int, ...] | None):
    found = F.lit(True)
    if low is not None:
        found &= ~_up_to(low) & (F.col("k1") >= F.lit(low[0]))
    if high is not None:
        found &= _up_to(high) & (F.col("k1") <= F.lit(high[0]))
    return found


def drawn(scored: DataFrame, wanted: int, where) -> DataFrame:
    """scored, a written table with the columns of _KEY, and rank: 1 for the smallest key of the rows that meet where, up to the wanted rank; null for all others."""
    last = cutoff(scored.filter(where).select(_KEY), wanted)
    if last is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    wins = F.coalesce(where, F.lit(False)) & _up_to(last)
    parts = max(8, math.ceil(wanted / RANGE_ROWS))
    winners = scored.filter(wins).repartitionByRange(parts, *_KEY).sortWithinPartitions(*_KEY).withColumn("at", F.monotonically_increasing_id())
    winners = materialize(winners)
    part = F.shiftright("at", 33)
    before, total = {}, 0
    for r in sorted(winners.groupBy(part.alias("part")).count().collect()):  # one a range
        before[r[0]], total = total, total + r[1]
    starts = scored.sparkSession.createDataFrame(list(before.items()), "part long, before long")
    ranked = winners.withColumn("part", part).join(F.broadcast(starts), "part")
    ranked = ranked.withColumn("rank", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1)
    columns = [*scored.columns, "rank"]
    return ranked.select(columns).unionByName(scored.filter(~wins).withColumn("rank", F.lit(None).cast("long")).select(columns))


def resample(
    docs: DataFrame, target: DataFrame, share: tuple[int, int] = (5, 100), id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    carry: tuple[str, ...] = (), least_words: int = LEAST_WORDS, seed: int = 42, buckets: int = BUCKETS,
) -> DataFrame:
    """id_col, the carried columns, n_words, n_features, weight, score and rank of every row; rank is null where a row is not drawn.

    Of the N rows with least_words words, floor(N * share) are drawn. Ids are whole numbers. The table of scores is written in the shared folder.
    """
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_col, buckets))
    rows = weighted(docs, gain, id_col, text_col, carry).withColumn("score", F.col("weight") + noise(F.col(id_col), seed))
    keys = {"k1": -F.col("score"), "k2": F.coalesce(F.col(id_col), F.lit(2**63 - 1)), "k3": F.col("n_features"), "k4": F.monotonically_increasing_id()}
    scored = materialize(rows.withColumns(keys))
    where = F.col("n_words") >= least_words
    wanted = scored.filter(where).count() * share[0] // share[1]
    return drawn(scored, wanted, where).drop(*_KEY)
