"""Sharding (7): sampled splitters over a content key.

Keys are drawn with a chance in proportion to size (and, to as great a part, by row), their quantiles
become range bounds, and records are partitioned by range. The key is a hash of the text, so equal texts
lie in one range. A range with more than an eighth of a shard, of bytes or of rows, is subdivided by
samples of (key, id) from within it: only there are equal texts parted. There are many more ranges than
shards; the largest range goes to the emptiest shard until all are dealt, so that shards hold near equal
sizes. Records are numbered within a range, never within a whole shard.

Null size counts as 0. Null ids come first, each on its own. Equal records (same key and id) share a range. Empty table:
no rows. One record larger than a shard keeps its shard for itself. Columns that the input has besides
are kept; those named as an output column are replaced.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Ranges to a shard at least, rows to a range at most, samples for each range, parts of a shard above which a range is subdivided, rounds of it.
RANGES_EACH, ROWS_EACH, SAMPLES_EACH, PARTS, ROUNDS = 256, 500_000, 16, 8, 4
_LEAST = -(2**63)


def _locate(keys: np.ndarray, ids: np.ndarray, bound_keys: np.ndarray, bound_ids: np.ndarray) -> np.ndarray:
    """The range of each (key, id): how many bounds are at or below it."""
    low, high = np.searchsorted(bound_keys, keys, "left"), np.searchsorted(bound_keys, keys, "right")
    out = low.astype(np.int64)
    tied = np.flatnonzero(low < high)
    for a in np.unique(low[tied]):
        rows = tied[low[tied] == a]
        out[rows] = a + np.searchsorted(bound_ids[a : high[rows[0]]], ids[rows], "right")
    return out


def _range_of(bounds: list[tuple[int, int]]):
    keys, ids = np.array([b[0] for b in bounds], np.int64), np.array([b[1] for b in bounds], np.int64)

    @F.pandas_udf("long")
    def range_of(key: pd.Series, own: pd.Series) -> pd.Series:
        return pd.Series(_locate(key.to_numpy(np.int64), own.to_numpy(np.int64), keys, ids))

    return range_of


def _chance(seed: int):
    """Uniform in [0, 1), the same for a record in every run."""
    return F.shiftrightunsigned(F.xxhash64("shard_key", "shard_id", F.lit(seed)), 11) / F.lit(float(2**53))


def _quantiles(drawn: list[tuple[int, int]], pieces: int) -> list[tuple[int, int]]:
    drawn = sorted(drawn)
    return sorted({drawn[len(drawn) * k // pieces] for k in range(1, pieces)}) if len(drawn) > 1 else []


def shard(records: DataFrame, shards: int, size_col: str, id_col: str, key_col: str, seed: int = 11) -> DataFrame:
    """The records with shard (0 to shards - 1) and slot (gapless from 0 within a shard)."""
    kept = [c for c in records.columns if c.lower() not in ("shard", "slot")]
    number = F.monotonically_increasing_id() + F.lit(_LEAST)
    records = materialize(
        records.select(
            F.struct(F.lit(0).alias("_"), *kept).alias("input"),
            F.coalesce(F.col(key_col).cast("long"), F.lit(_LEAST)).alias("shard_key"),
            F.coalesce(F.col(id_col).cast("long"), number).alias("shard_id"),
            F.coalesce(F.col(size_col).cast("long"), F.lit(0)).alias("shard_size"),
        )
    )
    rows, total = records.agg(F.count("*"), F.coalesce(F.sum("shard_size"), F.lit(0))).first()
    ranges = max(shards * RANGES_EACH, rows // ROWS_EACH)
    weight = (F.col("shard_size") / F.lit(float(max(total, 1))) + F.lit(1 / max(rows, 1))) * F.lit(ranges * SAMPLES_EACH / 2)
    draw = lambda df, times, seed: [(r[0], r[1]) for r in df.filter(_chance(seed) < weight * times).select("shard_key", "shard_id").collect()]
    bounds = [(key, _LEAST) for key in sorted({key for key, _ in _quantiles(draw(records, 1, seed), ranges)})]
    for turn in range(ROUNDS):
        ranged = records.withColumn("shard_range", _range_of(bounds)("shard_key", "shard_id"))
        held = {r[0]: (r[1], r[2]) for r in ranged.groupBy("shard_range").agg(F.sum("shard_size"), F.count("*")).collect()}
        part = {k: max(size * shards / max(total, 1), n * shards / max(rows, 1)) for k, (size, n) in held.items()}
        over = [k for k, x in part.items() if x > 1 / PARTS and held[k][1] > 1]
        more = draw(ranged.filter(F.col("shard_range").isin(over)), 2, seed + turn + 1) if over and turn < ROUNDS - 1 else []
        if not more:
            break
        at = _locate(*(np.array(x, np.int64) for x in zip(*more, strict=True)), *(np.array([b[i] for b in bounds], np.int64) for i in (0, 1)))
        within: dict[int, list] = {}
        for sample, k in zip(more, at.tolist(), strict=True):
            within.setdefault(k, []).append(sample)
        finer = {b for k, drawn in within.items() for b in _quantiles(drawn, 1 + int(2 * PARTS * part[k]))}
        if finer <= set(bounds):
            break
        bounds = sorted(finer | set(bounds))
    filled, counted, placed = [(0, k) for k in range(shards)], [0] * shards, []
    for k in sorted(held, key=lambda k: (-held[k][0], k)):
        size, own = heapq.heappop(filled)
        placed.append((k, own, counted[own]))
        counted[own] += held[k][1]
        heapq.heappush(filled, (size + held[k][0], own))
    where = records.sparkSession.createDataFrame(placed, "shard_range long, shard int, shard_base long")
    order = Window.partitionBy("shard_range").orderBy("shard_key", "shard_id")
    return (
        ranged.withColumn("shard_rank", F.row_number().over(order))
        .join(where, "shard_range")
        .select(*[F.col("input")[c].alias(c) for c in kept], "shard", (F.col("shard_base") + F.col("shard_rank") - 1).alias("slot"))
    )
