"""Ordered rows into sessions, segments and runs; rolling sums; stream continuity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], order: list[str], breaks: Column, name: str = "island") -> DataFrame:
    """With a number from 1 that grows at each row where `breaks` holds; the first row of a key always opens one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    opens = F.when(F.row_number().over(w) == 1, 1).otherwise(F.coalesce(breaks, F.lit(False)).cast("int"))
    return df.withColumn("opens_island", opens).withColumn(name, F.sum("opens_island").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("opens_island")


def gap_sessions(df: DataFrame, keys: list[str], order: list[str], at: str, gap: float, name: str = "session_no") -> DataFrame:
    """Sessions of rows no further apart than `gap` in units of `at`."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return islands(df.withColumn("gap_before", F.col(at) - F.lag(at).over(w)), keys, order, F.col("gap_before") > gap, name).drop("gap_before")


def changes(keys: list[str], order: list[str], *columns: str) -> Column:
    """Whether any of the columns differs from the row before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = F.lit(False)
    for c in columns:
        out = out | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    return out


def runs(df: DataFrame, keys: list[str], order: list[str], state: str, name: str = "run_no") -> DataFrame:
    """Runs of equal state; number from 1."""
    return islands(df, keys, order, changes(keys, order, state), name)


def usable_segments(df: DataFrame, keys: list[str], order: list[str], at: str, usable: str, provenance: list[str], longest: float, bucket: Column) -> DataFrame:
    """Usable rows with segment_no and continuity_no.

    Numbered over all rows before unusable ones go, since a rejected row is itself a boundary. A step that is
    not positive, longer than `longest` or crosses provenance breaks both numbers; a new bucket breaks the
    segment alone.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    prior_usable = F.lag(usable).over(w)
    step = F.col(at) - F.lag(at).over(w)
    hard = (step <= 0) | (step > longest) | changes(keys, order, *provenance)
    marked = df.withColumn("bucket", bucket)
    marked = marked.withColumn(
        "hard_break", F.when(prior_usable & F.col(usable), F.coalesce(hard, F.lit(True))).otherwise(F.lit(True))
    ).withColumn("soft_break", F.col("hard_break") | changes(keys, order, "bucket"))
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    numbered = marked.withColumn("continuity_no", F.sum(F.col("hard_break").cast("int")).over(running)).withColumn("segment_no", F.sum(F.col("soft_break").cast("int")).over(running))
    return numbered.filter(F.col(usable)).drop("hard_break", "soft_break")


def rolling_sum(keys: list[str], at: Column, value: str, span: int) -> Column:
    """Sum over the rows of the last `span` units of the (integer) time, the row's own included."""
    return F.sum(value).over(Window.partitionBy(*keys).orderBy(at).rangeBetween(-span, 0))


#: Fixed value: a longer gap than this, in ms, restarts the analysis.
BLOCK_GAP_MS = 40
_CONTINUITY = "accepted boolean, lost_before long, gap_ms double, discontinuous boolean, time_back boolean, restart_no long"


def accepted_blocks(sequence: np.ndarray, index: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which blocks of a stream, in order of arrival, go beyond the last accepted one, in number and in samples. Numbers and ends of 0 bind nobody."""
    out = np.zeros(len(sequence), bool)
    after = lambda k, to: ((sequence[to] > sequence[k]) | (sequence[k] <= 0)) & ((index[to] >= end[k]) | (end[k] <= 0))
    places = np.arange(len(sequence))
    breaks = np.flatnonzero(~after(places[:-1], places[1:])) + 1  # blocks that do not go beyond the one before
    at = 0
    while at < len(sequence):
        k = int(np.searchsorted(breaks, at, "right"))
        stop = int(breaks[k]) if k < len(breaks) else len(sequence)
        out[at:stop] = True
        later = np.flatnonzero(after(stop - 1, slice(stop, None)))
        if not len(later):
            break
        at = stop + int(later[0])
    return out


def _continuity(blocks: pd.DataFrame, sequence: str, index: str, length: str, at_ms: str, rate: str) -> pd.DataFrame:
    number, first, n, at, hz = (blocks[c].to_numpy() for c in (sequence, index, length, at_ms, rate))
    end = first + n
    taken = accepted_blocks(number, first, end)
    lost, gap, jump, back = np.zeros(len(blocks), np.int64), np.zeros(len(blocks)), np.zeros(len(blocks), bool), np.zeros(len(blocks), bool)
    k = np.flatnonzero(taken)
    before, now = k[:-1], k[1:]
    lost[now] = np.where(number[before] > 0, np.maximum(number[now] - number[before] - 1, 0), 0)
    gap[now] = np.maximum(at[now] - at[before] - n[now] / hz[now] * 1000, 0)
    jump[now] = (end[before] > 0) & (first[now] != end[before])
    back[now] = at[now] < at[before]
    restarts = 1 + np.cumsum((lost > 0) | jump | (gap > BLOCK_GAP_MS))
    return blocks.assign(accepted=taken, lost_before=lost, gap_ms=gap, discontinuous=jump, time_back=back, restart_no=restarts)


def block_continuity(df: DataFrame, keys: list[str], order: list[str], sequence: str, index: str, length: str, at_ms: str, rate: str) -> DataFrame:
    """Each stream's blocks in order of arrival, with what the last accepted one tells of them.

    accepted: not a regression in number or samples. Of accepted ones: lost_before (blocks missing by number), gap_ms (time beyond the
    block's own), discontinuous (another sample than the expected one), time_back (earlier than the one before). restart_no grows
    at each block that must not be analysed together with earlier ones. A stream is one of one session, so it fits a task.
    """
    names = df.columns

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return _continuity(group.sort_values(order, kind="stable"), sequence, index, length, at_ms, rate)[[*names, *[c.split()[0] for c in _CONTINUITY.split(", ")]]]

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.groupBy(*keys).applyInPandas(run, f"{fields}, {_CONTINUITY}")
