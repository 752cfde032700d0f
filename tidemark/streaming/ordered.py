"""Ordered folds over streams: rows wait for their turn, refusals are told, and state ends.

Rows of a key wait in state until a row has come that is later by more than the allowed lateness; then they are folded in
time order. So batches and files may cut and order a key's rows in any way within that lateness. Of one batch they may come in
any order: frames, which Spark cuts by their number of rows, decide nothing, unless a key has more rows in a batch than may wait. What cannot be taken any more is refused with a reason: a row of an epoch before the current one, one
without a time, one earlier than what is folded, one that the fold has no room for. All that comes out is in one table:

    tag "result"   what the fold gives
    tag "refused"  a refused row, as JSON, with its reason
    tag "closed"   a key whose state is gone, with the numbers of rows accepted and refused

A key is closed by a row that says so, or when no row has come for ttl_ms; its waiting rows are folded then, and the
fold gives its last results. finish() closes all keys that a stopped query has left in its state, for a stream whose input has ended.
A row of a closed key begins a new state.
"""

from __future__ import annotations

import contextlib
import json
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: How long a key may be silent before its state goes; rows that may wait for their turn before the oldest are folded early.
TTL_MS, MAX_WAITING = 3_600_000, 60_000
OLD_EPOCH, NO_TIME, TOO_LATE, NO_ROOM = "old-epoch", "no-time", "too-late", "no-room"


class Fold(Protocol):
    """A detector that goes on where it stopped. Its state is a dict of numbers, strings and arrays of doubles."""

    schema: str

    def step(self, state: dict | None, rows: pd.DataFrame) -> tuple[dict, pd.DataFrame, np.ndarray]:
        """The state after more rows in time order, the results that are certain now, and the places of rows without room."""
        ...

    def last(self, state: dict) -> pd.DataFrame:
        """What remains to be told when no more rows come."""
        ...


def pack(state: dict | None) -> bytes:
    """Numbers and strings as JSON in the first line, then the arrays' doubles."""
    state = state or {}
    arrays = {k: v for k, v in state.items() if isinstance(v, np.ndarray)}
    head = {"_": {k: len(v) for k, v in arrays.items()}} | {k: v for k, v in state.items() if k not in arrays}
    return json.dumps(head, separators=(",", ":")).encode() + b"\n" + b"".join(np.asarray(v, np.float64).tobytes() for v in arrays.values())


def unpack(raw: bytes) -> dict | None:
    head, _, rest = bytes(raw).partition(b"\n")
    state = json.loads(head)
    for name, n in state.pop("_").items():
        state[name], rest = np.frombuffer(rest[: 8 * n], np.float64), rest[8 * n :]
    return state or None


STATE_DDL = "epoch long, bound_ms double, newest_ms double, accepted long, refused long, fold binary, waiting binary"
_TELL = ["tag", "row_at_ms", "reason", "row", "accepted", "refused"]
_TELL_DDL = "tag string, row_at_ms double, reason string, row string, accepted long, refused long"


class _Held:
    """One key's state while its rows are taken."""

    def __init__(self, fold: Fold, at: str, epoch: str | None, order: list[str], lateness_ms: float, max_waiting: int, values: tuple | None):
        self.rule, self.at, self.epoch_col, self.order, self.lateness, self.most = fold, at, epoch, order, lateness_ms, max_waiting
        self.epoch, self.bound, self.newest, self.accepted, self.refused, packed, waiting = values or (None, -np.inf, -np.inf, 0, 0, b'{"_":{}}\n', None)
        self.fold = unpack(packed)
        self.waiting = pa.ipc.open_stream(bytes(waiting)).read_pandas() if waiting else None
        self.coming: list[pd.DataFrame] = []

    def values(self) -> tuple:
        waiting = None
        if self.waiting is not None and len(self.waiting):
            table, sink = pa.Table.from_pandas(self.waiting, preserve_index=False), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            waiting = sink.getvalue().to_pybytes()
        return (self.epoch, float(self.bound), float(self.newest), self.accepted, self.refused, pack(self.fold), waiting)

    def _refuse(self, rows: pd.DataFrame, reason: str) -> Iterator[pd.DataFrame]:
        if len(rows):
            self.refused += len(rows)
            told = [json.dumps(r, default=str) for r in rows.astype(object).where(rows.notna(), None).to_dict("records")]
            yield pd.DataFrame({"tag": "refused", "row_at_ms": rows[self.at].to_numpy(), "reason": reason, "row": told})

    def _fold(self, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if len(rows):
            self.fold, found, over = self.rule.step(self.fold, rows.reset_index(drop=True))
            self.accepted += len(rows) - len(over)
            yield found.assign(tag="result")
            yield from self._refuse(rows.iloc[over], NO_ROOM)

    def _release(self) -> Iterator[pd.DataFrame]:
        rows = self.waiting
        if rows is not None and len(rows) > self.most:
            self.bound = max(self.bound, float(rows[self.at].iloc[-self.most]))
        if rows is not None and len(rows):
            ready = int(np.searchsorted(rows[self.at].to_numpy(float), self.bound))
            self.waiting = rows.iloc[ready:]
            yield from self._fold(rows.iloc[:ready])

    def rest(self) -> Iterator[pd.DataFrame]:
        """All that waits, and the last results."""
        if self.waiting is not None:
            rows, self.waiting = self.waiting, None
            yield from self._fold(rows)
        if self.fold is not None:
            yield self.rule.last(self.fold).assign(tag="result")
            self.fold = None

    def take(self, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Rows of a batch: they are held until it ends, or until they are more than may wait."""
        self.coming.append(rows)
        if sum(map(len, self.coming)) > self.most:
            yield from self._settle()

    def end_batch(self) -> Iterator[pd.DataFrame]:
        """No more rows of this batch come: what the newest row is later than by more than the lateness is folded."""
        if self.coming:
            yield from self._settle()
        self.bound = max(self.bound, self.newest - self.lateness)
        yield from self._release()

    def _settle(self) -> Iterator[pd.DataFrame]:
        rows, self.coming = pd.concat(self.coming, ignore_index=True) if len(self.coming) > 1 else self.coming[0], []
        known = np.isfinite(rows[self.at].to_numpy(float))
        yield from self._refuse(rows[~known], NO_TIME)
        rows = rows[known]
        for epoch, own in rows.groupby(self.epoch_col) if self.epoch_col else [(0, rows)]:
            if self.epoch is not None and epoch < self.epoch:
                yield from self._refuse(own, OLD_EPOCH)
                continue
            if self.epoch is not None and epoch > self.epoch:
                yield from self.rest()
                self.bound = self.newest = -np.inf
            self.epoch = int(epoch)
            late = own[self.at].to_numpy(float) < self.bound
            yield from self._refuse(own[late], TOO_LATE)
            own = own[~late]
            if len(own):
                self.newest = max(self.newest, float(own[self.at].max()))
                both = own if self.waiting is None or not len(self.waiting) else pd.concat([self.waiting, own])
                self.waiting = both.sort_values([self.at, *self.order], kind="stable")
                yield from self._release()

    def closed(self) -> pd.DataFrame:
        return pd.DataFrame({"tag": ["closed"], "accepted": [self.accepted], "refused": [self.refused]})


def _told(parts: Iterator[pd.DataFrame], key: str, value, columns: list[str]) -> Iterator[pd.DataFrame]:
    for part in parts:
        if len(part):
            out = part.assign(**{key: value}).reindex(columns=columns)
            yield out.astype(object).where(out.notna(), None)


def _columns(fold: Fold, key: str, kind: str) -> tuple[str, list[str]]:
    ddl = f"{key} {kind}, {_TELL_DDL}, {fold.schema}"
    return ddl, T._parse_datatype_string(ddl).names


def ordered(
    df: DataFrame, key: str, at: str, fold: Fold, lateness_ms: float, epoch: str | None = None, order: tuple[str, ...] = (), closes: str | None = None,
    ttl_ms: int = TTL_MS, max_waiting: int = MAX_WAITING,
) -> DataFrame:
    """The tagged table of a stream's keys. order: what decides between rows of one time; closes: a boolean column, true in a key's last row.

    Rows with a null epoch are refused with those that have no time. Other columns than these and the fold's may be there; they are kept in refused rows.
    """
    kind = df.schema[key].dataType.simpleString()
    ddl, columns = _columns(fold, key, kind)
    others = [c for c in df.columns if c != key]

    def run(k: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        held = _Held(fold, at, epoch, list(order), lateness_ms, max_waiting, tuple(group.get) if group.exists else None)
        over = group.hasTimedOut
        if not over:
            for frame in frames:
                rows = frame[others]
                if epoch:
                    rows = rows.assign(**{at: rows[at].where(rows[epoch].notna())})
                yield from _told(held.take(rows), key, k[0], columns)
                over |= bool(closes and rows[closes].fillna(False).any())
            yield from _told(held.end_batch(), key, k[0], columns)
        if over:
            yield from _told(held.rest(), key, k[0], columns)
            yield from _told(iter([held.closed()]), key, k[0], columns)
            group.remove()
        else:
            group.update(held.values())
            group.setTimeoutDuration(ttl_ms)

    return df.groupBy(key).applyInPandasWithState(run, ddl, STATE_DDL, "append", GroupStateTimeout.ProcessingTimeTimeout)


def finish(spark: SparkSession, checkpoint: str, key: str, kind: str, at: str, fold: Fold, epoch: str | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """Of a query that has stopped: what its open keys still have to tell, as a batch table; the checkpoint stays as it is. Names and fold as in ordered()."""
    ddl, columns = _columns(fold, key, kind)
    names = [c.split()[0] for c in STATE_DDL.split(", ")]
    state = spark.read.format("statestore").load(checkpoint)
    value = "value.groupState" if "groupState" in state.schema["value"].dataType.names else "value"
    open_ = state.select(F.col("key")[state.schema["key"].dataType.names[0]].alias("held_key"), *[F.col(f"{value}.{c}").alias(c) for c in names])

    def close(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                held = _Held(fold, at, epoch, list(order), 0.0, MAX_WAITING, tuple(getattr(row, c) for c in names))
                yield from _told(held.rest(), key, row.held_key, columns)
                yield from _told(iter([held.closed()]), key, row.held_key, columns)

    return open_.filter("newest_ms is not null").mapInPandas(close, ddl)


@contextlib.contextmanager
def data_only(spark: SparkSession) -> Iterator[None]:
    """Queries that start here run no batches without data: with timers by the clock, one that ends with its source would otherwise go on for ever."""
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def run_to_end(df: DataFrame, path: str, checkpoint: str, key: str, at: str, fold: Fold, epoch: str | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """The tagged table of an ordered stream over all that its source holds, with its keys closed."""
    spark, kind = df.sparkSession, df.schema[key].dataType.simpleString()
    with data_only(spark):
        query = df.writeStream.format("parquet").option("path", f"{path}/open").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    finish(spark, checkpoint, key, kind, at, fold, epoch, order).write.mode("overwrite").parquet(f"{path}/ended")
    return spark.read.schema(df.schema).parquet(f"{path}/open").unionByName(spark.read.schema(df.schema).parquet(f"{path}/ended"))


def results(tagged: DataFrame, key: str, fold: Fold) -> DataFrame:
    return tagged.filter("tag = 'result'").select(key, *T._parse_datatype_string(fold.schema).names)


def refused(tagged: DataFrame, key: str) -> DataFrame:
    return tagged.filter("tag = 'refused'").select(key, "row_at_ms", "reason", "row")


def closed(tagged: DataFrame, key: str) -> DataFrame:
    return tagged.filter("tag = 'closed'").select(key, "accepted", "refused")


# Lanes watched by the clock.

#: Flags of a lane with the reason that each gives while it is down, the longest wait for a frame, and what a silent lane is told for.
LANE_FLAGS, LANE_GAP_MS, LANE_GAP = [("page", "page-hidden"), ("camera", "camera-unavailable"), ("worker", "worker-unavailable")], 200, "visual-frame-gap"
LANE_DDL = "at_ms double, measurable boolean, reasons string, by string"
_LANE_STATE_DDL = ", ".join(f"{name} boolean" for name, _ in LANE_FLAGS) + ", last_ms double, newest_ms double, heard_at long, silent boolean"


def lane_state(rows: list[tuple[float, str, bool]], state: tuple | None, gap_ms: float = LANE_GAP_MS) -> tuple[list[tuple], tuple]:
    """(what is told, state) after more rows (at_ms, kind, up) of one lane in time order. kind: a flag, processed (a frame was), or evaluate.

    An evaluation is told as (at_ms, measurable, reasons, "row"); a row that is older than one before changes nothing and is told as
    (at_ms, null, its kind, "late").
    """
    *flags, last, newest = state or (*[True] * len(LANE_FLAGS), None, None)
    out = []
    for at, kind, up in rows:
        if newest is not None and at < newest:
            out.append((at, None, kind, "late"))
            continue
        newest = at
        for k, (name, _) in enumerate(LANE_FLAGS):
            flags[k] = bool(up) if kind == name else flags[k]
        last = at if kind == "processed" else last
        if kind == "evaluate":
            out.append(_evaluated(at, flags, last is not None and at - last > gap_ms, "row"))
    return out, (*flags, last, newest)


def _evaluated(at: float, flags: list[bool], gap: bool, by: str) -> tuple:
    reasons = [reason for (_, reason), ok in zip(LANE_FLAGS, flags, strict=True) if not ok] + [LANE_GAP] * gap
    return (at, not reasons, ",".join(reasons), by)


def lane_health(df: DataFrame, key: str, at_ms: str, kind: str, up: str, gap_ms: int = LANE_GAP_MS, ttl_ms: int = TTL_MS) -> DataFrame:
    """Whether each lane can be measured, and why not: by each row that asks (by "row"), and once when no frame has come for gap_ms by the clock (by "timer").

    Rows of a batch are taken in time order; what is older than a row of an earlier batch is told as by "late". A lane that is silent
    for ttl_ms more is forgotten. A timer's at_ms is the newest row's, with the time by the clock since it came.
    """

    def run(k: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        *state, heard, silent = group.get if group.exists else (*[True] * len(LANE_FLAGS), None, None, None, False)
        now = group.getCurrentProcessingTimeMs()
        if group.hasTimedOut:
            if silent:
                group.remove()
                return
            *flags, last, newest = state
            out, silent = [_evaluated(newest + now - heard, flags, last is not None, "timer")], True
        else:
            rows = pd.concat(list(frames)).sort_values("at_ms", kind="stable")
            out, state = lane_state(list(zip(rows["at_ms"], rows["kind"], rows["up"], strict=True)), tuple(state), gap_ms)
            heard, silent = now, False
        group.update((*state, heard, silent))
        group.setTimeoutDuration(ttl_ms if silent else gap_ms)
        yield pd.DataFrame([(k[0], *row) for row in out], columns=["key", *[c.split()[0] for c in LANE_DDL.split(", ")]])

    narrow = df.select(F.col(key).cast("string").alias("key"), F.col(at_ms).cast("double").alias("at_ms"), F.col(kind).alias("kind"), F.col(up).alias("up"))
    return narrow.groupBy("key").applyInPandasWithState(run, f"key string, {LANE_DDL}", _LANE_STATE_DDL, "append", GroupStateTimeout.ProcessingTimeTimeout)
