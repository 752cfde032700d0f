"""Structured Streaming forms: idempotent ingestion, live state, validity, recomputation, metrics of closed windows.

Stateful folds are in `ordered` and `folds`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import materialize
from . import folds, ordered

def current(published: DataFrame, key: str) -> DataFrame:
    """The newest revision of each key; earlier ones are superseded."""
    return published.groupBy(key).agg(F.max_by(F.struct(*published.columns), F.struct("revision", "batch")).alias("newest")).select("newest.*")


def tumbling(df: DataFrame, at: str, keys: list[str], length: str, lateness: str, *aggregates: Column) -> DataFrame:
    """Aggregates of fixed windows, final once the watermark has passed; later rows are dropped."""
    return df.withWatermark(at, lateness).groupBy(F.window(at, length), *keys).agg(*aggregates)


def idempotent(df: DataFrame, at: str, keys: list[str], lateness: str) -> DataFrame:
    """The first row of each key within the watermark."""
    return df.withWatermark(at, lateness).dropDuplicatesWithinWatermark(keys)


def permitted(df: DataFrame, grants: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Rows of a stream whose grant (granted_at, ended_at; static, read anew by each batch) holds at their time."""
    return df.join(grants, keys).filter((F.col(at) >= F.col("granted_at")) & F.coalesce(F.col(at) < F.col("ended_at"), F.lit(True))).drop("granted_at", "ended_at")


def live_state(df: DataFrame, session: str, sequence: str, stage: str, event_id: str) -> DataFrame:
    """Each session's last stage, number of events and last event; for update or complete mode."""
    return df.groupBy(session).agg(
        F.max_by(stage, sequence).alias("stage"), F.count("*").alias("event_count"), F.max(sequence).alias("last_sequence"),
        F.max_by(event_id, sequence).alias("last_event_id")
    )


def recompute_changed(changes: DataFrame, key: str, recompute: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, latest: Callable[[], DataFrame] | None = None) -> None:
    """For every batch the distinct changed keys with their newest revision are computed anew; the result is to be read through current(). Runs until the source is read.

    A batch that is tried again replaces what it wrote. With latest (key and revision as the source stands now), a key that has a newer
    revision by then is not published: the batch that brings it will.
    """

    def publish(batch: DataFrame, number: int) -> None:
        changed = batch.groupBy(key).agg(F.max("revision").alias("revision"))
        if latest is not None:
            newer = latest().groupBy(key).agg(F.max("revision").alias("newest"))
            changed = changed.join(newer, key, "left").filter(F.coalesce(F.col("revision") >= F.col("newest"), F.lit(True))).drop("newest")
        recompute(changed).write.mode("overwrite").parquet(f"{path}/batch={number}")

    changes.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Runs a stream over all that its source holds now; the result as a batch table.

    Complete mode: the last batch's rows. Update mode: the last row of each of keys, over all batches and runs. A batch that is tried again
    replaces what it wrote.
    """
    spark, writer = df.sparkSession, df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", path).outputMode("append").start().awaitTermination()
        return spark.read.schema(df.schema).parquet(path)
    if mode == "update" and not keys:
        raise ValueError("update mode needs the keys whose last rows make up the result")
    writer.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")).outputMode(mode).start().awaitTermination()
    table = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
    if mode == "complete":
        return table.join(table.agg(F.max("batch").alias("batch")), "batch", "left_semi").drop("batch")
    return table.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), "batch").alias("last")).select("last.*")


def frames_to_finalise(frames: DataFrame, windows: DataFrame, key: str, lane: str) -> DataFrame:
    """The frames of each closed window (key, window_no, start_ms, end_ms), with t_ms counted from its start: voice frames whose step of 10 ms ends in it, face frames of its whole five-second bins."""
    own = frames.join(windows.select(F.col("key").alias(key), "window_no", "start_ms", "end_ms"), key).withColumn("t_ms", F.col("t_ms") - F.col("start_ms"))
    length = F.col("end_ms") - F.col("start_ms")
    kept = F.col("t_ms") + 10 <= length if lane == "voice" else F.col("t_ms") < F.floor(length / 5_000) * 5_000
    return own.filter((F.col("t_ms") >= 0) & kept)


def rotating_windows(df: DataFrame, key: str, fold: folds.Windows, lateness_ms: float, **more) -> DataFrame:
    """Each key's windows as ordered.ordered() tells them; the rows that a window has no room for are refused."""
    return ordered.ordered(df, key, fold.at, fold, lateness_ms, **more)


def window_metrics(
    tagged: DataFrame, key: str, fold: folds.Windows, frames: Callable[[], DataFrame], lane: str, metrics: Callable[[DataFrame, DataFrame], DataFrame], path: str, checkpoint: str,
    calibration_ms: float | None = None,
) -> DataFrame:
    """Metrics of each window of rotating_windows(), computed when it closes and published once; with key and window_no instead of session_id.

    frames: the frames so far, with key as session_id and t_ms on the clock of the windows; only those of windows that a batch has closed
    are used. metrics: voice.metrics or face.metrics. A batch that is tried again replaces what it wrote. Runs until the source is read,
    then for the windows that its end closes.
    """

    def publish(batch: DataFrame, number: int) -> None:
        windows = materialize(ordered.results(batch, key, fold).select(F.col(key).alias("key"), "window_no", "start_ms", "end_ms"))
        if windows.isEmpty():
            return
        own = frames_to_finalise(frames(), windows.withColumn("key", F.col("key").cast("string")), "session_id", lane)
        own = own.withColumn("session_id", F.concat_ws("/", "session_id", "window_no")).drop("window_no", "start_ms", "end_ms")
        named = windows.select(F.concat_ws("/", F.col("key").cast("string"), "window_no").alias("session_id"), "key", "window_no")
        sessions = named.select("session_id", F.lit(0.0).alias("session_started_at_ms"), F.lit(calibration_ms).cast("double").alias("noise_calibration_duration_ms"))
        found = metrics(own, sessions).join(named, "session_id").drop("session_id").withColumnRenamed("key", key)
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")

    with ordered.data_only(tagged.sparkSession):
        query = tagged.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    spark, kind = tagged.sparkSession, tagged.schema[key].dataType.simpleString()
    publish(ordered.finish(spark, checkpoint, key, kind, fold.at, fold), -1)
    return spark.read.parquet(path).drop("batch")
