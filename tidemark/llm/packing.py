"""Packing (4): bounded-space online packing of tokenised documents into fixed windows.

Each partition keeps a fixed number of open windows. A document's tokens (its ids and an end id) fill
whole windows first; what is left goes into the open window that it fits best, and when none fits, the
fullest is emitted and a new one opened. Windows still open when a partition ends are merged with those
of a few other partitions, best fit again, largest first. Only these leave their partition.

Null or empty text: one token, the end id. Empty table: no pieces. Repeated rows are packed as often as
they stand. A null doc_id is carried as null. A text longer than a window is cut, never shortened. Other
columns of the input are left out.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release_memory, text_slices
from .tokens import encoder

_PIECES = pa.schema(
    [
        ("part", pa.int32()), ("window_no", pa.int64()), ("closed", pa.bool_()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
        ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())
    ]
)
_PIECES_DDL = "part int, window_no long, closed boolean, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, offset long, ids binary"
#: Partitions whose open windows are merged together.
MERGED_PARTITIONS = 8


class _Windows:
    """The open windows of one partition, by free space."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.opened = size, most, 0
        self.free: list[tuple[int, int]] = []
        self.pieces: dict[int, list[tuple]] = {}

    def place(self, piece: tuple, length: int) -> list[tuple]:
        """Places a piece; the pieces of the window emitted for it, if any."""
        emitted: list[tuple] = []
        at = bisect_left(self.free, (length, -1))
        if at < len(self.free):
            free, number = self.free.pop(at)
        else:
            if len(self.free) >= self.most:
                emitted = self.pieces.pop(self.free.pop(0)[1])
            free, number = self.size, self.opened
            self.opened += 1
            self.pieces[number] = []
        self.pieces[number].append((number, *piece, self.size - free))
        if free > length:
            insort(self.free, (free - length, number))
            return emitted
        return emitted + self.pieces.pop(number)


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's ids followed by the end id, and the bounds of the documents."""
    return np.insert(ids, np.cumsum(counts), end_id).astype("<u4"), np.concatenate(([0], np.cumsum(counts + 1)))


def _pack(batches: Iterator[pa.RecordBatch], path: str, size: int, most: int, end_id: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    part, windows, tokens = TaskContext.get().partitionId(), _Windows(size, most), encoder(path)

    def rows(pieces: list[tuple], closed: bool) -> pa.RecordBatch:
        number, doc_id, start, length, crc, doc_tokens, ids, offset = zip(*pieces, strict=True)
        n = len(pieces)
        return pa.RecordBatch.from_arrays(
            [pa.array(x, f.type) for x, f in zip(([part] * n, number, [closed] * n, doc_id, start, length, crc, doc_tokens, offset, ids), _PIECES, strict=True)],
            schema=_PIECES
        )

    for batch in batches:
        names, texts = batch.column(0).to_pylist(), batch.column(1)
        for low, _, data, offsets in text_slices(texts):
            stream, bounds = with_end(*tokens.encode(data, offsets), end_id)
            out: list[tuple] = []
            for k in range(len(bounds) - 1):
                ids, name = stream[bounds[k] : bounds[k + 1]], names[low + k]
                for start in range(0, len(ids), size):
                    raw = ids[start : start + size].tobytes()
                    out += windows.place((name, start, len(raw) // 4, zlib.crc32(raw), len(ids), raw if keep_ids else None), len(raw) // 4)
            if out:
                yield rows(out, True)
        release_memory()
    for pieces in windows.pieces.values():
        yield rows(pieces, False)


def _merge(size: int):
    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["filled", "part", "window_no"], ascending=[False, True, True])
        free: list[tuple[int, int]] = []
        opened, where, bases = 0, [], []
        for filled in group["filled"]:
            at = bisect_left(free, (filled, -1))
            room, number = free.pop(at) if at < len(free) else (size, opened)
            opened += number == opened
            where.append(number)
            bases.append(size - room)
            if room > filled:
                insort(free, (room - filled, number))
        return pd.DataFrame({"part": group["part"], "window_no": group["window_no"], "merged": (1 << 62) + (int(key[0]) << 32) + np.array(where, np.int64), "base": bases})

    return merge


def pack(docs: DataFrame, tokenizer_path: str, window: int = 1024, open_windows: int = 128, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and its ids (little-endian unsigned 32-bit) if keep_ids."""
    pieces = materialize(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
            lambda batches: _pack(batches, tokenizer_path, window, open_windows, end_id, keep_ids), _PIECES_DDL
        )
    )
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * keep_ids
    own = F.col("part").cast("long") * F.lit(1 << 32) + F.col("window_no")
    left = pieces.filter(~F.col("closed"))
    merged = (
        left.groupBy("part", "window_no")
        .agg(F.sum("length").alias("filled"))
        .groupBy(F.floor(F.col("part") / MERGED_PARTITIONS).alias("merged_group"))
        .applyInPandas(_merge(window), "part int, window_no long, merged long, base long")
    )
    return (
        pieces.filter("closed")
        .withColumn("sequence_id", own)
        .select(names)
        .unionByName(left.join(merged, ["part", "window_no"]).withColumns({"sequence_id": F.col("merged"), "offset": F.col("offset") + F.col("base")}).select(names))
    )
