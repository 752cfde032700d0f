"""Helpers shared by the corpus operators: byte-level text scanning, hashing and cutting lineage.

Texts are scanned as flat UTF-8 buffers with numpy, a few MB at a time, so that a task's memory is
bounded by its longest document. A null text scans as an empty one.
"""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import hashlib
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of all contracts: space and the control characters 9 to 13.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
_SPLIT_PATTERN = r"[\x20\x09-\x0D]+"

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Low bytes of a 64-bit word, by how many of them count.
_KEPT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Spans of at most this many bytes are their own key.
_SHORT = 15


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; set only where unset (local tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Where materialized tables lie, and the run whose tables are being written.
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_run: contextvars.ContextVar[Run | None] = contextvars.ContextVar("tidemark_run", default=None)


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one. It goes when the application ends, if nothing deletes it before."""
    path = f"{scratch_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    files, place = _file_system(spark, path)
    files.mkdirs(place)
    files.deleteOnExit(place)
    return path


def delete_folder(spark: SparkSession, path: str) -> None:
    files, place = _file_system(spark, path)
    files.delete(place, True)
    files.cancelDeleteOnExit(place)


class Run:
    """The tables that one run of something materializes, apart from those of any other run, in this thread or another."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    @contextlib.contextmanager
    def active(self) -> Iterator[Run]:
        token = _run.set(self)
        try:
            yield self
        finally:
            _run.reset(token)

    def delete(self, spark: SparkSession) -> None:
        """For when all that was made of the tables is written."""
        while self.paths:
            delete_folder(spark, self.paths.pop())


def materialize(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """df written once as Parquet in the shared folder and read back: lineage is cut, and a lost executor costs a reread."""
    path = f"{shared_folder(df.sparkSession, 'table')}/rows"
    df.write.option("compression", codec).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[table] = folder = path.rsplit("/", 1)[0]
    if run := _run.get():
        run.paths.append(folder)
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes materialized tables that nothing reads any more."""
    for table in tables:
        if path := _paths.pop(table, None):
            delete_folder(table.sparkSession, path)
            if (run := _run.get()) and path in run.paths:
                run.paths.remove(path)


def release_memory() -> None:
    """Gives memory that a worker has freed back to the system, where the C library can; workers live as long as their executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def word_count(text):
    """Words of a text column, 0 for null; JVM-side."""
    return F.coalesce(F.size(F.filter(F.split(text, _SPLIT_PATTERN), lambda w: w != "")), F.lit(0)).cast("long")


def ascii_lower(column):
    """A-Z lowered, nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_slices(column: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows with at most max_bytes in all, or one longer row."""
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + max_bytes, "right")) - 1)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that do not cross a document's bounds."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.empty(n, bool)
    first[0], first[1:] = True, ~inside[:-1]
    first[offsets[:-1][offsets[:-1] < n]] = True
    last = np.empty(n, bool)
    last[-1], last[:-1] = True, ~inside[1:]
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    return np.flatnonzero(inside & first), np.flatnonzero(inside & last) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each document the index of its first word (one more at the end)."""
    starts, ends = spans(~_SPACE[data], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; wraps around."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each span's bytes, alike wherever it stands: up to 15 bytes the bytes themselves and their number, beyond that their BLAKE2b digest."""
    lengths = ends - starts
    padded = np.zeros((len(data) + 31) // 8 * 8, np.uint8)
    padded[: len(data)] = data
    cells = padded.view("<u8")
    at, shift = starts >> 3, ((starts & 7) << 3).astype(np.uint64)
    rest = np.uint64(63) - shift
    first, second = cells[at], cells[at + 1]
    low = ((first >> shift) | ((second << np.uint64(1)) << rest)) & _KEPT[np.minimum(lengths, 8)]
    high = ((second >> shift) | ((cells[np.minimum(at + 2, len(cells) - 1)] << np.uint64(1)) << rest)) & _KEPT[np.clip(lengths - 8, 0, 7)]
    high |= np.minimum(lengths, 255).astype(np.uint64) << np.uint64(56)
    long = np.flatnonzero(lengths > _SHORT)
    if len(long):
        raw = memoryview(np.ascontiguousarray(data))
        digests = b"".join(hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True))
        pairs = np.frombuffer(digests, "<u8").reshape(-1, 2)
        low[long], high[long] = pairs[:, 0], pairs[:, 1] | np.uint64(0xFF << 56)
    return low, high


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits of each span's key, for where chance hits do no harm."""
    return key_hashes(*span_keys(data, starts, ends))


def key_hashes(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return mix(mix(low + np.uint64(0x9E3779B97F4A7C15)) ^ (high * np.uint64(0xD6E8FEB86659FD93)))


def chain_hashes(hashes: np.ndarray, width: int, factor: int = 0xA24BAED4963EE407) -> np.ndarray:
    """Hashes of width (a few) consecutive items, in order; one for each start. Each step is mixed, so that none undoes another."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(width))
    for k in range(width):
        out = mix(out * np.uint64(factor) + hashes[k : k + n])
    return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of arange(start, start + length)."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return np.arange(total, dtype=np.int64) + shift
