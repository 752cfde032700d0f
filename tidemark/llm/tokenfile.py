"""Token-ID / binary output (10): documents' ids in patched frame-of-reference blocks.

The file format is a Parquet table of segments in ascending document order. A segment holds whole
documents: their ids and lengths, and the token stream cut into blocks. A block subtracts its minimum and
packs what is left at the width that a given share of its values needs; values beyond that width stand in
an exception list of positions and values. block_starts indexes the byte at which each block starts, so a
reader can take any block alone; read_tokens() does.

Null or empty text: the end id alone. Rows with a null doc_id come first. Rows with equal doc_id are
ordered by a hash of their text. Empty table: an empty file and no rows. Other columns are left out.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import release_memory, text_slices
from .packing import with_end
from .tokens import encoder

#: base, number of values, number of exceptions, width; little-endian.
_HEADER = struct.Struct("<IIIB")
#: Bytes of text to a range of documents, as sampled bounds have it.
RANGE_BYTES = 1 << 27
_SEGMENT_DDL = "part int, segment int, n_tokens long, doc_ids array<long>, doc_tokens array<long>, block_starts array<long>, payload binary"
_SEGMENT = pa.schema([
    ("part", pa.int32()), ("segment", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())),
    ("block_starts", pa.list_(pa.int64())), ("payload", pa.binary())
])
_READ_DDL = "part int, segment int, doc_id long, in_segment long, n_tokens long, ids_crc32 long, ids binary"
_READ = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("doc_id", pa.int64()), ("in_segment", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])


def encode_block(ids: np.ndarray, share: float = 0.9) -> bytes:
    """One block; any values of 32 bits, also none."""
    n = len(ids)
    if n == 0:
        return _HEADER.pack(0, 0, 0, 0)
    base = int(ids.min())
    rest = ids.astype(np.uint32) - np.uint32(base)
    rank = min(n - 1, int(n * share))
    width = int(np.partition(rest, rank)[rank]).bit_length()
    odd = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    bits = ((rest[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)).astype(np.uint8)
    return _HEADER.pack(base, n, len(odd), width) + np.packbits(bits.reshape(-1), bitorder="little").tobytes() + odd.astype("<u4").tobytes() + rest[odd].astype("<u4").tobytes()


def decode_block(raw: bytes | memoryview, start: int = 0) -> np.ndarray:
    base, n, n_odd, width = _HEADER.unpack_from(raw, start)
    at = start + _HEADER.size
    size = (n * width + 7) // 8
    bits = np.unpackbits(np.frombuffer(raw, np.uint8, size, at), count=n * width, bitorder="little").reshape(n, width)
    if width <= 24:  # sums below 2**24 are exact in single precision
        rest = (bits.astype(np.float32) @ (2.0 ** np.arange(width)).astype(np.float32)).astype(np.uint32)
    else:
        rest = (bits.astype(np.float64) @ 2.0 ** np.arange(width)).astype(np.uint32)
    at += size
    odd = np.frombuffer(raw, "<u4", n_odd, at)
    rest[odd] = np.frombuffer(raw, "<u4", n_odd, at + 4 * n_odd)
    return rest + np.uint32(base)


def _segments(batches: Iterator[pa.RecordBatch], path: str, end_id: int, block: int, segment_tokens: int, share: float) -> Iterator[pa.RecordBatch]:
    part, tokens = TaskContext.get().partitionId(), encoder(path)
    number, held, names, lengths, total = 0, [], [], [], 0

    def segment() -> pa.RecordBatch:
        stream = np.concatenate(held)
        blocks = [encode_block(stream[k : k + block], share) for k in range(0, len(stream), block)]
        starts = np.concatenate(([0], np.cumsum([len(b) for b in blocks])[:-1])).tolist()
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((part, number, total, names, lengths, starts, b"".join(blocks)), _SEGMENT, strict=True)], schema=_SEGMENT)

    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        for low, high, data, offsets in text_slices(texts, segment_tokens * 4):
            stream, bounds = with_end(*tokens.encode(data, offsets), end_id)
            held.append(stream)
            names += ids[low:high]
            lengths += np.diff(bounds).tolist()
            total += len(stream)
            if total >= segment_tokens:
                yield segment()
                number, held, names, lengths, total = number + 1, [], [], [], 0
        release_memory()
    if names:
        yield segment()


def write_token_file(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", block: int = 4096,
    segment_tokens: int = 1 << 17, share: float = 0.9
) -> None:
    """Encodes all documents and writes them at path, ascending by id. There are as many ranges as the session's shuffles have, or more: one for RANGE_BYTES of text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES)
    (
        rows.withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(ranges, "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
        .mapInArrow(lambda batches: _segments(batches, tokenizer_path, end_id, block, segment_tokens, share), _SEGMENT_DDL)
        .write.option("compression", "none")
        .parquet(path)
    )


def _documents(batches: Iterator[pa.RecordBatch], keep_ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            stream = np.concatenate([decode_block(row["payload"], at) for at in row["block_starts"]]).astype("<u4")
            ends = np.cumsum(row["doc_tokens"])
            n = len(ends)
            raw = [stream[a:b].tobytes() for a, b in zip((ends - row["doc_tokens"]).tolist(), ends.tolist(), strict=True)]
            columns = ([row["part"]] * n, [row["segment"]] * n, row["doc_ids"], ends - row["doc_tokens"], row["doc_tokens"], [zlib.crc32(x) for x in raw], raw if keep_ids else [None] * n)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _READ, strict=True)], schema=_READ)


def read_token_file(spark: SparkSession, path: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, start (tokens of all documents before it), n_tokens, ids_crc32, and ids if keep_ids."""
    file = spark.read.schema(_SEGMENT_DDL).parquet(path)
    sizes = file.groupBy("part", "segment").agg(F.sum("n_tokens").alias("size"))
    in_part = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    parts = file.groupBy("part").agg(F.sum("n_tokens").alias("size"))  # as many rows as the file has parts
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("part_base"))
    starts = sizes.select("part", "segment", F.coalesce(F.sum("size").over(in_part), F.lit(0)).alias("base")).join(bases, "part")
    return (
        file.mapInArrow(lambda batches: _documents(batches, keep_ids), _READ_DDL)
        .join(starts, ["part", "segment"])
        .select("doc_id", (F.col("part_base") + F.col("base") + F.col("in_segment")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * keep_ids)
    )


_PIECE = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("first", pa.int64()), ("ids", pa.binary())])


def _piece(raw: bytes, starts: list[int], low: int, high: int) -> np.ndarray:
    """The ids [low, high) of a segment, from the blocks that hold them and no others; all blocks but the last are of one length."""
    if high <= low:
        return np.zeros(0, "<u4")
    block = _HEADER.unpack_from(raw, 0)[1]
    some = starts[low // block : (high - 1) // block + 1]
    return np.concatenate([decode_block(raw, at) for at in some])[low % block : low % block + high - low].astype("<u4")


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int], first: int = 0, count: int | None = None) -> DataFrame:
    """doc_id, n_tokens, first and ids: ids [first, first + count) of the named documents, decoded from their blocks alone.

    Their segments are found by a scan of the document ids; of the payloads only those segments' are read. doc_ids: a list that fits a
    plan. A document that stands several times is given as often; one that is not there is not given; beyond a document's end there are no ids.
    """
    wanted = sorted({int(d) for d in doc_ids})
    listed = F.array(*[F.lit(d).cast("long") for d in wanted]) if wanted else F.array().cast("array<long>")
    file = spark.read.schema(_SEGMENT_DDL).parquet(path)
    places = file.filter(F.arrays_overlap("doc_ids", listed)).select("part", "segment").collect()  # at most a few for each named document
    held = F.lit(False)
    for part in {p for p, _ in places}:
        held |= (F.col("part") == part) & F.col("segment").isin([s for p, s in places if p == part])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = set(wanted)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                begin = 0
                for doc, n in zip(row["doc_ids"], row["doc_tokens"], strict=True):
                    if doc in known:
                        low = min(first, n)
                        high = n if count is None else min(n, low + count)
                        out.append((doc, n, low, _piece(row["payload"], row["block_starts"], begin + low, begin + high).tobytes()))
                    begin += n
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 4, _PIECE, strict=True)], schema=_PIECE)

    rows = file.filter(held).select("doc_ids", "doc_tokens", "block_starts", "payload")
    return rows.mapInArrow(read, "doc_id long, n_tokens long, first long, ids binary")
