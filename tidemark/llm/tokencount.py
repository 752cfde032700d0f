"""Token counts (8): documents of flat, unindexed token files, found by their end-of-document ids.

A flat file is a row of ids of fixed width and nothing else. It is read in byte ranges, many tasks to a file,
without regard to documents. Each range (block) is searched with numpy for end ids; what leaves the task is its
number of ids and the places of its ends. A prefix scan over the blocks' summaries (ids, ends, place of the
last end), first within stripes of blocks, then over the stripes, gives each end its place in the file and
stitches documents that run over blocks.

Files are opened by pyarrow's file systems (local, HDFS, S3, GCS), in the task that reads or writes them. A
task writes under a name of its own attempt and renames at the end, so one that is lost and run again leaves
the same file.

Ids after a file's last end form a last, unfinished document (finished = false); a block without ends only
lengthens what runs through it. Empty files and empty tables give no rows. Null text is written as an end
id alone. Repeated rows are counted as often as they stand. A null doc_id is carried as null. Of the input's
columns, only the id and the text are used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import release_memory, text_slices
from .packing import with_end
from .tokens import encoder

#: Ids to a block, blocks to a stripe, bytes of files to a task about.
BLOCK_IDS, STRIPE_BLOCKS, TASK_BYTES = 1 << 16, 4096, 1 << 26
_LISTED_DDL = "file string, doc_no long, doc_id long"
_LISTED = pa.schema([("file", pa.string()), ("doc_no", pa.int64()), ("doc_id", pa.int64())])
_ENDS_DDL = "file string, block long, file_ids long, n_ids long, ends array<long>"
_ENDS = pa.schema([("file", pa.string()), ("block", pa.int64()), ("file_ids", pa.int64()), ("n_ids", pa.int64()), ("ends", pa.list_(pa.int64()))])


def _opened(uri: str) -> tuple[FileSystem, str]:
    """The file system of a folder or file; file:/x is file:///x."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = f"file://{uri[5:]}"
    return FileSystem.from_uri(uri)


def _write(batches: Iterator[pa.RecordBatch], folder: str, path: str, end_id: int, dtype: str) -> Iterator[pa.RecordBatch]:
    task, tokens = TaskContext.get(), encoder(path)
    name, (files, place), listed = f"part-{task.partitionId():05d}.bin", _opened(folder), 0
    attempt = f"{place}/.{name}-{task.taskAttemptId()}"
    files.create_dir(place, recursive=True)
    with files.open_output_stream(attempt) as out:
        for batch in batches:
            for low, high, data, offsets in text_slices(batch.column(1)):
                stream, _ = with_end(*tokens.encode(data, offsets), end_id)
                out.write(stream.astype(dtype).tobytes())
                numbers = pa.array(np.arange(listed, listed + high - low))
                yield pa.RecordBatch.from_arrays([pa.array([name] * (high - low)), numbers, batch.column(0).slice(low, high - low)], schema=_LISTED)
                listed += high - low
            release_memory()
    files.move(attempt, f"{place}/{name}")


def write_flat_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", dtype: str = "<u2") -> DataFrame:
    """Writes one flat file per partition, as the rows of the result are computed: file, doc_no (in its file) and doc_id of the documents written."""
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return named.mapInArrow(lambda batches: _write(batches, folder, tokenizer_path, end_id, dtype), _LISTED_DDL)


def _ends(batches: Iterator[pa.RecordBatch], end_id: int, block: int, dtype: str) -> Iterator[pa.RecordBatch]:
    width, last, source = np.dtype(dtype).itemsize, None, None
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for uri, number, total in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if uri != last:
                if source:
                    source.close()
                files, place = _opened(uri)
                source, last = files.open_input_file(place), uri
            ids = np.frombuffer(source.read_at(min(block, total - number * block) * width, number * block * width), dtype)
            for column, value in zip(out, (uri.rsplit("/", 1)[-1], number, total, len(ids), np.flatnonzero(ids == end_id)), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _ENDS, strict=True)], schema=_ENDS)
    if source:
        source.close()


def file_ends(spark: SparkSession, folder: str, end_id: int, block: int = BLOCK_IDS, dtype: str = "<u2") -> DataFrame:
    """One row per block of the folder's files: file (its name), block, file_ids, n_ids and ends (places of end ids in the block)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!._]*").load(folder).select("path", "length")  # the contents are not read here
    tasks = 1 + (files.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES
    sized = files.select("path", F.expr(f"length div {np.dtype(dtype).itemsize}").alias("file_ids")).filter("file_ids > 0")
    blocks = sized.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(file_ids - 1) div {block}"))).alias("block"), "file_ids")
    return blocks.repartitionByRange(int(tasks), "path", "block").mapInArrow(lambda batches: _ends(batches, end_id, block, dtype), _ENDS_DDL)


def count_tokens(found: DataFrame, stripe_blocks: int | None = None) -> DataFrame:
    """Of rows of file_ends: file, doc_no (from 0 in its file), start, n_tokens (with the end id) and finished. found is read twice."""
    stripe = F.floor(F.col("block") / (stripe_blocks or STRIPE_BLOCKS))
    summary = found.select("file", stripe.alias("stripe"), "block", "n_ids", F.size("ends").cast("long").alias("n_ends"), F.try_element_at("ends", F.lit(-1)).alias("last_end"))
    before = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    inner = before(["file", "stripe"], "block")
    placed = summary.withColumns({"ids_in": earlier("n_ids", inner), "ends_in": earlier("n_ends", inner)}).withColumn("after_in", F.col("ids_in") + F.col("last_end") + 1)
    placed = placed.withColumn("open_in", F.max("after_in").over(inner))  # the id after the last end before this block, if one is in its stripe
    stripes = placed.groupBy("file", "stripe").agg(F.sum("n_ids").alias("stripe_ids"), F.sum("n_ends").alias("stripe_ends"), F.max("after_in").alias("stripe_after"))
    outer = before(["file"], "stripe")
    stripes = stripes.withColumns({"ids_before": earlier("stripe_ids", outer), "ends_before": earlier("stripe_ends", outer)}).withColumn("after", F.col("ids_before") + F.col("stripe_after"))
    stripes = stripes.select("file", "stripe", "ids_before", "ends_before", F.coalesce(F.max("after").over(outer), F.lit(0)).alias("open_before"))
    bases = placed.join(stripes, ["file", "stripe"]).select(
        "file", "block", (F.col("ids_before") + F.col("ids_in")).alias("base"), (F.col("ends_before") + F.col("ends_in")).alias("first_no"), F.coalesce(F.col("ids_before") + F.col("open_in"), "open_before").alias("open_from")
    )
    carried = found.join(bases, ["file", "block"]).withColumn("after", F.transform("ends", lambda e: e + F.col("base") + 1))
    starts = F.concat(F.array("open_from"), "after")
    open_end = (F.col("base") + F.col("n_ids") == F.col("file_ids")) & (F.element_at(starts, -1) < F.col("file_ids"))
    stops = F.when(open_end, F.concat("after", F.array("file_ids"))).otherwise(F.col("after"))
    each = carried.select("file", "first_no", F.size("after").alias("n_after"), starts.alias("starts"), F.posexplode(stops).alias("k", "stop"))
    start = F.get("starts", F.col("k"))
    return each.select("file", (F.col("first_no") + F.col("k")).alias("doc_no"), start.alias("start"), (F.col("stop") - start).alias("n_tokens"), (F.col("k") < F.col("n_after")).alias("finished"))
