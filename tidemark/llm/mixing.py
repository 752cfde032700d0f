"""Mixing sources to target weights (1): multinomial shard counts and pseudorandom index permutations.

Each source's documents lie end to end as one stream of words, cut into blocks of fixed length. The mix
takes whole blocks. A source's quota of blocks follows from its target; for every output shard the counts
of its sources are drawn from the multinomial distribution of what is left of the quotas. The j-th draw
of a source is mapped through a keyed permutation of its block numbers, a new one each time that all
blocks are used up, so no block is taken more often than another by more than once. Drawn blocks are
joined with the blocks of the streams by (source, number).

Sources are ordered by code point, null last. Null, empty or blank text has no words and is not taken.
Empty table: no rows. Repeated rows lie in the stream as often as they stand. A text longer than a block
is cut. Documents with a null doc_id take part. Other columns of the input are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import materialize, text_slices, words

#: Rows of a source's stream that are put in order together.
ROWS_EACH = 100_000
_CHUNK = 1 << 16


def targets(sizes: list[int], weights: list[float], limit: float) -> list[float]:
    """Shares of all sizes by weight, none above limit times its size; the excess is shared again by weight."""
    out, free, left = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while free:
        weight = sum(weights[k] for k in free)
        over = [k for k in free if left * weights[k] / weight > limit * sizes[k]]
        for k in over or free:
            out[k] = float(limit * sizes[k]) if over else left * weights[k] / weight
        if not over:
            break
        left -= sum(out[k] for k in over)
        free = [k for k in free if k not in over]
    return out


def shard_counts(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """Blocks of each source (columns) in each shard (rows); columns sum to the quotas, shards are equally long but for one block."""
    random, left = np.random.default_rng(seed), np.array(quotas, np.int64)
    total = int(left.sum())
    out = np.zeros((shards, len(quotas)), np.int64)
    for k in range(shards):
        room = total * (k + 1) // shards - total * k // shards
        while room:
            rest = left - out[k]
            drawn = np.minimum(random.multinomial(room, rest / rest.sum()), rest)
            out[k] += drawn
            room -= int(drawn.sum())
        left -= out[k]
    return out


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Keyed pseudorandom permutations of 0 to n - 1: a four-round Feistel network on the next even power of 2, walked until below n."""
    n = np.maximum(n, 1)
    half = np.maximum((np.ceil(np.log2(np.maximum(n, 2) + 1)).astype(np.int64) + 1) // 2, 1).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    limit, key = n.astype(np.uint64), key.astype(np.uint64)
    while len(todo):
        h, m = half[todo], mask[todo]
        a, b = out[todo] >> h, out[todo] & m
        for turn in range(4):
            x = (b ^ key[todo] ^ np.uint64(turn * 0x9E3779B9)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            a, b = b, a ^ ((x >> np.uint64(31)) & m)
        out[todo] = (a << h) | b
        todo = todo[out[todo] >= limit[todo]]
    return out.astype(np.int64)


@F.pandas_udf(LongType())
def _permuted(index: pd.Series, n: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series(permuted(index.to_numpy(), n.to_numpy(), key.to_numpy()))


_PIECES_DDL = "array<struct<block: long, first_word: long, n_words: long, text: string>>"
_PIECE = pa.struct([("block", pa.int64()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("text", pa.string())])


def _cutter(block_words: int):
    def cut(texts: pa.Array, starts: pa.Array) -> pa.Array:
        """Each text's pieces at the bounds of blocks; a piece reaches to the next one's first word, so that none of the text is lost."""
        out, at = [], starts.to_pylist()
        for low, _, data, offsets in text_slices(texts):
            word_starts, _, bounds = words(data, offsets)
            for k in range(len(offsets) - 1):
                n, start = int(bounds[k + 1] - bounds[k]), at[low + k]
                own = word_starts[bounds[k] : bounds[k + 1]]
                cuts = [0, *range(block_words - start % block_words, n, block_words), n]
                places = [int(offsets[k]), *own[cuts[1:-1]].tolist(), int(offsets[k + 1])]
                out.append([
                    {"block": (start + a) // block_words, "first_word": a, "n_words": b - a, "text": data[p:q].tobytes().decode()} for a, b, p,
                    q in zip(cuts, cuts[1:], places, places[1:], strict=False)
                ])
        return pa.array(out, pa.list_(_PIECE))

    return cut


class Mix:
    """A planned mix. docs need id_col, source_col and size_col (words), and tie_col, which orders rows of equal id."""

    def __init__(
        self, docs: DataFrame, size_col: str, tie_col: str, id_col: str = "doc_id", source_col: str = "source", text_col: str | None = None,
        carry: tuple[str, ...] = (), weights: tuple[float, ...] = (1, 2, 3), limit: float = 3, block_words: int = 32, shards: int = 256, seed: int = 5
    ):
        self.block_words, self.seed, spark = block_words, seed, docs.sparkSession
        more = {c: F.col(c) for c in carry} | ({"text": F.col(text_col).cast("string")} if text_col else {})
        self.text = text_col is not None
        rows = docs.select(
            F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), F.col(size_col).cast("long").alias("size"),
            F.col(tie_col).cast("long").alias("tie"), *[c.alias(k) for k, c in more.items()]
        )
        buckets = max(256, docs.count() // ROWS_EACH)
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(buckets)))
        sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
        before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = materialize(sums.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(before), F.lit(0))))
        sizes = [(r[0], r[1]) for r in sums.groupBy("source").agg(F.sum("bucket_size")).collect()]  # one row a source
        sizes.sort(key=lambda x: (x[0] is None, x[0]))
        self.targets = targets([n for _, n in sizes], [weights[k % len(weights)] for k in range(len(sizes))], limit)
        blocks = [-(-n // block_words) for _, n in sizes]
        quotas = [min(int(limit) * b, round(b * t / n)) if n else 0 for (_, n), t, b in zip(sizes, self.targets, blocks, strict=True)]
        self.counts = shard_counts(quotas, shards, seed)
        self.blocks = blocks
        self.sources = spark.createDataFrame([(s, k, n, self.targets[k]) for k, (s, n) in enumerate(sizes)], "source string, source_no int, source_size long, target double")
        own = Window.partitionBy("source_no", "bucket").orderBy("doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
        keyed = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "bucket_start").join(self.sources, F.col("s").eqNullSafe(F.col("source")))
        rows = rows.join(keyed.drop("source"), rows["source"].eqNullSafe(F.col("s")) & (rows["bucket"] == F.col("b"))).drop("s", "b")
        #: One row per document: its source, and where it starts in its source's stream.
        self.placed = materialize(rows.withColumn("start", F.col("bucket_start") + F.coalesce(F.sum("size").over(own), F.lit(0))).drop("bucket", "bucket_start", "tie"))

    def pieces(self) -> DataFrame:
        """source_no, block, doc_id, start, first_word (in the document) and n_words, for each block that a document reaches into; with text, the piece's."""
        full, kept = self.placed.filter("size > 0"), [c for c in self.placed.columns if c not in ("text", "size", "source_size", "target")]
        if self.text:
            return full.select(*kept, F.inline(F.arrow_udf(_cutter(self.block_words), _PIECES_DDL)("text", "start")))
        cut = full.withColumn("block", F.explode(F.sequence(F.expr(f"start div {self.block_words}"), F.expr(f"(start + size - 1) div {self.block_words}"))))
        first = F.greatest(F.col("block") * self.block_words - F.col("start"), F.lit(0))
        end = F.least((F.col("block") + 1) * self.block_words - F.col("start"), F.col("size"))
        return cut.select(*kept, "block", first.alias("first_word"), (end - first).alias("n_words"))

    def slots(self) -> DataFrame:
        """shard, place (within the shard, sources mixed), source_no and block, for each block that the mix takes."""
        rows, done = [], np.zeros(len(self.blocks), np.int64)
        for shard, counts in enumerate(self.counts.tolist()):
            at, room = 0, sum(counts)
            for source, n in enumerate(counts):
                if n:
                    rows.append((shard, source, int(done[source]), n, at, room, self.blocks[source]))
                at, done[source] = at + n, done[source] + n
        spark = self.sources.sparkSession
        drawn = spark.createDataFrame(rows, "shard int, source_no int, first long, n long, at long, room long, n_blocks long").repartition(spark.sparkContext.defaultParallelism)
        chunks = drawn.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {_CHUNK}")))).withColumn("low", F.col("chunk") * _CHUNK)
        each = chunks.withColumn("k", F.explode(F.sequence("low", F.least(F.col("low") + _CHUNK, F.col("n")) - 1))).withColumn("j", F.col("first") + F.col("k"))
        key = F.xxhash64("source_no", F.expr("j div n_blocks"), F.lit(self.seed))
        place = F.xxhash64("shard", F.lit(self.seed + 1))
        return each.select(
            "shard", _permuted(F.col("at") + F.col("k"), F.col("room"), place).alias("place"), "source_no",
            _permuted(F.col("j") % F.col("n_blocks"), F.col("n_blocks"), key).alias("block")
        )

    def rows(self) -> DataFrame:
        """The mix: each taken block's pieces, with shard and place."""
        return self.slots().hint("merge").join(self.pieces(), ["source_no", "block"])  # exploded: its size is not known beforehand

    def taken(self) -> DataFrame:
        """The documents with taken, the words that the mix takes of each."""
        sums = self.rows().groupBy(F.col("source_no").alias("no"), F.col("start").alias("at")).agg(F.sum("n_words").alias("taken"))
        found = (F.col("source_no") == F.col("no")) & (F.col("start") == F.col("at")) & (F.col("size") > 0)
        return self.placed.join(sums, found, "left").withColumn("taken", F.coalesce("taken", F.lit(0))).drop("no", "at")
