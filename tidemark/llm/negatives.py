"""Hard-negative mining by threshold joins in the manner of L2AP (11).

Vectors lie in blocks, sorted by length, label and norm. A block orders its dimensions by their energy and has,
for each run of dimensions, a list of its vectors sorted by the norm of what they have left from that run on. At a
threshold, only the head of a list is read: a vector whose remaining norm times the anchor's cannot reach the
threshold is omitted from the list of this and of all later runs. Partial scores are accumulated run by run, and a pair is
dropped as soon as its partial score and the product of both remaining norms stay below the threshold. Pairs that are
left with omitted runs are completed from the whole vectors, so all scores are exact.

An anchor's positives are its best rows of the same label. Their search begins at a high threshold, which is lowered
for those anchors whose window is not full yet, at last without one. A positive's negatives are the best rows of other
labels between a share of its score and that score; that window is searched from its top, and lowered to its bottom while
it is not full. Each round is one join of groups of anchors with the blocks that may hold something: groups go to every lane
of blocks, and blocks whose labels or largest norm rule them out are left out by the join.

Components are whole numbers. Rows with a null id, label, vector or component take no part; a row of another length than the
anchor's is no candidate of it, nor is a row with its id. Rows count as often as they stand: repeated candidates are so many,
and a repeated anchor gives its rows again. Ties go to the smaller id. A positive with a score below 0 has an empty window. A
score that 64 bits cannot hold is an error. Empty table: no rows. Other columns of the input are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

#: Vectors and bytes to a block at most; anchors to a group; dimensions to a run.
BLOCK_ROWS, BLOCK_BYTES, GROUP_ROWS, RUN = 4096, 1 << 21, 512, 16
#: Blocks to a lane, once each block has had a lane of its own up to so many.
LANE_BLOCKS, LANES = 16, 64
#: Thresholds of positives, as shares of the anchor's norm times the root mean square of the norms of its length; the last round has none.
POSITIVE_LEVELS = (0.5, 0.35, 0.2)
#: Of the way from the window's bottom to its top, what the rounds of negatives leave out at the lower end; the last leaves out none.
NEGATIVE_LEVELS = (0.8, 0.5)
#: The hint for joins of what grows with the vectors: the planner goes by their size on disk, before groups are dealt to all lanes, and would send them through the driver.
_SHUFFLED = "merge"
_EXACT, _LARGEST = float(2**52), float(2**63)
_BLOCK = "block long, length int, label_low long, label_high long, norm double, ids binary, labels binary, matrix binary, dims binary, lists binary, bounds binary"
_GROUP = "length int, label_low long, label_high long, need double, rows binary, ids binary, labels binary, matrix binary, thresholds binary, window_of binary, window_top binary, window_bottom binary"
_FOUND = "row long, top long, id long, score long"


def _suffix_norms(matrix: np.ndarray) -> np.ndarray:
    """For each run of dimensions, each vector's norm from there on; a row of zeros at the end."""
    squares = matrix.astype(np.float64) ** 2
    runs = range(0, matrix.shape[1], RUN)
    sums = np.array([squares[:, k : k + RUN].sum(axis=1) for k in runs]).reshape(len(runs), len(matrix))
    return np.sqrt(np.concatenate([np.cumsum(sums[::-1], axis=0)[::-1], np.zeros((1, len(matrix)))]))


def _block(g: pd.DataFrame, number: int) -> dict:
    matrix = np.array(g["vector"].tolist(), np.int64).reshape(len(g), -1)
    dims = np.argsort(-(matrix.astype(np.float64) ** 2).sum(axis=0), kind="stable").astype(np.int32)
    matrix = np.ascontiguousarray(matrix[:, dims])
    left = _suffix_norms(matrix)
    lists = np.argsort(-left, axis=1, kind="stable").astype(np.int32)
    labels = g["label"].to_numpy(np.int64)
    return {
        "block": number, "length": matrix.shape[1], "label_low": int(labels.min()), "label_high": int(labels.max()), "norm": float(left[0].max()), "ids": g["id"].to_numpy(np.int64).tobytes(),
        "labels": labels.tobytes(), "matrix": matrix.tobytes(), "dims": dims.tobytes(), "lists": lists.tobytes(), "bounds": np.take_along_axis(left, lists.astype(np.int64), axis=1).tobytes(),
    }


def _runs_of(frames: Iterator[pd.DataFrame], most) -> Iterator[pd.DataFrame]:
    """Rows sorted by length in pieces of one length, of at most so many rows as most gives for that length."""
    held = None
    for frame in frames:
        held = frame if held is None else pd.concat([held, frame], ignore_index=True)
        while held is not None and len(held):
            n = int(held["length"].iloc[0])
            same, limit = int((held["length"] == n).sum()), most(n)
            if same == len(held) and same < limit:
                break
            cut = min(same, limit)
            yield held.iloc[:cut]
            held = held.iloc[cut:].reset_index(drop=True)
    if held is not None and len(held):
        yield held


def build_index(vectors: DataFrame) -> DataFrame:
    """One row a block, of vectors with id, label, vector, length and norm."""
    rows, size = BLOCK_ROWS, BLOCK_BYTES

    def blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        for piece in _runs_of(frames, lambda n: max(1, min(rows, size // (8 * max(1, n))))):
            yield pd.DataFrame([_block(piece, number)])
            number += 1

    order = ["length", "label", "norm", "id"]
    return vectors.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "label", "vector", "length").mapInPandas(blocks, _BLOCK)


def _groups(anchors: DataFrame) -> DataFrame:
    """anchors: row, id, label, vector, length, norm, threshold (double, of the score; -inf: none), tops and bottoms (of windows; null: no windows)."""
    group_rows = GROUP_ROWS

    def group(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _runs_of(frames, lambda n: group_rows):
            labels, threshold = g["label"].to_numpy(np.int64), g["threshold"].to_numpy(np.float64)
            norm = g["norm"].to_numpy(np.float64)
            need = np.where(threshold <= 0, -np.inf, threshold / np.maximum(norm, 1e-300)).min()
            tops = [np.array([] if x is None else x, np.int64) for x in g["tops"]]
            bottoms = [np.array([] if x is None else x, np.int64) for x in g["bottoms"]]
            yield pd.DataFrame([{
                "length": int(g["length"].iloc[0]), "label_low": int(labels.min()), "label_high": int(labels.max()), "need": float(need), "rows": g["row"].to_numpy(np.int64).tobytes(),
                "ids": g["id"].to_numpy(np.int64).tobytes(), "labels": labels.tobytes(), "matrix": np.array(g["vector"].tolist(), np.int64).tobytes(), "thresholds": threshold.tobytes(),
                "window_of": np.repeat(np.arange(len(g)), [len(x) for x in tops]).astype(np.int64).tobytes(), "window_top": np.concatenate(tops).tobytes(), "window_bottom": np.concatenate(bottoms).tobytes(),
            }])

    order = ["length", "label", "row"]
    return anchors.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(group, _GROUP)


def scores_above(queries: np.ndarray, thresholds: np.ndarray, wanted: np.ndarray, matrix: np.ndarray, lists: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries, vectors and exact scores of all wanted pairs (a matrix of booleans) that reach the query's threshold.

    queries and matrix: with their dimensions in the block's order. lists and bounds: for each run of dimensions the vectors by falling
    remaining norm, and those norms.
    """
    left = np.empty_like(bounds)
    np.put_along_axis(left, lists.astype(np.int64), bounds, axis=1)
    mine = _suffix_norms(queries)
    largest = float(mine[0].max(initial=0)) * float(left[0].max(initial=0))
    if largest >= _LARGEST:
        raise ValueError("a score may be too large for 64 bits")
    exact = np.float64 if largest < _EXACT else np.int64
    room = 1e-9 * largest + 1e-6
    bar = (thresholds - room)[:, None]
    alive = wanted & (mine[0][:, None] * left[0] >= bar)
    partial = np.zeros(alive.shape, exact)
    seen = np.zeros(len(matrix), np.int64)  # runs that are in a vector's partial scores
    for run in range(len(left) - 1):
        own, some = alive.any(axis=1), alive.any(axis=0)
        if alive.sum() * 32 < alive.size:
            break
        need = (bar[own, 0] / np.maximum(mine[run][own], 1e-300)).min()
        head = lists[run, : len(matrix) if need <= 0 else np.searchsorted(-bounds[run], -need, "right")]
        head = np.sort(head[some[head] & (seen[head] == run)])  # what was omitted before stays so
        at = slice(run * RUN, run * RUN + RUN)
        if 2 * len(head) > len(matrix):  # most vectors: those that are left out are put back
            rest = np.setdiff1d(np.arange(len(matrix)), head)
            kept = partial[:, rest]
            partial += queries[:, at].astype(exact) @ matrix[:, at].astype(exact).T
            partial[:, rest] = kept
        else:
            partial[:, head] += queries[:, at].astype(exact) @ matrix[head, at].astype(exact).T
        seen[head] = run + 1
        reach = partial + np.multiply.outer(mine[run + 1], left[run + 1])
        rest = np.flatnonzero(seen < run + 1)
        if len(rest):
            reach[:, rest] = partial[:, rest] + mine[seen[rest]].T * left[seen[rest], rest]
        alive &= reach >= bar
    q, v = np.nonzero(alive)
    scores = partial[q, v].astype(np.int64)
    for low in range(0, len(q), 1 << 16):
        some = low + np.flatnonzero(seen[v[low : low + (1 << 16)]] < len(left) - 1)
        scores[some] = np.einsum("ij,ij->i", queries[q[some]], matrix[v[some]])
    kept = scores >= thresholds[q]
    return q[kept], v[kept], scores[kept]


def _firsts(keys: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each key, by falling score and then id."""
    order = np.lexsort((ids, -scores, keys))
    new = np.ones(len(order), bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    begin = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0)) if len(order) else order
    return order[np.arange(len(order)) - begin < k]


def _search(index: DataFrame, anchors: DataFrame, lanes: int, same_label: bool, k: int) -> DataFrame:
    """row, top (null without windows), id and score: the first k of each anchor or window in each block, by falling score."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                rows, own_ids, own_labels = (np.frombuffer(x, np.int64) for x in (r.rows, r.own_ids, r.own_labels))
                ids, labels, dims = np.frombuffer(r.ids, np.int64), np.frombuffer(r.labels, np.int64), np.frombuffer(r.dims, np.int32)
                shape = (-1, len(ids))
                queries = np.frombuffer(r.queries, np.int64).reshape(len(rows), -1)[:, dims]
                wanted = ((own_labels[:, None] == labels) == same_label) & (own_ids[:, None] != ids)
                lists, bounds = np.frombuffer(r.lists, np.int32).reshape(shape), np.frombuffer(r.bounds, np.float64).reshape(shape)
                q, v, scores = scores_above(queries, np.frombuffer(r.thresholds, np.float64), wanted, np.frombuffer(r.matrix, np.int64).reshape(len(ids), -1), lists, bounds)
                if same_label:
                    best = _firsts(q, scores, ids[v], k)
                    yield pd.DataFrame({"row": rows[q[best]], "top": np.int64(0), "id": ids[v[best]], "score": scores[best]})
                    continue
                of, top, bottom = (np.frombuffer(x, np.int64) for x in (r.window_of, r.window_top, r.window_bottom))
                begin = np.searchsorted(q, np.arange(len(rows) + 1))  # pairs come by query
                for w in range(len(of)):
                    part = slice(begin[of[w]], begin[of[w] + 1])
                    inside = begin[of[w]] + np.flatnonzero((scores[part] <= top[w]) & (scores[part] >= bottom[w]))
                    best = inside[np.lexsort((ids[v[inside]], -scores[inside]))[:k]]
                    if len(best):
                        yield pd.DataFrame({"row": rows[of[w]], "top": top[w], "id": ids[v[best]], "score": scores[best]})

    groups = _groups(anchors).select(
        "rows", "need", "thresholds", "window_of", "window_top", "window_bottom", F.col("length").alias("own_length"), F.col("label_low").alias("own_low"), F.col("label_high").alias("own_high"),
        F.col("ids").alias("own_ids"), F.col("labels").alias("own_labels"), F.col("matrix").alias("queries"), F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("own_lane")
    )
    able: Column = (F.col("lane") == F.col("own_lane")) & (F.col("length") == F.col("own_length")) & (F.col("norm") * (1 + 1e-9) + 1e-6 >= F.col("need"))
    if same_label:
        able &= (F.col("label_low") <= F.col("own_high")) & (F.col("label_high") >= F.col("own_low"))
    blocks = index.withColumn("lane", F.pmod(F.xxhash64("block"), F.lit(lanes)).cast("int"))
    pairs = groups.hint(_SHUFFLED).join(blocks, able)  # a lane's blocks are held, groups go by
    taken = ["rows", "own_ids", "own_labels", "queries", "thresholds", "window_of", "window_top", "window_bottom", "ids", "labels", "dims", "matrix", "lists", "bounds"]
    return pairs.select(taken).mapInPandas(read, _FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("row", "top").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _rounds(index: DataFrame, anchors: DataFrame, lanes: int, same_label: bool, k: int, levels: tuple[float | None, ...], at_level) -> DataFrame:
    """The first k of each anchor, or of each of its windows, from rounds of falling thresholds. anchors: written, with tops (null: no windows)."""
    done, open_ = None, anchors
    for level in levels:
        found = materialize(_ranked(_search(index, at_level(open_, level), lanes, same_label, k), k))
        full = found.filter(F.col("rank") == k).select("row", "top")
        kept = found if level is None else found.join(full.hint(_SHUFFLED), ["row", "top"], "left_semi")
        done = kept if done is None else done.unionByName(kept)
        if level is None:
            break
        if same_label:
            rest = open_.join(full.select("row").hint(_SHUFFLED), "row", "left_anti")
        else:
            filled = full.groupBy("row").agg(F.collect_set("top").alias("filled"))
            left = F.array_except("tops", F.coalesce("filled", F.array().cast("array<long>")))
            rest = open_.join(filled.hint(_SHUFFLED), "row", "left").withColumn("tops", left).drop("filled").filter(F.size("tops") > 0)
        rest = materialize(rest)
        if open_ is not anchors:
            discard(open_)
        open_ = rest
        if open_.isEmpty():
            break
    return done


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, least: tuple[int, int] = (80, 100)) -> DataFrame:
    """vectors and anchors: id, label (whole numbers) and vector (array<long>). least: the share of a positive's score that a negative has at least.

    Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score. The index is written in the shared folder.
    """
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))

    def clean(df: DataFrame) -> DataFrame:
        sound = df.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<long>").alias("vector")).dropna()
        return sound.filter(~F.exists("vector", F.isnull)).withColumns({"length": F.size("vector"), "norm": F.sqrt(squares)})

    rows = clean(vectors)
    typical = rows.groupBy("length").agg(F.sqrt(F.avg(F.col("norm") * F.col("norm"))).alias("typical"))
    index = materialize(build_index(rows))
    blocks = index.count()
    lanes = max(1, min(blocks, LANES), blocks // LANE_BLOCKS)
    none = F.lit(None).cast("array<long>")
    asked = materialize(clean(anchors).withColumn("row", F.monotonically_increasing_id()).join(typical, "length").withColumns({"tops": none, "bottoms": none}))

    def positive_level(open_: DataFrame, level: float | None) -> DataFrame:
        return open_.withColumn("threshold", F.lit(float("-inf")) if level is None else F.ceil(F.col("norm") * F.col("typical") * level).cast("double"))

    mine = _rounds(index, asked, lanes, True, positives, (*POSITIVE_LEVELS, None), positive_level)
    mine = materialize(mine.select("row", F.col("id").alias("positive_id"), F.col("score").alias("top")))

    def negative_level(open_: DataFrame, level: float | None) -> DataFrame:
        lowest = lambda p: F.ceil(p.cast("decimal(38,0)") * least[0] / least[1]).cast("long")
        reached = lambda p: lowest(p) + F.floor((p - lowest(p)) * (level or 0.0))
        bottoms = F.transform("tops", reached)
        return open_.withColumn("bottoms", bottoms).withColumn("threshold", F.array_min("bottoms").cast("double"))

    windows = mine.filter(F.col("top") >= 0).groupBy("row").agg(F.collect_set("top").alias("tops"))
    facing = materialize(asked.drop("tops").join(windows.hint(_SHUFFLED), "row"))
    theirs = _rounds(index, facing, lanes, False, negatives, (*NEGATIVE_LEVELS, None), negative_level)
    out = mine.hint(_SHUFFLED).join(theirs.select("row", "top", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), ["row", "top"])
    named = out.join(asked.select("row", F.col("id").alias("anchor_id")).hint(_SHUFFLED), "row")
    return named.select("anchor_id", "positive_id", "rank", "negative_id", F.col("top").alias("positive_score"), "negative_score")
