"""Exact top-k search (2): a pivot-distance index, read from the nearest annulus outwards.

Vectors are keyed by their nearest pivot and their distance to it, sorted by that key and stored in
blocks: each block is an annulus around its pivot. To search the largest inner products as nearest
neighbours, a vector x counts as lengthened by one component, the root of M - |x|^2 with M the largest
|x|^2; then |q - x|^2 = |q|^2 + M - 2 (q, x). By the triangle inequality no vector of an annulus is nearer
to q than q's distance to the pivot is outside of the annulus' range of distances. The number of pivots
grows with the root of the number of vectors, up to a bound.

Each query first reads the annulus of its nearest pivot that lies nearest to it; the k-th best score there
is its bar. Then, for every pivot whose whole range of distances may reach the bar, the run of annuli that
may is taken: they are sorted, so it is found by bisection, and all beyond its ends are out of reach. Queries
travel in groups. A group's demands go to the pivots as numbers of queries and distances; vectors are only
sent to the annuli that are read.

Vectors have integer components. Null vectors, and vectors with null components, take no part; nor do rows
with a null id. Candidates are rows: a row that is repeated counts as often as it stands, and so does a
repeated query; rows with a query's own id are no candidates of it. Vectors of another length than the query
are no candidates of it. Ties go to the smaller id. A score that 64 bits cannot hold is an error. Empty table:
no rows. Other columns of the input are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ranges

#: Pivots at least and at most, drawn by a hash of id; vectors and bytes to a block at most; queries to a group.
PIVOTS, BLOCK_ROWS, BLOCK_BYTES, GROUP_ROWS = (16, 1024), 4096, 1 << 21, 512
_EXACT, _LARGEST = float(2**52), float(2**63)


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows: exact in double precision while no sum can exceed 2**52, else in 64-bit integers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    about = a.astype(np.float64) @ b.astype(np.float64).T
    if most < _EXACT:
        return about.astype(np.int64)
    if np.abs(about).max() >= _LARGEST:
        raise ValueError("an inner product is too large for 64 bits")
    return a @ b.T


class _Pivots:
    """The pivots by length of vector, in lengthened space."""

    def __init__(self, vectors: list[np.ndarray], largest: float):
        self.largest = largest
        self.by_length: dict[int, np.ndarray] = {}
        for n in sorted({len(v) for v in vectors}):
            self.by_length[n] = self.lengthened(np.array([v for v in vectors if len(v) == n], np.float64))

    def lengthened(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(self.largest - (x * x).sum(axis=1, keepdims=True), 0))])

    def distances(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Distances of vectors of one length to its pivots; a query is lengthened by 0."""
        pivots = self.by_length.get(x.shape[1])
        if pivots is None:
            return np.zeros((len(x), 1))
        x = x.astype(np.float64)
        x = np.hstack([x, np.zeros((len(x), 1))]) if query else self.lengthened(x)
        squared = (x * x).sum(axis=1, keepdims=True) + (pivots * pivots).sum(axis=1) - 2 * x @ pivots.T
        return np.sqrt(np.maximum(squared, 0))


def _by_length(vectors: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and stacked vectors, for each length."""
    lengths = vectors.map(len).to_numpy()
    for n in np.unique(lengths):
        places = np.flatnonzero(lengths == n)
        yield places, np.array(vectors.iloc[places].tolist(), np.int64).reshape(len(places), n)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= bar)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def build_index(vectors: DataFrame, pivots: _Pivots) -> DataFrame:
    """One row per block: block, length, pivot, low and high (distances), ids and matrix (64-bit integers)."""

    @F.pandas_udf("pivot int, distance double")
    def key(vector: pd.Series) -> pd.DataFrame:
        pivot, distance = np.zeros(len(vector), np.int32), np.zeros(len(vector))
        for places, x in _by_length(vector):
            d = pivots.distances(x, query=False)
            pivot[places] = d.argmin(axis=1)
            distance[places] = d.min(axis=1)
        return pd.DataFrame({"pivot": pivot, "distance": distance})

    block_rows, block_bytes = BLOCK_ROWS, BLOCK_BYTES
    rows_of = lambda g: max(1, min(block_rows, block_bytes // (8 * max(1, int(g["length"].iloc[0])))))

    def blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number, held = TaskContext.get().partitionId(), 0, None
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame])
            groups = [g for _, g in held.groupby(["length", "pivot"], sort=False)]
            for g in groups[:-1]:
                for low in range(0, len(g), rows_of(g)):
                    yield _block(g.iloc[low : low + rows_of(g)], (part << 32) + number)
                    number += 1
            held = groups[-1] if groups else None
            while held is not None and len(held) > rows_of(held):
                most = rows_of(held)
                yield _block(held.iloc[:most], (part << 32) + number)
                held, number = held.iloc[most:], number + 1
        if held is not None and len(held):
            yield _block(held, (part << 32) + number)

    keyed = vectors.select("id", "vector", F.size("vector").alias("length"), key("vector").alias("key")).select("id", "vector", "length", "key.*")
    order = ["length", "pivot", "distance", "id"]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(blocks, "block long, length int, pivot int, low double, high double, ids binary, matrix binary")


def _block(g: pd.DataFrame, number: int) -> pd.DataFrame:
    matrix = np.array(g["vector"].tolist(), np.int64).reshape(len(g), -1)
    return pd.DataFrame({
        "block": [number], "length": g["length"].iloc[:1].to_numpy(), "pivot": g["pivot"].iloc[:1].to_numpy(), "low": [g["distance"].min()],
        "high": [g["distance"].max()], "ids": [g["id"].to_numpy(np.int64).tobytes()], "matrix": [matrix.tobytes()]
    })


def _read(frame: pd.DataFrame, k: int) -> Iterator[pd.DataFrame]:
    """Of groups of queries joined with blocks: the k best in the block for each query that places names."""
    for row in frame.itertuples():
        ids, all_ids, places = np.frombuffer(row.ids, np.int64), np.frombuffer(row.query_ids, np.int64), np.frombuffer(row.places, np.int32)
        own = all_ids[places]
        scores = _scores(np.frombuffer(row.queries, np.int64).reshape(len(all_ids), -1)[places], np.frombuffer(row.matrix, np.int64).reshape(len(ids), -1))
        out = []
        for i, q in enumerate(own):
            candidates = np.flatnonzero(ids != q)
            best = candidates[_best(ids[candidates], scores[i][candidates], k)]
            out.append(pd.DataFrame({"query_id": q, "id": ids[best], "score": scores[i][best]}))
        if out:
            yield pd.concat(out)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query with their rank; Spark cuts to k before the rows are dealt out by query."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def pivot_count(rows: int) -> int:
    return max(PIVOTS[0], min(PIVOTS[1], math.isqrt(rows) // 8))


def _nearest(length: int, to_pivots: np.ndarray) -> Iterator[pd.DataFrame]:
    """Of a group: which queries each pivot is the nearest of."""
    first = to_pivots.argmin(axis=1)
    for pivot in np.unique(first):
        places = np.flatnonzero(first == pivot)
        yield _demand(length, pivot, places, to_pivots[places, pivot], np.full(len(places), np.inf), np.ones(len(places), bool))


def _further(length: int, to_pivots: np.ndarray, reach: np.ndarray, spans: dict, largest: float) -> Iterator[pd.DataFrame]:
    """Of a group: which queries may still find a score at their bar around each pivot. reach: the squared distance that such a score has."""
    first = to_pivots.argmin(axis=1)
    for pivot in range(to_pivots.shape[1]):
        low, high = spans.get((length, pivot), (np.inf, -np.inf))
        d = to_pivots[:, pivot]
        places = np.flatnonzero(np.maximum(np.maximum(low - d, d - high), 0) <= _radius(d, reach, largest))
        if len(places) and low <= high:
            yield _demand(length, pivot, places, d[places], reach[places], first[places] == pivot)


def _demand(length: int, pivot: int, places: np.ndarray, distance: np.ndarray, reach: np.ndarray, first: np.ndarray) -> pd.DataFrame:
    columns = {"places": places.astype(np.int32), "distance": distance, "reach": reach, "first": first}
    return pd.DataFrame({"length": [length], "pivot": [int(pivot)], **{k: [v.tobytes()] for k, v in columns.items()}})


_DEMAND = "group long, length int, pivot int, places binary, distance binary, reach binary, first binary"


def _radius(distance: np.ndarray, reach: np.ndarray, largest: float) -> np.ndarray:
    """How far around a query a score at its bar can lie, with room for what rounding does to distances; below 0: nowhere."""
    with np.errstate(invalid="ignore"):
        room = reach + 1e-7 * (np.where(np.isfinite(reach), np.abs(reach), 0) + distance * distance + largest) + 1e-9
    return np.where(room < 0, -1.0, np.sqrt(np.maximum(room, 0)))


def _reads(distance: np.ndarray, rings: list, reach: np.ndarray | None, first: np.ndarray | None, largest: float = 0.0) -> dict[int, np.ndarray]:
    """Which queries read which annuli of a pivot. Without reach: the nearest one. With it: the run of those within reach; the nearest is left out where first says that it was read."""
    low, high = (np.array([r[k] for r in rings], np.float64) for k in ("low", "high"))
    above = np.minimum(np.searchsorted(high, distance), len(high) - 1)
    below = np.maximum(above - 1, 0)
    nearest = np.where(np.maximum(low[above] - distance, 0) <= np.maximum(distance - high[below], 0), above, below)
    queries, chosen = np.arange(len(distance)), nearest
    if reach is not None:
        radius = _radius(distance, reach, largest)
        start, end = np.searchsorted(high, distance - radius), np.searchsorted(low, distance + radius, "right")
        counts = np.where(radius < 0, 0, np.maximum(end - start, 0))
        queries, chosen = np.repeat(queries, counts), ranges(start, counts)
        kept = ~(first[queries] & (chosen == nearest[queries]))
        queries, chosen = queries[kept], chosen[kept]
    order = np.argsort(chosen, kind="stable")
    numbers, at = np.unique(chosen[order], return_index=True)
    return {rings[n]["block"]: q for n, q in zip(numbers.tolist(), np.split(queries[order], at[1:]), strict=True)} if len(numbers) else {}


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """vectors and queries: id and vector (array<long>). Returns query_id, rank (from 1), id and score. The index is written in the shared folder."""
    clean = lambda df: df.filter(F.col("id").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", F.isnull))
    vectors, queries = materialize(clean(vectors.select("id", "vector"))), clean(queries.select("id", "vector"))
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows, norms = vectors.agg(F.count("*"), F.max(norm)).first()
    largest, count = float(norms or 0.0), pivot_count(rows)
    chance = F.shiftrightunsigned(F.xxhash64("id", F.lit(17)), 11) / F.lit(float(2**53))
    drawn = vectors.filter(chance < F.lit(4.0 * count / max(rows, 1))).select("vector").limit(16 * count).collect()
    by_length: dict[int, list] = {}
    for row in drawn:
        by_length.setdefault(len(row[0]), []).append(np.array(row[0], np.int64))
    pivots = _Pivots([v for own in by_length.values() for v in own[:count]], largest)
    index = materialize(build_index(vectors, pivots))

    def group(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for places, x in _by_length(frame["vector"]):
                ids = frame["id"].to_numpy(np.int64)[places]
                d = pivots.distances(x, query=True)
                squares = (x.astype(np.float64) ** 2).sum(axis=1)
                for low in range(0, len(ids), GROUP_ROWS):
                    cut = slice(low, low + GROUP_ROWS)
                    yield pd.DataFrame({"length": [x.shape[1]], "query_ids": [ids[cut].tobytes()], "queries": [x[cut].tobytes()], "squares": [squares[cut].tobytes()], "to_pivots": [d[cut].tobytes()]})

    grouped = queries.coalesce(1 + queries.count() // (8 * GROUP_ROWS)).mapInPandas(group, "length int, query_ids binary, queries binary, squares binary, to_pivots binary")
    groups = materialize(grouped.withColumn("group", F.monotonically_increasing_id()))
    annuli = index.select("block", "length", "pivot", "low", "high")
    #: A pivot's annuli, in order; one row each for every pivot and length.
    rings = annuli.groupBy("length", "pivot").agg(F.array_sort(F.collect_list(F.struct("low", "high", "block"))).alias("rings"))
    spans = {(r[0], r[1]): (r[2], r[3]) for r in annuli.groupBy("length", "pivot").agg(F.min("low"), F.max("high")).collect()}  # one a pivot

    def nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                d = np.frombuffer(row.to_pivots, np.float64).reshape(len(row.query_ids) // 8, -1)
                yield from (part.assign(group=row.group) for part in _nearest(row.length, d))

    def further(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                own = np.frombuffer(row.query_ids, np.int64)
                d = np.frombuffer(row.to_pivots, np.float64).reshape(len(own), -1)
                bars = dict(zip([] if row.bar_ids is None else row.bar_ids, [] if row.bars is None else row.bars, strict=True))
                bar = np.array([bars.get(q, -np.inf) for q in own.tolist()], np.float64)
                reach = np.frombuffer(row.squares, np.float64) + largest - 2 * bar
                yield from (part.assign(group=row.group) for part in _further(row.length, d, reach, spans, largest))

    def read_of(all_within: bool):
        def reads(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for row in frame.itertuples():
                    places = np.frombuffer(row.places, np.int32)
                    own = [np.frombuffer(x, t) for x, t in ((row.distance, np.float64), (row.reach, np.float64), (row.first, bool))]
                    found = _reads(own[0], row.rings, own[1], own[2], largest) if all_within else _reads(own[0], row.rings, None, None)
                    for block, at in found.items():
                        yield pd.DataFrame({"block": [block], "group": [row.group], "places": [places[at].tobytes()]})

        return reads

    def scores_of(demands: DataFrame, all_within: bool) -> DataFrame:
        reads = demands.join(rings, ["length", "pivot"]).mapInPandas(read_of(all_within), "block long, group long, places binary")
        sent = reads.join(groups.select("group", "query_ids", "queries"), "group").join(index.select("block", "ids", "matrix"), "block")
        best = sent.select("ids", "matrix", "query_ids", "queries", "places").mapInPandas(lambda frames: (out for f in frames for out in _read(f, k)), "query_id long, id long, score long")
        return best

    seen = materialize(scores_of(groups.select("group", "length", "query_ids", "to_pivots").mapInPandas(nearest, _DEMAND), False))
    bars = _ranked(seen, k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("bar"))

    def members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                yield pd.DataFrame({"group": row.group, "query_id": np.unique(np.frombuffer(row.query_ids, np.int64))})

    of_group = groups.select("group", "query_ids").mapInPandas(members, "group long, query_id long").join(bars, "query_id").groupBy("group").agg(
        F.collect_list("query_id").alias("bar_ids"), F.collect_list("bar").alias("bars")
    )
    demands = groups.drop("queries").join(of_group, "group", "left").mapInPandas(further, _DEMAND)
    return _ranked(seen.unionByName(scores_of(demands, True)), k).select("query_id", "rank", "id", "score")
