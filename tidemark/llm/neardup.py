"""MinHash near-dedup (3): signature-coordinate inverted join, links confirmed on full shingle sets.

A document's set is its distinct word shingles; its signature the minimum of each of a fixed number of
hash functions over the set. Documents with equal sets are one class from the start. Each class is posted
under its (coordinate, value) pairs. Two classes that agree in at least `matches` of H coordinates share
one of the first H - matches + 1 pairs of each in any one order, so only that prefix is posted, rarest
pairs first, and the lists of the frequent pairs are skipped. Collisions of candidates are counted on the
signatures, pairs below `matches` fall away, and the rest are confirmed on the full sets.

A list can be as long as the largest group of copies, so pairs are not taken within lists. A shingle that
no other posted class has cannot be shared: c, the number of the others, bounds every overlap of a class,
and a class or pair that c rules out is left. Then every class is compared with the one class of a list
that has the largest share of shared shingles, of its lists that with which it agrees most; linked classes
form labels. Lists that still hold several labels are joined where they share a class; in each such
cluster, the members outside of its most frequent label are compared with all members of other labels, in
blocks of bounded size: a task takes one block of either and gives links, not pairs. Any link between two
labels has such a member and such a cluster, so no component is lost.

With 32 coordinates and 17 matches, a link at exactly 0.85 is missed with probability 3.5e-6; with 14 matches,
one at exactly 0.80 with 1.2e-6.

Null, empty or blank text: an empty set, linked with nothing. Fewer words than a shingle: the whole
sequence is the one shingle. Rows with null doc_id: linked with nothing, component_id null, kept. Rows that
repeat a doc_id are told apart by their text. Empty table: no rows. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chain_hashes, discard, key_hashes, lowered, materialize, mix, release_memory, span_keys, text_slices, words
from .components import connected_components

#: Shingles, and classes, in a block of a cluster's members, about.
BLOCK_SHINGLES, BLOCK_CLASSES = 1 << 16, 256
#: The general rule, where no contract sets another threshold: similarity of 0.8 or more.
GENERAL = {"percent": 80, "matches": 14}

_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("print_a", pa.int64()), ("print_b", pa.int64()), ("signature", pa.list_(pa.int32()))])
_SETS = pa.schema([("class_id", pa.int64()), ("shingles", pa.list_(pa.int64()))])


def _shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> list[tuple[np.ndarray, tuple[int, int]]]:
    """Each document's distinct shingle hashes, ascending, and 128 bits that equal sets share, whatever their order."""
    data = lowered(data)
    starts, ends, bounds = words(data, offsets)
    low, high = span_keys(data, starts, ends)
    sides = [(key_hashes(low, high), 0xA24BAED4963EE407), (key_hashes(high, low), 0x9FB21C651E98DF25)]
    chained = [chain_hashes(h, width, factor) for h, factor in sides]
    out = []
    for first, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        n = end - first
        both = [c[first : end - width + 1] for c in chained] if n >= width else [chain_hashes(h[first:end], max(n, 1), factor) for h, factor in sides]
        some, at = np.unique(both[0], return_index=True)
        out.append((some, tuple(int(mix(x).sum(dtype=np.uint64).view(np.int64)) for x in (some, both[1][at]))))
    return out


def _sign(batches: Iterator[pa.RecordBatch], width: int, coordinates: int, seed: int) -> Iterator[pa.RecordBatch]:
    random = np.random.default_rng(seed)
    factors = random.integers(1, 2**63, coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    terms = random.integers(0, 2**63, coordinates, dtype=np.uint64)
    for batch in batches:
        names = batch.column(0)
        for low, high, data, offsets in text_slices(batch.column(1)):
            found = _shingles(data, offsets, width)
            sets, prints = [s for s, _ in found], [p for _, p in found]
            full = [s for s in sets if len(s)]
            signatures = np.zeros((len(full), coordinates), np.int32)
            if full:
                flat, at = np.concatenate(full), np.concatenate(([0], np.cumsum([len(s) for s in full])[:-1]))
                for k in range(coordinates):
                    least = np.minimum.reduceat(flat * factors[k] + terms[k], at)
                    signatures[:, k] = (least >> np.uint64(32)).astype(np.uint32).view(np.int32)
            lengths = np.array([coordinates if len(s) else 0 for s in sets])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), pa.array(signatures.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [
                    names.slice(low, high - low), pa.array([len(s) for s in sets], pa.int64()), pa.array([p[0] for p in prints], pa.int64()),
                    pa.array([p[1] for p in prints], pa.int64()), lists
                ], schema=_SIGNED
            )
        release_memory()


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Of rows class_id, print_a, print_b, text: the sets of those that have that print."""
    for batch in batches:
        ids, a, b = (batch.column(k).to_pylist() for k in range(3))
        for low, _, data, offsets in text_slices(batch.column(3)):
            kept = [(ids[low + k], s.view(np.int64)) for k, (s, p) in enumerate(_shingles(data, offsets, width)) if p == (a[low + k], b[low + k])]
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in kept], pa.int64()), pa.array([s for _, s in kept], pa.list_(pa.int64()))], schema=_SETS)
        release_memory()


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 5, coordinates: int = 32, seed: int = 7) -> DataFrame:
    """doc_id, n_shingles, print_a, print_b (equal for equal sets) and signature (empty for an empty set)."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        lambda batches: _sign(batches, words_each, coordinates, seed), "doc_id long, n_shingles long, print_a long, print_b long, signature array<int>"
    )


def _prefix_postings(classes: DataFrame, coordinates: int, matches: int) -> DataFrame:
    """coordinate, value, class_id: each class under the rarest pairs of its signature that it may share."""
    posts = classes.select("class_id", F.posexplode("signature").alias("coordinate", "value"))
    shared = posts.groupBy("coordinate", "value").agg(F.count("*").alias("frequency")).filter("frequency > 1")
    ranked = posts.join(shared, ["coordinate", "value"]).groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct("frequency", "coordinate", "value"))).alias("pairs"))
    alone = F.lit(coordinates) - F.size("pairs")  # these are the rarest of all and have no list
    prefix = F.slice("pairs", F.lit(1), F.greatest(F.lit(coordinates - matches + 1) - alone, F.lit(0)))
    return ranked.select("class_id", F.explode(prefix).alias("pair")).select(F.col("pair.coordinate").alias("coordinate"), F.col("pair.value").alias("value"), "class_id")


def _may_link(a: str, b: str, percent: int):
    """Whether the bounds of the overlap, sizes n and shared shingles c, leave room for a link."""
    both = F.least(f"c_{a}", f"c_{b}", f"n_{a}", f"n_{b}")
    return both * (100 + percent) >= (F.col(f"n_{a}") + F.col(f"n_{b}")) * percent


def _agreement(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda x, y: x + y)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough."""
    left = sets.select(F.col("class_id").alias("b"), F.col("shingles").alias("shingles_b"))
    right = sets.select(F.col("class_id").alias("a"), F.col("shingles").alias("shingles_a"))
    both = F.size(F.array_intersect("shingles_a", "shingles_b"))
    return pairs.select("a", "b").join(left, "b").join(right, "a").filter(both * 100 >= (F.size("shingles_a") + F.size("shingles_b") - both) * percent).select("a", "b")


def _cluster_links(clusters: DataFrame, short: DataFrame, sets: DataFrame, percent: int, matches: int) -> DataFrame:
    """Links (a, b) between members (class_id, cluster, label) of one cluster and different labels."""
    counted = clusters.groupBy("cluster", "label").agg(F.count("*").alias("n"))
    main = counted.groupBy("cluster").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    full = materialize(clusters.join(main, "cluster").join(short, "class_id"))
    outside = F.col("label") != F.col("main")
    blocks = lambda size, rows: 1 + F.greatest(F.expr(f"{size} div {BLOCK_SHINGLES}"), F.expr(f"{rows} div {BLOCK_CLASSES}"))
    sizes = full.groupBy("cluster").agg(
        F.sum("n").alias("size"), F.count("*").alias("rows"), F.sum(F.when(outside, F.col("n")).otherwise(0)).alias("out_size"),
        F.sum(outside.cast("long")).alias("out_rows")
    )
    sizes = sizes.select("cluster", blocks("out_size", "out_rows").alias("ones"), blocks("size", "rows").alias("others"))
    whole = full.join(sizes, "cluster").join(sets, "class_id")
    place = lambda of: F.pmod(F.xxhash64("class_id", F.lit(of)), F.col(of))
    every = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))
    columns = ["cluster", "i", "j", "class_id", "label", "n", "c", "s", "shingles"]
    left = whole.filter(outside).withColumn("i", place("ones")).withColumn("j", every("others")).select(*[F.col(k).alias(k) for k in columns])
    right = whole.withColumn("j", place("others")).withColumn("i", every("ones")).select(*[F.col(k).alias(k) for k in columns])
    key = ["cluster", "i", "j"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(lambda one, other: _block_links(one, other, percent, matches), "a long, b long").distinct()


def _overlaps(one: list[np.ndarray], other: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of each set of one with each of other."""
    flat_one, flat_other = np.concatenate(one), np.concatenate(other)
    shared = np.intersect1d(flat_one, flat_other)
    out = np.zeros((len(one), len(other)), np.float32)
    sides = []
    for sets, flat in ((one, flat_one), (other, flat_other)):
        at = np.searchsorted(shared, flat)
        kept = (at < len(shared)) & (shared[np.minimum(at, max(len(shared) - 1, 0))] == flat) if len(shared) else np.zeros(len(flat), bool)
        rows, columns = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[kept], at[kept]
        order = np.argsort(columns, kind="stable")
        sides.append((len(sets), rows[order], columns[order]))
    for low in range(0, len(shared), width):
        dense = []
        for n, rows, columns in sides:
            cut = slice(*np.searchsorted(columns, [low, low + width]))
            m = np.zeros((n, width), np.float32)
            m[rows[cut], columns[cut] - low] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out.astype(np.int64)


def _block_links(one: pd.DataFrame, other: pd.DataFrame, percent: int, matches: int) -> pd.DataFrame:
    """Of two blocks of classes: one link for each class and each other label that it links to."""
    none = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    if not len(one) or not len(other):
        return none
    n, m, c, d = (x.to_numpy(np.int64) for x in (one["n"], other["n"], one["c"], other["c"]))
    labels = other["label"].to_numpy(np.int64)
    sizes = n[:, None] + m
    room = np.minimum(np.minimum(c[:, None], d), np.minimum(n[:, None], m)) * (100 + percent) >= sizes * percent
    agreed = sum((a[:, None] == b) for a, b in zip(np.array(one["s"].tolist(), np.int32).T, np.array(other["s"].tolist(), np.int32).T, strict=True))
    open_pairs = (one["label"].to_numpy(np.int64)[:, None] != labels) & room & (agreed >= matches)
    rows, columns = np.flatnonzero(open_pairs.any(axis=1)), np.flatnonzero(open_pairs.any(axis=0))
    if not len(rows):
        return none
    both = _overlaps([one["shingles"].iloc[k] for k in rows], [other["shingles"].iloc[k] for k in columns])
    linked = open_pairs[np.ix_(rows, columns)] & (both * 100 >= (sizes[np.ix_(rows, columns)] - both) * percent)
    x, y = np.nonzero(linked)
    found = pd.DataFrame({"a": one["class_id"].to_numpy(np.int64)[rows[x]], "b": other["class_id"].to_numpy(np.int64)[columns[y]], "label": labels[columns[y]]})
    return found.drop_duplicates(["a", "label"])[["a", "b"]]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, words_each: int = 5, coordinates: int = 32, matches: int = 17) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach) and kept (it is its own), one row per document."""
    signed = materialize(signatures(docs, id_col, text_col, words_each, coordinates))
    prints = ["n_shingles", "print_a", "print_b"]
    classes = materialize(
        signed.filter("n_shingles > 0 and doc_id is not null").groupBy(prints).agg(
            F.min("doc_id").alias("first_doc"), F.first("signature").alias("signature")
        ).withColumn("class_id", F.monotonically_increasing_id())
    )
    posts = materialize(_prefix_postings(classes, coordinates, matches))
    posted = posts.select("class_id").distinct().join(classes.select("class_id", "first_doc", "print_a", "print_b"), "class_id")
    texts = docs.select(F.col(id_col).cast("long").alias("first_doc"), F.col(text_col).alias("text"))
    sets = materialize(
        texts.join(posted, "first_doc").select("class_id", "print_a", "print_b", "text").mapInArrow(
            lambda batches: _sets(batches, words_each), "class_id long, shingles array<long>"
        ).dropDuplicates(["class_id"]),
        "none",
    )
    unshared = sets.select("class_id", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("owners"), F.min("class_id").alias("class_id")).filter("owners = 1")
    short = materialize(
        classes.join(unshared.groupBy("class_id").agg(F.count("*").alias("unshared")), "class_id", "left")
        .select("class_id", F.col("n_shingles").alias("n"), F.col("signature").alias("s"), (F.col("n_shingles") - F.coalesce("unshared", F.lit(0))).alias("c"))
        .filter(F.col("c") * 100 >= F.col("n") * percent)
    )
    lists = materialize(posts.join(short.select("class_id", (F.col("c") / F.col("n")).alias("part")), "class_id"))
    named = lambda side: short.select(*[F.col(c).alias(f"{c}_{side}" if c != "class_id" else side) for c in short.columns])
    candidates = (
        lists.join(lists.groupBy("coordinate", "value").agg(F.max_by("class_id", F.struct("part", "class_id")).alias("a")), ["coordinate", "value"])
        .filter("a <> class_id").select("a", F.col("class_id").alias("b")).distinct()
        .join(named("b"), "b").join(named("a"), "a")
        .filter(_may_link("a", "b", percent))
        .select("a", "b", _agreement("s_a", "s_b").alias("agreed"))
        .filter(F.col("agreed") >= matches)
    )
    first = materialize(candidates.groupBy("b").agg(F.min_by("a", F.struct(-F.col("agreed"), F.col("a"))).alias("a")))
    links = materialize(_confirmed(first, sets, percent))

    labelled = connected_components(links).withColumnRenamed("node", "class_id")
    members = materialize(lists.join(labelled, "class_id", "left").select("coordinate", "value", "class_id", F.coalesce("label", "class_id").alias("label")))
    several = members.groupBy("coordinate", "value").agg(F.min("class_id").alias("a"), F.min("label").alias("least"), F.max("label").alias("most")).filter("least < most")
    held = members.join(several.select("coordinate", "value", "a"), ["coordinate", "value"]).select("a", F.col("class_id").alias("b"), "label")
    clusters = connected_components(held.select("a", "b")).select(F.col("node").alias("class_id"), F.col("label").alias("cluster"))
    more = materialize(_cluster_links(clusters.join(held.select(F.col("b").alias("class_id"), "label").distinct(), "class_id"), short, sets, percent, matches))
    nodes = connected_components(links.union(more)).withColumnRenamed("node", "class_id")
    discard(posts, sets, short, lists, first, links, members, more)
    grouped = classes.select("class_id", "first_doc", *prints).join(nodes, "class_id", "left").withColumn("label", F.coalesce("label", "class_id"))
    firsts = grouped.groupBy("label").agg(F.min("first_doc").alias("component_id"))
    found = grouped.join(firsts, "label").select(*[F.col(c).alias(f"{c}_found") for c in prints], F.col("component_id").alias("found"))
    same = [F.col(c) == F.col(f"{c}_found") for c in prints]
    return (
        signed.join(found, [*same, F.col("doc_id").isNotNull()], "left")
        .withColumn("component_id", F.coalesce("found", "doc_id"))
        .select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    )
