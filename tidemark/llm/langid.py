"""Language ID (6): a linear-chain conditional random field over the words of a text.

Every word gets a score for each language from learned weights of its features: byte n-grams with its
bounds marked (its affixes are those that hold a mark) and, for words of the learned lexicon, the word
itself. Learned transitions join the words into a chain, and forward-backward gives each word's label
probabilities, so texts that switch language are labelled in parts. A document's language is the one with
the largest share of probability over its words; that share is its score.

The model is fitted in one task, on a bounded sample: at most max_docs labelled documents (or one of each
language, if those are more), drawn by a hash of their id and text, and at most max_words words of each. Training chains join stretches of several documents,
so that switches are seen. Prediction reads whole texts. Forward and backward passes run over all chains of
a slice at once: products of each block of words first, then the chain of blocks, then all blocks again.

Null text or no letters: "und", score 0. Nothing to learn from: "und" for all. Words are runs of letters
and other characters beyond ASCII. Empty table: no rows. Repeated rows are judged alike. Columns that the
input has besides are kept; those named as an output column are replaced.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lowered, ranges, release_memory, span_hashes, spans, text_slices

_BITS = 16
_GRAMS = (1, 2, 3, 4)
_GRAM_FACTORS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)
_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[0x80:] = True
_BLOCK = 64
#: Characters of a text that the sample keeps, for each of its words that training uses.
CHARS_A_WORD = 16
_RESULT = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])


def _fold(data: np.ndarray) -> np.ndarray:
    """A-Z and the Latin-1 capitals lowered."""
    data = lowered(data)
    if len(data) > 1:
        capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        data[capital] += 0x20
    return data


def text_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, starts, ends, and each document's first word."""
    data = _fold(data)
    starts, ends = spans(_LETTERS[data], offsets)
    return data, starts, ends, np.searchsorted(starts, offsets)


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all words end to end, and how many each word has."""
    lengths = ends - starts + 2
    at = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
    marked = np.full(int(lengths.sum()) + max(_GRAMS), 1, np.uint32)
    marked[ranges(at + 1, ends - starts)] = data[ranges(starts, ends - starts)]
    codes, owners = [], []
    owner = np.repeat(np.arange(len(starts)), lengths)
    room = np.repeat(at + lengths, lengths) - np.arange(len(owner))
    code = np.zeros(len(owner), np.uint32)
    for n, factor in zip(_GRAMS, _GRAM_FACTORS, strict=True):
        code = (code << np.uint32(8)) | marked[n - 1 : n - 1 + len(owner)]
        ok = room >= n
        codes.append((code[ok] * np.uint32(factor)) >> np.uint32(32 - _BITS))
        owners.append(owner[ok])
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return np.concatenate(codes)[order].astype(np.int64), np.bincount(owners, minlength=len(starts))


class ChainModel:
    """langs, weights of features and of lexicon words, transitions; scores are natural logarithms."""

    def __init__(self, langs: list[str], lexicon: np.ndarray):
        n = len(langs)
        self.langs, self.lexicon = langs, lexicon
        self.weights = np.zeros((1 << _BITS, n), np.float32)
        self.lexical = np.zeros((len(lexicon) + 1, n), np.float32)  # the last row is for words outside the lexicon
        self.transitions = np.zeros((n, n), np.float32)

    def lexicon_rows(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.lexicon, hashes)
        known = at < len(self.lexicon)
        known[known] = self.lexicon[at[known]] == hashes[known]
        return np.where(known, at, len(self.lexicon))

    def scores(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Each word's score for each language; equal words are scored once."""
        hashes = span_hashes(data, starts, ends)
        unique, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        features, counts = word_features(data, starts[first], ends[first])
        out = np.add.reduceat(self.weights[features], np.concatenate(([0], np.cumsum(counts)[:-1])), axis=0)
        return (out + self.lexical[self.lexicon_rows(unique)])[which]

    def posteriors(self, scores: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Label probabilities of each word by forward-backward over each chain [bounds[k], bounds[k + 1])."""
        n, labels = scores.shape
        if n == 0:
            return np.zeros((0, labels))
        lengths = np.diff(bounds)
        per_chain = -(-lengths // _BLOCK)
        chain = np.repeat(np.arange(len(lengths)), per_chain)
        turn = ranges(np.zeros(len(lengths), np.int64), per_chain)
        low = bounds[:-1][chain] + turn * _BLOCK
        place = low[:, None] + np.arange(_BLOCK)
        real = place < bounds[1:][chain][:, None]
        local = np.exp(scores.astype(np.float64) - scores.max(axis=1, keepdims=True))
        local = np.where(real[:, :, None], local[np.minimum(place, n - 1)], 1.0)
        step = np.exp(self.transitions.astype(np.float64) - self.transitions.max())
        stay = np.eye(labels)

        def move(t: int) -> np.ndarray:
            return np.where(real[:, t, None, None], step[None] * local[:, t, None, :], stay[None])

        whole = np.broadcast_to(stay, (len(low), labels, labels)).copy()
        for t in range(_BLOCK):
            whole = whole @ move(t)
            whole /= whole.max(axis=(1, 2), keepdims=True)
        rows_at = [np.flatnonzero(turn == k) for k in range(int(per_chain.max()))]
        forward = np.ones((len(low), labels)) / labels
        for k in range(1, len(rows_at)):
            into = rows_at[k]
            v = np.einsum("ij,ijk->ik", forward[into - 1], whole[into - 1])
            forward[into] = v / v.sum(axis=1, keepdims=True)
        backward = np.ones((len(low), labels)) / labels
        for k in range(len(rows_at) - 2, -1, -1):
            into = rows_at[k][per_chain[chain[rows_at[k]]] > k + 1]
            v = np.einsum("ijk,ik->ij", whole[into + 1], backward[into + 1])
            backward[into] = v / v.sum(axis=1, keepdims=True)
        alphas = np.empty((_BLOCK, len(low), labels))
        for t in range(_BLOCK):
            forward = np.einsum("ij,ijk->ik", forward, move(t))
            forward /= forward.sum(axis=1, keepdims=True)
            alphas[t] = forward
        out = np.empty((n, labels))
        for t in range(_BLOCK - 1, -1, -1):
            both = alphas[t] * backward
            out[place[real[:, t], t]] = (both / both.sum(axis=1, keepdims=True))[real[:, t]]
            backward = np.einsum("ijk,ik->ij", move(t), backward)
            backward /= backward.sum(axis=1, keepdims=True)
        return out


def _training_words(texts: list[tuple[str, str]], langs: list[str], max_words: int, random: np.random.Generator):
    """All sampled words end to end, as hashes and features, and stretches (first, end, label) of documents."""
    column = pa.array([t for _, t in texts], pa.large_string())
    hashes, features, counts, stretches, base = [], [], [], [], 0
    for low, high, data, offsets in text_slices(column):
        data, starts, ends, bounds = text_words(data, offsets)
        all_hashes = span_hashes(data, starts, ends)
        for k in range(high - low):
            n = int(bounds[k + 1] - bounds[k])
            if not n:
                continue
            take = min(n, max_words)
            first = int(bounds[k]) + int(random.integers(0, n - take + 1))
            own = slice(first, first + take)
            hashes.append(all_hashes[own])
            f, c = word_features(data, starts[own], ends[own])
            features.append(f.astype(np.int32))
            counts.append(c)
            stretches.append((base, base + take, langs.index(texts[low + k][0])))
            base += take
    empty = [np.zeros(0, np.int64)]
    return np.concatenate(hashes or [np.zeros(0, np.uint64)]), np.concatenate(features or empty), np.concatenate(counts or empty), stretches


def train(texts: list[tuple[str, str]], max_words: int = 120, chain: int = 48, batch: int = 64, epochs: int = 4, rate: float = 0.3, seed: int = 3) -> ChainModel:
    """A model fitted to (lang, text) pairs by gradient steps on the chains' likelihood."""
    random = np.random.default_rng(seed)
    texts = sorted((lang, text) for lang, text in texts if lang is not None and text is not None)
    langs = sorted({lang for lang, _ in texts})
    hashes, features, counts, stretches = _training_words(texts, langs, max_words, random)
    unique, times = np.unique(hashes, return_counts=True)
    model, n = ChainModel(langs, unique[times > 2]), len(langs)
    if not len(hashes) or n < 2:
        return model
    at, lexical = np.concatenate(([0], np.cumsum(counts)[:-1])), model.lexicon_rows(hashes)
    sums = [np.full(x.shape, 1e-2, np.float32) for x in (model.weights, model.lexical, model.transitions)]
    for _ in range(epochs):
        pieces = []  # stretches cut at random, so that a chain holds one to several
        for k in random.permutation(len(stretches)):
            low, end, label = stretches[k]
            while low < end:
                step = min(end - low, int(random.integers(4, chain)))
                pieces.append((low, step, label))
                low += step
        random.shuffle(pieces)
        rows, labels = np.concatenate([np.arange(a, a + s) for a, s, _ in pieces]), np.concatenate([np.full(s, label) for _, s, label in pieces])
        for low in range(0, len(rows), chain * batch):
            row, label = rows[low : low + chain * batch], labels[low : low + chain * batch]
            bounds = np.append(np.arange(0, len(row), chain), len(row))
            feature = features[ranges(at[row], counts[row])]
            owner = np.repeat(np.arange(len(row)), counts[row])
            scores = np.add.reduceat(model.weights[feature], np.concatenate(([0], np.cumsum(counts[row])[:-1])), axis=0) + model.lexical[lexical[row]]
            wrong, pairs = _gradient(model, scores, label, bounds)
            for held, total, slope in (
                (model.weights, sums[0], np.stack([np.bincount(feature, wrong[owner, k], 1 << _BITS) for k in range(n)], 1)),
                (model.lexical, sums[1], np.stack([np.bincount(lexical[row], wrong[:, k], len(model.lexical)) for k in range(n)], 1)),
                (model.transitions, sums[2], pairs),
            ):
                slope = (slope / len(bounds)).astype(np.float32)
                total += slope * slope
                held -= np.float32(rate) * slope / np.sqrt(total)
        model.lexical[-1] = 0
    return model


def _gradient(model: ChainModel, scores: np.ndarray, label: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected less observed labels of each word, and pairs of neighbouring labels."""
    n = scores.shape[1]
    inner = np.ones(len(label), bool)
    inner[bounds[:-1]] = False
    step = np.exp(model.transitions.astype(np.float64) - model.transitions.max())
    local = np.exp(scores.astype(np.float64) - scores.max(axis=1, keepdims=True))
    lengths, most = np.diff(bounds), int(np.diff(bounds).max())
    place = np.minimum(bounds[:-1, None] + np.arange(most), bounds[1:, None] - 1)
    real = np.arange(most) < lengths[:, None]
    alpha, beta = np.empty((most, len(lengths), n)), np.ones((most, len(lengths), n))
    alpha[0] = local[place[:, 0]] / local[place[:, 0]].sum(axis=1, keepdims=True)
    for t in range(1, most):
        v = (alpha[t - 1] @ step) * local[place[:, t]]
        alpha[t] = np.where(real[:, t, None], v / v.sum(axis=1, keepdims=True), alpha[t - 1])
    pairs = np.zeros((n, n))
    for t in range(most - 2, -1, -1):
        out = local[place[:, t + 1]] * beta[t + 1]
        v = out @ step.T
        both = alpha[t][:, :, None] * step[None] * out[:, None, :]
        both /= both.sum(axis=(1, 2), keepdims=True)
        pairs += both[real[:, t + 1]].sum(axis=0)
        beta[t] = np.where(real[:, t + 1, None], v / v.sum(axis=1, keepdims=True), 1.0)
    wrong = np.zeros((len(label), n))
    for t in range(most):
        v = alpha[t] * beta[t]
        wrong[place[real[:, t], t]] = (v / v.sum(axis=1, keepdims=True))[real[:, t]]
    wrong[np.arange(len(label)), label] -= 1
    np.subtract.at(pairs, (label[:-1][inner[1:]], label[1:][inner[1:]]), 1)
    return wrong, pairs


def sample(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = 3000, max_words: int = 120, seed: int = 3) -> DataFrame:
    """lang and text of a bounded sample of the labelled rows: of each language equally many, or all where it has fewer; never none.

    Of a text longer than CHARS_A_WORD * max_words characters, the sample holds a stretch of that length, from a place drawn by hash.
    """
    text, width = F.col(text_col).cast("string"), CHARS_A_WORD * max_words
    draw = F.xxhash64(id_col, text_col, F.lit(seed))
    named = F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()
    rows = labelled.filter(named).select(F.col(lang_col).cast("string").alias("lang"), text.alias("text"), draw.alias("draw"))
    counts = {r["lang"]: r["n"] for r in rows.select("lang", "draw").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()}
    shares = shares_of(counts, max_docs)
    # a draw that almost surely holds a language's share, before the ranks are exact
    below = [x for lang, n in shares.items() for x in (F.lit(lang), F.lit(int(min(1.0, (n + 8 * n**0.5 + 16) / counts[lang]) * 2**53)))]
    wanted = [x for lang, n in shares.items() for x in (F.lit(lang), F.lit(n))]
    of_lang = lambda pairs: F.try_element_at(F.create_map(*pairs), "lang") if pairs else F.lit(None)
    first = F.pmod(F.xxhash64("draw", F.lit(seed)), F.greatest(F.length("text") - width, F.lit(0)) + 1).cast("int")
    chosen = rows.filter(F.shiftrightunsigned("draw", 11) < of_lang(below))
    drawn = chosen.select("lang", "draw", of_lang(wanted).alias("wanted"), (F.length("text") > width).alias("cut"), F.col("text").substr(first + 1, F.lit(width)).alias("text"))
    ranked = drawn.dropDuplicates(["lang", "draw"]).withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("draw"))).filter("place <= wanted")
    whole_words = F.when(F.col("cut"), F.regexp_replace("text", r"^\S*\s|\s\S*$", "")).otherwise(F.col("text"))
    return ranked.select("lang", whole_words.alias("text"))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = 3000, max_words: int = 120, seed: int = 3) -> ChainModel:
    """A model of the sample, trained in one task, as the sample is bounded; the driver gets the model alone (some MB)."""

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [pair for batch in batches for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        model = pickle.dumps(train(texts, max_words=max_words, seed=seed))
        release_memory()
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    found = sample(labelled, id_col, text_col, lang_col, max_docs, max_words, seed).repartition(1).mapInArrow(trained, "model binary").collect()
    return pickle.loads(found[0][0]) if found else ChainModel([], np.zeros(0, np.uint64))


def shares_of(counts: dict[str, int], total: int) -> dict[str, int]:
    """total split over languages as evenly as their counts allow, 1 at least for each."""
    out: dict[str, int] = {}
    for k, lang in enumerate(sorted(counts, key=lambda x: (counts[x], x))):
        out[lang] = min(counts[lang], max(1, (total - sum(out.values())) // (len(counts) - k)))
    return out


def identify_texts(model: ChainModel, column: pa.Array, slice_bytes: int = 1 << 19) -> pa.Array:
    langs, shares = [], []
    for low, high, data, offsets in text_slices(column, slice_bytes):
        folded, starts, ends, bounds = text_words(data, offsets)
        n = high - low
        if not model.langs or not len(starts):
            langs += ["und"] * n
            shares += [0.0] * n
            continue
        sums = np.concatenate((np.zeros((1, len(model.langs))), np.cumsum(model.posteriors(model.scores(folded, starts, ends), bounds), axis=0)))
        lengths = np.diff(bounds)
        share = (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(lengths, 1)[:, None]
        best = share.argmax(axis=1)
        plain = np.concatenate(([0], np.cumsum(_LETTERS[data] & (data < 0x80))))
        ascii_letters = plain[offsets[1:]] > plain[offsets[:-1]]
        for k in range(n):
            lettered = lengths[k] > 0 and (ascii_letters[k] or any(c.isalpha() for c in data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "ignore")))
            langs.append(model.langs[best[k]] if lettered else "und")
            shares.append(float(np.clip(share[k, best[k]], 0, 1)) if lettered else 0.0)
    return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(shares, pa.float64())], fields=list(_RESULT))


def identify(docs: DataFrame, model: ChainModel, text_col: str = "text") -> DataFrame:
    """The documents with lang_pred and score. The model (some MB, whatever the corpus) goes to the executors once."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield identify_texts(shared.value, column)
            release_memory()

    found = F.arrow_udf(predict, "lang_pred string, score double")
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    whole = F.struct(F.lit(0).alias("_"), *kept).alias("input")
    judged = docs.select(whole, found(F.col(text_col).cast("string")).alias("found"))
    return judged.select(*[F.col("input")[c].alias(c) for c in kept], "found.lang_pred", "found.score")
