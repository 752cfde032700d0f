"""SentencePiece encoding and decoding (13): a table of distinct chunks.

Where no piece of a model crosses a white space marker, a text's ids are those of its chunks, in order. A chunk
is a run of markers with what follows up to the next one; as long as no piece holds a line end, a run of line ends
begins a chunk too. The chunks of a batch are found with numpy and known by 128 bits; the sentencepiece library segments
each distinct one that the table does not hold yet, once, and the ids of all places are gathered from the table. Each
worker has a table of its own, which lasts over tasks and is emptied when it is full, so memory is bounded and nothing is
shuffled: a lost executor costs its tasks only.

Decoding is the library's own, in slices that begin at a marked piece, as bytes of characters outside of the
vocabulary never go on across one.

A null text is an empty one and has no ids; null ids decode to null, no ids to the empty text. Repeated rows are
rows of their own; a null id of a document is kept. Other columns are left out. A model that normalizes texts, lacks
bytes for unknown characters or has pieces that cross markers is refused. A chunk is segmented in one piece, so a
text without any space or line end is one chunk, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release_memory, text_slices
from .tokens import Encoder

#: Ids decoded together, at least; places of chunks looked up, and new chunks segmented, together.
SLICE_IDS, PLACES_ONCE, CHUNKS_ONCE = 1 << 18, 1 << 17, 4096
#: Chunks kept by a worker before its table is emptied.
MAX_CHUNKS = 500_000
_MARK = "▁"


class Pieces(Encoder):
    """The table of chunks of a model, and the model. encode() takes texts end to end, each that is not empty with a space before it."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(_MARK in p.lstrip(_MARK) for p in pieces):
            raise ValueError("a piece crosses a white space marker")
        if sum(map(self.model.is_byte, range(len(pieces)))) != 256:
            raise ValueError("unknown characters have no bytes")
        probe = " A\tﬁ  Å"
        if self.model.normalize(probe) != _MARK + probe.replace(" ", _MARK) or any("\n" in p for p in pieces):
            raise ValueError("the model changes texts or has pieces with line ends")
        self.marked = np.array([p.startswith(_MARK) for p in pieces])
        #: Before a chunk, a line end keeps the library's own first marker off it: both are ids of their own.
        self.before = self.model.encode("\n")
        self._empty()

    def segment(self, chunks: list[str]) -> list[list[int]]:
        return [ids[len(self.before) :] for ids in self.model.encode(["\n" + c for c in chunks], num_threads=1)]

    def _learn(self, low: np.ndarray, high: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        raw = memoryview(np.ascontiguousarray(data))
        texts = [str(raw[a:b], "utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        counts, ids = [], []
        for k in range(0, len(texts), CHUNKS_ONCE):
            found = self.segment(texts[k : k + CHUNKS_ONCE])
            counts.append(np.array([len(x) for x in found], np.int64))
            ids.append(np.array([i for x in found for i in x], np.uint32))
        self._add(low, high, np.concatenate(counts), np.concatenate(ids))

    def _pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.count + len(starts) > MAX_CHUNKS:
            self._empty()
        return super()._pieces(data, starts, ends)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and each text's number of ids."""
        starts = chunk_starts(data, offsets)
        if len(starts) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        ends = np.append(starts[1:], len(data))
        parts = [self._pieces(data, starts[k : k + PLACES_ONCE], ends[k : k + PLACES_ONCE]) for k in range(0, len(starts), PLACES_ONCE)]
        sums = np.concatenate([[0], *[n for _, n in parts]]).cumsum()
        return np.concatenate([ids for ids, _ in parts]), np.diff(sums[np.searchsorted(starts, offsets)])

    def decode(self, ids: np.ndarray) -> str:
        if len(ids) <= SLICE_IDS:
            return self.model.decode(ids.tolist())
        starts = np.flatnonzero(self.marked[ids])
        wanted = np.searchsorted(starts, np.arange(SLICE_IDS, len(ids), SLICE_IDS))
        cuts = [0, *np.unique(starts[wanted[wanted < len(starts)]]).tolist(), len(ids)]
        first, *rest = (ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b)
        return self.model.decode(first) + "".join(self.model.decode(self.before + part)[1:] for part in rest)


_models: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    """One a worker and file; its table lasts over tasks."""
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the chunks of texts that lie end to end; each text that is not empty begins with a space."""
    mark, line = data == 32, data == 10
    start = mark | line
    start[1:] &= ~((mark[1:] & mark[:-1]) | (line[1:] & line[:-1]))
    start[offsets[:-1][offsets[:-1] < len(data)]] = True
    return np.flatnonzero(start)


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", back: bool = False) -> DataFrame:
    """id_col and ids (array<int>) of whole texts, as the library's encode() gives them; with back also decoded, what its decode() makes of them."""
    text = F.translate(F.col(text_col), _MARK, " ")
    marked = F.when(F.length(text) > 0, F.concat(F.lit(" "), text)).otherwise(F.lit(""))
    kind = docs.schema[id_col].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces_of(model)
        for batch in batches:
            for low, high, data, offsets in text_slices(batch.column(1)):
                ids, counts = own.encode(data, offsets)
                ends = np.concatenate([[0], np.cumsum(counts)])
                columns = {id_col: batch.column(0).slice(low, high - low), "ids": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))}
                if back:
                    columns["decoded"] = pa.array([own.decode(ids[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
        release_memory()

    return docs.select(F.col(id_col).alias("id"), marked.alias("text")).mapInArrow(read, f"`{id_col}` {kind}, ids array<int>" + ", decoded string" * back)


def decoded(ids, model: str):
    """The text that the library's decode() gives for a column of ids."""

    @F.pandas_udf("string")
    def decode(lists: pd.Series) -> pd.Series:
        own = pieces_of(model)
        return lists.map(lambda x: None if x is None else own.decode(np.asarray(x, np.int64)))

    return decode(ids)
