"""Token ids of whole texts, by the tokenizers library.

A text's ids are the ids of its pieces, in order, wherever a cut is one that the tokenizer's own
pre-tokenizer makes too. Cuts are found with numpy, equal pieces are encoded once and kept in a
bounded table, and ids are gathered from that table. Only bytes whose neighbours leave no doubt
are cut at; anything else stays within one piece, which the library splits itself. The table knows a piece by
its bytes where there are at most 15, else by 120 bits of their BLAKE2b digest.

A null text is an empty one and has no ids. Equal texts have equal ids, in whatever batch they come.
"""

from __future__ import annotations

import os

import numpy as np

from .common import key_hashes, ranges, span_keys

#: Pieces kept by a worker before its table is emptied.
MAX_PIECES = 2_000_000
#: Pieces looked up together, so that a very long text needs no more memory than others beyond its own bytes and ids.
_PIECES_ONCE = 1 << 18
_GROUP, _BATCH = 256, 16
_SLOT_BITS = 22
_SLOT_MASK = np.uint64((1 << _SLOT_BITS) - 1)

# Neither white space of any kind nor a doubtful lead byte: printable ASCII, and the lead byte C3 (Latin letters).
_PLAIN = np.zeros(256, bool)
_PLAIN[33:127] = True
_AFTER = _PLAIN.copy()
_AFTER[0xC3] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:!?"]] = True


def cut_points(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pieces of all documents, ascending."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    previous = np.zeros(n, np.uint8)
    previous[1:] = data[:-1]
    before = np.zeros(n, np.uint8)
    before[2:] = data[:-2]
    following = np.zeros(n, np.uint8)
    following[:-1] = data[1:]
    latin = (before == 0xC3) & (previous >= 0x80) & (previous != 0x97) & (previous != 0xB7)
    letter = _LETTER[previous] | latin
    gap = (data == 32) | (data == 10)
    alone = gap & (_PLAIN[previous] | latin) & _AFTER[following]
    cut = alone | (_STOP[data] & letter)
    cut[1:] |= alone[:-1] & (previous[1:] == 10)
    cut[offsets[:-1][offsets[:-1] < n]] = True
    return np.flatnonzero(cut)


class Encoder:
    """encode() gives the ids of documents that lie end to end in one buffer, and each document's number of ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self._empty()

    def _empty(self) -> None:
        self.count = 0
        self.keys = np.zeros((2, 1 << 16), np.uint64)
        self.at = np.zeros(1 << 16, np.int64)
        self.lengths = np.zeros(1 << 16, np.int64)
        self.flat = np.zeros(1 << 18, np.uint32)
        self.used = 0
        self.slots = np.full(1 << _SLOT_BITS, -1, np.int32)

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The entry of each key, or -1. An entry counts only where its whole key is equal."""
        place = (key_hashes(low, high) & _SLOT_MASK).astype(np.int64)
        found = np.full(len(low), -1, np.int64)
        todo = np.arange(len(low))
        while len(todo):
            entry = self.slots[place]
            equal = (entry >= 0) & (self.keys[0, entry] == low[todo]) & (self.keys[1, entry] == high[todo])
            found[todo[equal]] = entry[equal]
            further = (entry >= 0) & ~equal
            todo, place = todo[further], (place[further] + 1) & int(_SLOT_MASK)
        return found

    def _add(self, low: np.ndarray, high: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """Enters keys that are not there yet, each once."""
        end, total = self.count + len(low), self.used + len(ids)
        if end > len(self.at):
            self.keys = np.concatenate([self.keys, np.zeros((2, 2 * end - len(self.at)), np.uint64)], axis=1)
            self.at, self.lengths = np.resize(self.at, 2 * end), np.resize(self.lengths, 2 * end)
        if total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * total)
        self.flat[self.used : total] = ids
        new = slice(self.count, end)
        self.keys[0, new], self.keys[1, new], self.lengths[new] = low, high, counts
        self.at[new] = self.used + np.concatenate(([0], np.cumsum(counts)[:-1]))
        entries, place = np.arange(self.count, end, dtype=np.int32), (key_hashes(low, high) & _SLOT_MASK).astype(np.int64)
        while len(entries):
            left = self.slots[place] < 0
            self.slots[place[left]] = entries[left]  # of several for one slot the last one stays
            further = self.slots[place] != entries
            entries, place = entries[further], (place[further] + 1) & int(_SLOT_MASK)
        self.count, self.used = end, total

    def _learn(self, low: np.ndarray, high: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        raw = memoryview(np.ascontiguousarray(data))
        texts = [str(raw[a:b], "utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        groups = [texts[k : k + _GROUP] for k in range(0, len(texts), _GROUP)]
        counts, ids = [], []
        for first in range(0, len(groups), _BATCH):  # the library's own records of a batch are many times its ids
            some = groups[first : first + _BATCH]
            for group, e in zip(some, self.tokenizer.encode_batch(some, is_pretokenized=True, add_special_tokens=False), strict=True):
                ids.append(np.array(e.ids, np.uint32))
                counts.append(np.bincount(np.array(e.word_ids, np.int64), minlength=len(group)))
        self._add(low, high, np.concatenate(counts), np.concatenate(ids))

    def _pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some pieces end to end, and each piece's number of ids."""
        if self.count + len(starts) > min(MAX_PIECES, (1 << _SLOT_BITS) * 3 // 4):
            self._empty()
        low, high = span_keys(data, starts, ends)
        entry = self._find(low, high)
        new = np.flatnonzero(entry < 0)
        if len(new):
            order = new[np.lexsort((high[new], low[new]))]
            one = order[np.append(True, (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]]))]
            self._learn(low[one], high[one], data, starts[one], ends[one])
            entry[new] = self._find(low[new], high[new])
        lengths = self.lengths[entry]
        return self.flat[ranges(self.at[entry], lengths)], lengths

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = cut_points(data, offsets)
        if len(starts) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        ends = np.append(starts[1:], len(data))
        once = min(_PIECES_ONCE, (1 << _SLOT_BITS) // 4)
        parts = [self._pieces(data, starts[k : k + once], ends[k : k + once]) for k in range(0, len(starts), once)]
        sums = np.concatenate([[0], *[n for _, n in parts]]).cumsum()
        return np.concatenate([ids for ids, _ in parts]), np.diff(sums[np.searchsorted(starts, offsets)])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One a worker and file; its table lasts over tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
