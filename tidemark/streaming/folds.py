"""Detectors that go on where they stopped, for streaming.ordered: the same results as their batch forms, however the rows are cut.

State holds what a later row can still depend on, not the session: the rows of an event that is open (800 ms of a blink, ten
seconds of an expression, at most), the last event's end, the windows of a noise floor's evidence, the counters of a window.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pandas as pd

from ..operators import detect

#: Length of a window in ms, and rows that it takes.
WINDOW_MS, MAX_ROWS = 300_000, 60_000
_NONE = np.zeros(0, np.int64)


class Windows:
    """Windows of window_ms from their first row's start. The next starts where one ends; after a gap of a whole window it starts at the row, and nothing is filled in.

    Another source closes the window early. Columns at, value and source; rows beyond max_rows of a window have no room and are counted in rejected.
    """

    schema = "window_no long, start_ms double, end_ms double, rows long, rejected long, total double, ended_by string"
    names = [c.split()[0] for c in schema.split(", ")]

    def __init__(self, at: str = "at_ms", value: str = "value", source: str = "source", window_ms: float = WINDOW_MS, max_rows: int = MAX_ROWS):
        self.at, self.value, self.source, self.window_ms, self.max_rows = at, value, source, window_ms, max_rows

    def step(self, state: dict | None, rows: pd.DataFrame) -> tuple[dict, pd.DataFrame, np.ndarray]:
        at, value, source = rows[self.at].to_numpy(float), rows[self.value].to_numpy(float), rows[self.source].to_numpy(object)
        sums = np.concatenate([[0.0], np.cumsum(np.nan_to_num(value))])
        s = dict(state or {"no": 0, "start": float(at[0]), "n": 0, "rejected": 0, "total": 0.0, "source": source[0]})
        found, over, low = [], [_NONE], 0
        while low < len(at):
            other = np.flatnonzero(source[low:] != s["source"])
            change = low + int(other[0]) if len(other) else len(at)
            end = min(change, low + int(np.searchsorted(at[low:] - s["start"], self.window_ms)))
            taken = min(end - low, max(0, self.max_rows - s["n"]))
            over.append(np.arange(low + taken, end))
            s |= {"n": s["n"] + taken, "rejected": s["rejected"] + end - low - taken, "total": s["total"] + float(sums[low + taken] - sums[low])}
            if end > low:
                s["last"] = float(at[end - 1])
            if end < len(at):
                full = s["start"] + self.window_ms
                stop, why = (float(at[end]), "source-changed") if end == change else (full, "full")
                found.append((s["no"], s["start"], stop, s["n"], s["rejected"], s["total"], why))
                begin = float(at[end]) if why != "full" or at[end] - full >= self.window_ms else full
                s = {"no": s["no"] + 1, "start": begin, "n": 0, "rejected": 0, "total": 0.0, "source": source[end], "last": begin}
            low = end
        return s, pd.DataFrame(found, columns=self.names), np.concatenate(over)

    def last(self, state: dict) -> pd.DataFrame:
        s = state
        return pd.DataFrame([(s["no"], s["start"], s["last"], s["n"], s["rejected"], s["total"], "ended")], columns=self.names)


class ClockWindows(Windows):
    """Windows of window_ms that lie on the key's own clock and are numbered by it, wherever its first row is and however long it is silent.

    A window without rows is not told. Sources are not told apart.
    """

    def __init__(self, at: str = "at_ms", value: str = "value", window_ms: float = WINDOW_MS, max_rows: int = MAX_ROWS):
        super().__init__(at, value, window_ms=window_ms, max_rows=max_rows)

    def step(self, state: dict | None, rows: pd.DataFrame) -> tuple[dict, pd.DataFrame, np.ndarray]:
        at, value = rows[self.at].to_numpy(float), np.nan_to_num(rows[self.value].to_numpy(float))
        place = np.floor(at / self.window_ms)
        s, found, over = dict(state or {}), [], [_NONE]
        for low, high in pairwise([*np.flatnonzero(np.diff(place, prepend=np.nan)).tolist(), len(at)]):
            if s.get("no") != place[low]:
                if s:
                    found.append((s["no"], s["start"], s["start"] + self.window_ms, s["n"], s["rejected"], s["total"], "full"))
                s = {"no": int(place[low]), "start": float(place[low] * self.window_ms), "n": 0, "rejected": 0, "total": 0.0}
            taken = min(high - low, max(0, self.max_rows - s["n"]))
            over.append(np.arange(low + taken, high))
            s |= {"n": s["n"] + taken, "rejected": s["rejected"] + high - low - taken, "total": s["total"] + float(value[low : low + taken].sum()), "last": float(at[high - 1])}
        return s, pd.DataFrame(found, columns=self.names), np.concatenate(over)


class Blinks:
    """detect.blink_fold() of one eye. A closure that is open at the end is no blink."""

    schema = detect.BLINK_SCHEMA
    names = [c.split()[0] for c in schema.split(", ")]

    def step(self, state: dict | None, rows: pd.DataFrame) -> tuple[dict, pd.DataFrame, np.ndarray]:
        s = state or {"reference": float(rows["reference"].iloc[0]), "ended": None, "opened": None, "void": False, "before": None, "t": _NONE, "aperture": _NONE, "bin": _NONE}
        held = len(s["t"])
        t, aperture, bins = (np.concatenate([s[k], rows[c].to_numpy(float)]) for k, c in (("t", "t_ms"), ("aperture", "aperture"), ("bin", "bin")))
        if not s["reference"] > 0:
            return s, pd.DataFrame([], columns=self.names), _NONE
        found, carry = detect.blinks_from(t, aperture, bins, s["reference"], detect.Blinking(s["ended"], s["opened"], s["void"], s["before"], held > 0))
        low = carry.pending if carry.pending is not None else len(t)
        kept = {"t": t[low:], "aperture": aperture[low:], "bin": bins[low:]}
        return {"reference": s["reference"], "ended": carry.ended, "opened": carry.opened, "void": carry.void, "before": (float(t[-1]), float(bins[-1])), **kept}, found, _NONE

    def last(self, state: dict) -> pd.DataFrame:
        return pd.DataFrame([], columns=self.names)


class Expressions:
    """detect.expression_fold(); an event that is open at the end is over there."""

    schema = detect.EXPRESSION_SCHEMA
    _parts = ["t", "left", "right", "lid_left", "lid_right"]

    def step(self, state: dict | None, rows: pd.DataFrame) -> tuple[dict, pd.DataFrame, np.ndarray]:
        new = detect.expression_arrays(rows)
        parts = [np.concatenate([state[k], x]) for k, x in zip(self._parts, new, strict=True)] if state else list(new)
        spans, open_at = detect.expression_spans_from(parts[0], np.maximum(parts[1], parts[2]), False)
        low = len(parts[0]) if open_at is None else open_at
        return {k: x[low:] for k, x in zip(self._parts, parts, strict=True)}, detect.expression_events(*parts, spans), _NONE

    def last(self, state: dict) -> pd.DataFrame:
        parts = [state[k] for k in self._parts]
        return detect.expression_events(*parts, detect.expression_spans_from(parts[0], np.maximum(parts[1], parts[2]), True)[0])


class Noise:
    """detect.noise_fold(), by windows: evidence is the last ten loud windows in a row, the contrast that they gave, and the quiet windows since."""

    schema = detect.NOISE_SCHEMA
    names = [c.split()[0] for c in schema.split(", ")]

    @staticmethod
    def _fresh() -> dict:
        return {"window": None, "loud": _NONE, "contrast": None, "quiet": _NONE}

    def step(self, state: dict | None, rows: pd.DataFrame) -> tuple[dict, pd.DataFrame, np.ndarray]:
        f = detect.noise_arrays(rows)
        s = dict(state) if state else self._fresh() | {"t": None, "identity": None, "usable": False}
        before = (s.pop("t"), s.pop("identity"), s.pop("usable"))
        identity = rows["identity"].astype(str).to_numpy(object)
        step = np.diff(f.t, prepend=f.t[0] if before[0] is None else before[0])
        same = np.concatenate([[before[2] and identity[0] == before[1]], f.usable[:-1] & (identity[1:] == identity[:-1])])
        breaks = ~f.usable | ~same | (step <= 0) | (step > detect.NOISE_GAP_MS)
        found, low = [], 0
        for end in [*(np.flatnonzero(breaks[1:]) + 1), len(f.t)]:
            if breaks[low]:
                s = self._fresh()
            if f.usable[low]:
                s = self._run(s, f, low, int(end), found)
            low = int(end)
        s |= {"t": float(f.t[-1]), "identity": identity[-1], "usable": bool(f.usable[-1])}
        return s, pd.DataFrame(found, columns=self.names, dtype=float), _NONE

    def _run(self, s: dict, f: detect.NoiseFrames, low: int, high: int, found: list) -> dict:
        """Rows [low, high) of one run, from window to window."""
        while low < high:
            # the next window's row, and what the rows up to it say
            w = low if s["window"] is None else low + int(np.searchsorted(f.t[low:high] - s["window"] >= detect.NOISE_WINDOW_MS, True))
            upto = slice(low, min(w, high))
            if not f.loud[upto].all():
                s["loud"] = _NONE
            fits = self._fits(s["contrast"], f, upto)
            if not fits.all():
                s["quiet"] = _NONE
            if w >= high:
                return s
            s["window"] = float(f.t[w])
            if self._fits(s["contrast"], f, slice(w, w + 1))[0]:
                s["loud"] = _NONE
                s["quiet"] = np.concatenate([s["quiet"], [f.rms[w], f.cpp[w]]])
                floor = self._floor(s)
                if floor is not None:
                    found.append((float(f.t[w]), floor, float(detect.NOISE_QUIET_MS)))
                    s = self._fresh()
            else:
                s["quiet"] = _NONE
                s["loud"] = np.concatenate([s["loud"], [f.rms[w], f.cpp[w]]])[-2 * detect.NOISE_CONTRAST_WINDOWS :] if f.loud[w] else _NONE
                if len(s["loud"]) == 2 * detect.NOISE_CONTRAST_WINDOWS:
                    s["contrast"] = [float(f.t[w]), float(s["loud"][::2].min()), float(s["loud"][1::2].min())]
            low = w + 1
        return s

    @staticmethod
    def _fits(contrast: list | None, f: detect.NoiseFrames, rows: slice) -> np.ndarray:
        """Which rows are quiet beside a contrast that still holds."""
        if contrast is None:
            return np.zeros(rows.stop - rows.start, bool)
        at, level, prominence = contrast
        return (f.t[rows] - at <= detect.NOISE_AGE_MS) & f.quiet[rows] & (f.cpp[rows] < prominence) & (level >= detect.NOISE_RATIO * f.rms[rows])

    @staticmethod
    def _floor(s: dict) -> float | None:
        """The floor of a steady stretch that this window completes. A window that breaks the steadiness begins a new stretch."""
        need = detect.NOISE_QUIET_MS // detect.NOISE_WINDOW_MS
        s["quiet"] = s["quiet"][-2 * need :]
        rms, cpp = s["quiet"][::2], s["quiet"][1::2]
        if rms.max() / rms.min() > detect.NOISE_STEADY:
            s["quiet"] = s["quiet"][-2:]
        elif len(rms) == need and s["contrast"][2] - np.sort(cpp)[need // 2] >= detect.NOISE_DROP_DB:
            return float(np.sort(rms)[int((need - 1) * 0.75)])
        return None

    def last(self, state: dict) -> pd.DataFrame:
        return pd.DataFrame([], columns=self.names)
