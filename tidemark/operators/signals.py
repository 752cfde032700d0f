"""Signal columns and jobs: levels of sample arrays, pitch consensus, spectral flux, pooled vectors, encoders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import sessionize

#: Fixed values of pitch consensus.
PITCH_TOLERANCE, OCTAVE_SLACK, TIE_AGREEMENT = 0.12, 0.12, 0.8


def block_levels(samples: Column | str, clip_at: float = 0.98) -> dict[str, Column]:
    """rms, dc_offset and clipped_fraction of an array of samples; null for an empty one."""
    s = F.transform(S.col(samples), lambda v: v.cast("double"))
    n = F.size(s)
    total = lambda f: F.aggregate(s, F.lit(0.0), lambda a, v: a + f(v))
    over = F.size(F.filter(s, lambda v: F.abs(v) >= clip_at))
    given = n > 0
    return {"rms": F.when(given, F.sqrt(total(lambda v: v * v) / n)), "dc_offset": F.when(given, total(lambda v: v) / n), "clipped_fraction": F.when(given, over / n)}


def periodic(f0: Column | str, confidence: Column | str, agreement: Column | str, least_confidence: float = 0.55, least_agreement: float = 0.7) -> Column:
    return F.coalesce(S.col(f0).isNotNull() & (S.col(confidence) >= least_confidence) & (S.col(agreement) >= least_agreement), F.lit(False))


def pitch_consensus(first: Column, first_confidence: Column, second: Column, second_confidence: Column, tie: Column, tie_confidence: Column) -> Column:
    """struct(hz, confidence, agreement) of two estimates; a third decides between octaves."""
    top, low = F.greatest(first, second), F.least(first, second)
    known = first.isNotNull() & second.isNotNull()
    apart, octave = (top - low) / top, F.abs(top / low - 2) <= OCTAVE_SLACK
    near = lambda x: F.coalesce(F.abs(x - tie) / F.greatest(x, tie) <= PITCH_TOLERANCE, F.lit(False)) & tie.isNotNull()
    decided = known & octave & (near(first) != near(second))
    chosen, chosen_confidence = F.when(near(first), first).otherwise(second), F.when(near(first), first_confidence).otherwise(second_confidence)
    both = F.least(first_confidence, second_confidence)
    row = lambda hz, confidence, agreement: F.struct(hz.cast("double").alias("hz"), confidence.cast("double").alias("confidence"), agreement.cast("double").alias("agreement"))
    none = F.lit(None)
    return (
        F.when(~known, row(none, both, F.lit(0.0)))
        .when(decided, row((chosen + tie) / 2, F.least(chosen_confidence, tie_confidence), F.lit(TIE_AGREEMENT)))
        .when((apart > PITCH_TOLERANCE) | octave, row(none, both, F.greatest(F.lit(0.0), 1 - apart)))
        .otherwise(row((first + second) / 2, both, F.greatest(F.lit(0.0), 1 - apart / 0.3)))
    )


def spectral_flux(df: DataFrame, keys: list[str], order: list[str], bands: str, name: str = "spectral_flux") -> DataFrame:
    """Root mean square of the rises of log1p band energy since the row before; 0 for the first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("bands_before", F.lag(bands).over(w))
    rises = F.zip_with(bands, "bands_before", lambda a, b: F.pow(F.greatest(F.log1p(a.cast("double")) - F.log1p(F.coalesce(b.cast("double"), F.lit(0.0))), F.lit(0.0)), 2))
    return marked.withColumn(name, F.when(F.col("bands_before").isNull(), 0.0).otherwise(F.sqrt(F.aggregate(rises, F.lit(0.0), lambda s, v: s + v) / F.size(bands)))).drop("bands_before")


def rolling_cadence(df: DataFrame, keys: list[str], order: list[str], at_ms: str, kind: str, span_ms: int = 2_000) -> DataFrame:
    """Frame events (kind presented, skipped or processed) with what the last span_ms tell: cadence_hz of processed frames, drop_fraction, and latest_gap_ms and largest_gap_ms between processed ones so far."""
    at = F.round(F.col(at_ms)).cast("long")
    recent = Window.partitionBy(*keys).orderBy(at).rangeBetween(-span_ms, 0)
    so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    is_kind = lambda k: F.col(kind) == k
    count = lambda k: F.sum(is_kind(k).cast("long")).over(recent)
    times = F.when(is_kind("processed"), F.col(at_ms))
    n, span = count("processed"), F.max(times).over(recent) - F.min(times).over(recent)
    before = F.last(times, ignorenulls=True).over(so_far.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("frame_gap", F.when(is_kind("processed"), F.col(at_ms) - before))
    return marked.withColumns({
        "cadence_hz": F.when(n < 2, 0.0).otherwise((n - 1) * 1000 / F.greatest(span, F.lit(1.0))), "drop_fraction": F.coalesce(F.try_divide(count("skipped"), count("presented")), F.lit(0.0)),
        "latest_gap_ms": F.last("frame_gap", ignorenulls=True).over(so_far), "largest_gap_ms": F.max("frame_gap").over(so_far),
    }).drop("frame_gap")


def speech_active(rms: Column | str, is_periodic: Column, flux: Column | str, noise_floor: Column | str) -> Column:
    """A level well above the noise floor that is periodic, or that changes and stands out still more."""
    rms, flux, floor = S.col(rms), S.col(flux), S.col(noise_floor)
    return F.coalesce((rms >= F.greatest(F.lit(0.003), floor * 2.8)) & (is_periodic | ((flux > 0.02) & (rms >= floor * 4))), F.lit(False))


def nucleus_score(rms: Column | str, flux: Column | str) -> Column:
    """The level, raised by up to three times where the spectrum changes."""
    return S.col(rms) * (1 + F.least(F.lit(2.0), S.col(flux) * 20))


def pooled(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """dimension, mean_value and sd_value (population) of each group's vectors; a vector with a value that is not finite is left out whole."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(S.INFINITY)))
    long = df.filter(sound).select(*keys, F.posexplode(vector).alias("dimension", "x"))
    return long.groupBy(*keys, "dimension").agg(F.avg(F.col("x").cast("double")).alias("mean_value"), F.stddev_pop(F.col("x").cast("double")).alias("sd_value"), F.count("*").alias("n"))


#: Fixed value: so many of the latest latencies count.
LATENCIES = 500


def stream_diagnostics(df: DataFrame, keys: list[str], order: list[str], sequence: str, index: str, length: str, at_ms: str, rate: str, latency_ms: str) -> DataFrame:
    """received, lost, lost_fraction, max_gap_ms, regressions (blocks refused, and accepted ones that are earlier than the one before) and p95_latency_ms (of the latest accepted blocks) of each stream."""
    told = sessionize.block_continuity(df, keys, order, sequence, index, length, at_ms, rate)
    taken = F.col("accepted")
    latest = Window.partitionBy(*keys, "accepted").orderBy(*[F.col(c).desc() for c in order])
    marked = told.withColumn("late_ms", F.when(taken & (F.row_number().over(latest) <= LATENCIES), F.col(latency_ms)))
    out = marked.groupBy(*keys).agg(
        F.sum(taken.cast("long")).alias("received"), F.sum("lost_before").alias("lost"), F.max("gap_ms").alias("max_gap_ms"), F.sum((~taken | F.col("time_back")).cast("long")).alias("regressions"),
        F.array_sort(F.collect_list("late_ms")).alias("latencies"),
    )
    n = F.size("latencies")
    place = F.least(n - 1, F.floor(n * 0.95)).cast("int")
    p95 = F.when(n == 0, F.lit(0.0)).otherwise(F.get("latencies", F.greatest(place, F.lit(0))).cast("double"))
    return out.withColumn("p95_latency_ms", p95).withColumn("lost_fraction", F.col("lost") / F.greatest(F.lit(1), F.col("received") + F.col("lost"))).drop("latencies")


def encoded(df: DataFrame, samples: str, load: Callable[[], Callable[[list[np.ndarray]], list[np.ndarray]]], name: str = "vector") -> DataFrame:
    """With vectors of a pluggable encoder: `load` runs once a worker task and gives a function of a batch of windows' samples. A null window has a null vector."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            given = batch.dropna()
            found = pd.Series([np.asarray(v, np.float32) for v in model([np.asarray(x, np.float64) for x in given])], index=given.index, dtype=object)
            yield found.reindex(batch.index).where(batch.notna(), None)

    return df.withColumn(name, encode(samples))


def band_encoder(bands: int = 8) -> Callable[[], Callable[[list[np.ndarray]], list[np.ndarray]]]:
    """An encoder of spectra: the log1p of a window's mean power in equal bands of its frequencies, 0 in a band without any; windows of one length at once."""

    def encode(windows: list[np.ndarray]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(bands)] * len(windows)
        lengths = np.array([len(x) for x in windows])
        for n in np.unique(lengths[lengths > 0]):
            places = np.flatnonzero(lengths == n)
            power = np.abs(np.fft.rfft(np.stack([windows[k] for k in places]), axis=1)) ** 2 / n
            parts = np.array_split(power, bands, axis=1)
            found = np.log1p(np.stack([p.mean(axis=1) if p.shape[1] else np.zeros(len(places)) for p in parts], axis=1))
            for row, k in enumerate(places):
                out[k] = found[row]
        return out

    return lambda: encode


def _first_peaks(score: np.ndarray, enough: np.ndarray) -> np.ndarray:
    """Of each row: the first local maximum of at least `enough`, else the overall one."""
    edge = np.full((len(score), 1), -np.inf)
    padded = np.hstack([edge, score, edge])
    peak = (score >= enough[:, None]) & (score >= padded[:, :-2]) & (score >= padded[:, 2:])
    return np.where(peak.any(axis=1), peak.argmax(axis=1), score.argmax(axis=1))


def _crossings(x: np.ndarray, rate: float) -> tuple[float | None, float]:
    """(hz, steadiness) of one block's upward zero crossings."""
    up = np.flatnonzero((x[:-1] <= 0) & (x[1:] > 0))
    periods = np.diff(up - x[up] / (x[up + 1] - x[up])) if len(up) > 1 else np.zeros(0)
    periods = periods[periods > 0]
    if not len(periods):
        return None, 0.0
    hz, steady = float(rate / np.sort(periods)[len(periods) // 2]), float(max(0.0, 1 - periods.std() / max(1, periods.mean())))
    return (hz, steady) if 48 <= hz <= 720 and steady >= 0.6 else (None, steady)


def block_estimates(x: np.ndarray, rate: float, low_hz: float = 50, high_hz: float = 700) -> list[tuple]:
    """pitch_estimates() of equally long blocks, one a row of x: each lag is computed for all of them at once."""
    n = x.shape[1]
    lags = np.arange(max(1, int(rate // high_hz)), min(n - 2, int(np.ceil(rate / low_hz))) + 1)
    if len(lags) == 0:
        return [(None, 0.0, None, 0.0, None, 0.0)] * len(x)
    energy = np.concatenate([np.zeros((len(x), 1)), np.cumsum(x * x, axis=1)], axis=1)
    alike, differ = np.empty((len(x), len(lags))), np.empty((len(x), len(lags)))
    for j, k in enumerate(lags):
        ahead, behind = x[:, : n - k], x[:, k:]
        norm = np.sqrt(energy[:, n - k] * (energy[:, -1] - energy[:, k]))
        alike[:, j] = np.einsum("ij,ij->i", ahead, behind) / np.maximum(1e-12, norm)
        differ[:, j] = np.abs(ahead - behind).mean(axis=1)
    rows, usual = np.arange(len(x)), differ.mean(axis=1)
    first, second = _first_peaks(alike, alike.max(axis=1) * 0.92), _first_peaks(-differ, -(differ.min(axis=1) + usual * 0.08))
    best = alike[rows, first]
    sure = np.where(usual <= 1e-9, 0.0, np.maximum(0.0, 1 - differ[rows, second] / np.maximum(usual, 1e-300)))
    out = []
    for k in range(len(x)):
        auto = (rate / lags[first[k]], float(np.clip(best[k], 0, 1))) if best[k] >= 0.35 else (None, float(max(0.0, best[k])))
        mean_difference = (rate / lags[second[k]], float(sure[k])) if sure[k] >= 0.2 else (None, float(sure[k]))
        out.append((*auto, *mean_difference, *_crossings(x[k], rate)))
    return out


def pitch_estimates(samples: np.ndarray, rate: float, low_hz: float = 50, high_hz: float = 700) -> tuple[float | None, float, float | None, float, float | None, float]:
    """(hz, confidence) of autocorrelation, of mean absolute difference and of zero crossings."""
    return block_estimates(np.asarray(samples, np.float64)[None, :], rate, low_hz, high_hz)[0]


#: Blocks whose estimates are computed together.
_BLOCKS_ONCE = 256


def with_pitch(blocks: DataFrame, samples: str, rate: str) -> DataFrame:
    """Blocks with pitch: struct(hz, confidence, agreement) by consensus of the three estimators."""

    @F.pandas_udf("a double, ac double, d double, dc double, z double, zc double")
    def estimate(x: pd.Series, r: pd.Series) -> pd.DataFrame:
        found = np.full((len(x), 6), np.nan)
        kinds = pd.DataFrame({"n": x.map(len), "rate": r})
        for (_, own_rate), places in kinds.groupby(["n", "rate"]).indices.items():
            for low in range(0, len(places), _BLOCKS_ONCE):
                some = places[low : low + _BLOCKS_ONCE]
                found[some] = np.array(block_estimates(np.array(x.iloc[some].tolist(), np.float64), own_rate), np.float64)
        return pd.DataFrame(found, columns=["a", "ac", "d", "dc", "z", "zc"])

    e = F.col("estimates")
    clean = lambda c: F.when(~F.isnan(e[c]), e[c])
    return blocks.withColumn("estimates", estimate(samples, rate)).withColumn("pitch", pitch_consensus(clean("a"), e["ac"], clean("d"), e["dc"], clean("z"), e["zc"])).drop("estimates")
