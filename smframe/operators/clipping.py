"""Clipping detectors over a DataFrame of traces, one Arrow pass, and the network that weighs them for a record.

Each detector looks at a trace without its quiet tail. Records are judged by a small feed-forward network whose
weights are given by the caller.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from smframe.operators.recurrence import one_pole
from smframe.operators.waveform import samples_of, steps_of

OUT = "clip_max boolean, n_ping int, clip_ping boolean, n_std int, clip_std boolean, n_jerk int, clip_jerk boolean, n_hist int, clip_hist boolean"


@dataclass(frozen=True)
class Limits:
    """The defaults of the published detectors."""

    max_amp: float = 6e6
    ping: float = 0.57
    std_n: int = 12
    std_floor: float = 0.001
    std_share: float = 0.85
    std_points: int = 5
    jerk_factor: float = 100.0
    jerk_points: int = 400
    bins: int = 6200
    least_width: int = 7
    search_bins: int = 700
    tail: float = 0.05
    most_peaks: int = 20000


def without_tail(x: np.ndarray, share: float) -> np.ndarray:
    """x up to the last gap in what stays below a share of the peak: the quiet tail goes."""
    quiet = np.flatnonzero(np.abs(x) < share * np.abs(x).max())
    ends = quiet[1:][np.diff(quiet) > 1]
    return x[: ends[-1]] if len(ends) else x


def jumps(x: np.ndarray, share: float) -> int:
    return int((np.abs(np.diff(x)) > share * (abs(x.max()) - x.min())).sum())


def steady(x: np.ndarray, n: int, floor: float, share: float) -> int:
    """Extreme samples of the demeaned trace, scaled to a peak of 1, whose n samples from there on hardly vary."""
    y = x - x.mean()
    y = y / (np.abs(y).max() or 1.0)
    spread = np.zeros(len(y))  # the last n samples have no window and count as steady
    if len(y) > n:
        spread[: len(y) - n] = np.lib.stride_tricks.sliding_window_view(y, n)[: len(y) - n].std(1)
    return int(((spread < floor) & ((y >= share * y.max()) | (y <= share * y.min()))).sum())


def jerks(x: np.ndarray, dt: float, factor: float) -> int:
    if len(x) < 2:
        return 0
    size = np.abs(np.gradient(np.gradient(x, dt), dt))
    return int((size >= factor * np.median(size)).sum())


def exponential_smoothing(y: np.ndarray, alpha: float) -> np.ndarray:
    """One-step forecasts of simple exponential smoothing; the first level is that of least squared errors."""
    keep = 1 - alpha
    level = one_pole(np.concatenate(([0.0], alpha * y[:-1])), keep)
    weight = keep ** np.arange(len(y))
    return level + weight * float((weight * (y - level)).sum() / (weight * weight).sum())


def both_ways(y: np.ndarray, alpha: float) -> np.ndarray:
    return exponential_smoothing(exponential_smoothing(y, alpha)[::-1], alpha)[::-1]


def first_bump(high: np.ndarray, least: int) -> tuple[int, int] | None:
    """(end, width) of the first run of true values that is wider than least and ends within."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], high)).astype(np.int8)))
    for begin, end in zip(edge[::2], edge[1::2]):
        if end - begin > least:
            return int(end), int(end - begin)
    return None


def grows(x: np.ndarray, peaks: np.ndarray, most: float) -> bool:
    """Whether an interval around one of the peaks, widened while samples stay near their running mean and their neighbour, has more than one sample."""
    size = np.abs(x)

    def reach(side: np.ndarray) -> int:
        """How many samples beside the first belong; none where the trace ends before one does not."""
        for most_at in (256, len(side)):  # most end soon
            part = side[:most_at]
            n = np.arange(1, len(part) + 1)
            bad = (np.abs(np.cumsum(part) / n - part) > most) | (np.abs(np.diff(part, prepend=part[0])) > most)
            at = np.flatnonzero(bad[1:])
            if len(at):
                return int(at[0])
        return 0

    return any(reach(size[p:0:-1]) or reach(size[p:]) for p in peaks)


def histogram_intervals(x: np.ndarray, lim: Limits) -> int:
    """How many sides of the amplitude histogram (0 to 2) have a bump at which the trace stays clipped (after Laguna and Lerch, 2016)."""
    y = x - x.mean()
    if not np.abs(y).max() > 0:
        return 0
    y = y / np.abs(y).max()
    counts, edges = np.histogram(y, lim.bins)
    fine = both_ways(counts.astype(float), 0.2)
    bump = fine - both_ways(fine, 0.025) > 1
    found = 0
    for z, high, edge in ((-y, bump, -edges), (y, bump[::-1], edges[::-1])):
        got = first_bump(high[: lim.search_bins], lim.least_width)
        if got is None:
            continue
        end, width = got
        level, half = edge[end + 1], (edge[end - width] - edge[end + 1]) / 2
        inner = z[1:-1]
        top = np.flatnonzero((inner >= abs(level)) & (inner > z[:-2]) & (inner > z[2:])) + 1
        top = top[np.argsort(-z[top], kind="stable")][: lim.most_peaks]
        found += grows(z, top, half)
    return found


def detectors(df: DataFrame, keys: list[str], dt: float | None = None, lim: Limits = Limits()) -> DataFrame:
    """keys, and of each trace clip_max; n and clip of ping, std, jerk, hist. Null and empty traces give nulls."""

    def one(x: np.ndarray | None, step: float | None) -> list:
        if x is None or not len(x) or not step:
            return [None] * 9
        top = bool(np.abs(x - x.mean()).max() > lim.max_amp)
        x = without_tail(x, lim.tail)
        if not len(x):
            return [top, 0, False, 0, False, 0, False, 0, False]
        p, s, j, h = jumps(x, lim.ping), steady(x, lim.std_n, lim.std_floor, lim.std_share), jerks(x, step, lim.jerk_factor), histogram_intervals(x, lim)
        return [bool(np.abs(x - x.mean()).max() > lim.max_amp), p, p > 0, s, s > lim.std_points, j, j > lim.jerk_points, h, h > 0]

    kinds = [pa.bool_() if c.split()[1] == "boolean" else pa.int32() for c in OUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                rows = [one(samples_of(b.column("x"), i), t) for i, t in enumerate(steps_of(b, dt))]
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], [*keys, *(c.split()[0] for c in OUT.split(", "))])

    rate = ["sampling_rate"] if dt is None and "sampling_rate" not in keys else []
    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, *rate, "x").mapInArrow(run, f"{schema}, {OUT}")


def network(inputs: list, w1: list[list[float]], b1: list[float], w2: list[float], b2: float, scale: list[float]):
    """The output column of a network with one hidden layer: sigmoid(w2 . relu(w1 . (scale * inputs) + b1) + b2)."""
    x = [F.lit(float(k)) * v for k, v in zip(scale, inputs)]
    total = lambda terms: sum(terms[1:], terms[0])
    hidden = [F.greatest(total([F.lit(float(w1[i][j])) * x[i] for i in range(len(x))]) + F.lit(float(b1[j])), F.lit(0.0)) for j in range(len(b1))]
    return 1 / (1 + F.exp(-(total([F.lit(float(w)) * h for w, h in zip(w2, hidden)]) + F.lit(float(b2)))))


def record_probability(detected: DataFrame, records: DataFrame, key: str, weights: dict) -> DataFrame:
    """key and probability of each record: its traces' detectors (any of them), magnitude and dist_km, through network().

    Magnitude and distance are clipped to the range that the network was trained on (4 to 8.8, 0 to 445 km).
    """
    hit = detected.groupBy(key).agg(*(F.max(F.coalesce(c, F.lit(False)).cast("double")).alias(c) for c in ("clip_max", "clip_hist", "clip_ping")))
    clip = lambda c, lo, hi: F.least(F.greatest(F.col(c).cast("double"), F.lit(lo)), F.lit(hi))
    inputs = [clip("magnitude", 4.0, 8.8), clip("dist_km", 0.0, 445.0), F.col("clip_max"), F.col("clip_hist"), F.col("clip_ping")]
    return hit.join(records.select(key, "magnitude", "dist_km"), key).select(key, network(inputs, **weights).alias("probability"))
