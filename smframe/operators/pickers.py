"""Onset pickers: power (envelope ratios), Baer and Kradolfer's, and autoregressive ones on three components.

Each takes samples and gives seconds after the first one, or None. What needs one trace is called from signal_split; the autoregressive
picker needs a record's vertical and both horizontals together, which meet in one grouping on the record's key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from smframe.operators.filters import butterworth_td

# ---- power -----------------------------------------------------------------------------------------------------


def fourier_resample(x: np.ndarray, n: int) -> np.ndarray:
    """x at n evenly spaced places of the same span, its spectrum weighted by a Hann window about zero frequency."""
    s = np.fft.rfft(x)
    s = s * 0.5 * (1 + np.cos(2 * np.pi * np.arange(len(s)) / len(x)))
    out = np.zeros(n // 2 + 1, complex)
    k = min(len(s), len(out))
    out[:k] = s[:k]
    return np.fft.irfft(out, n) * (n / len(x))


def envelope(x: np.ndarray) -> np.ndarray:
    """The magnitude of the analytic signal."""
    n = len(x)
    weight = np.zeros(n)
    weight[0] = 1
    weight[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        weight[n // 2] = 1
    return np.abs(np.fft.ifft(np.fft.fft(x) * weight))


def akaike(x: np.ndarray, edge: int = 5) -> int | None:
    """Where variances before and after part best, edge samples from either end at least."""
    n = len(x)
    if n < 2 * edge + 3:
        return None
    c1, c2 = np.concatenate(([0.0], np.cumsum(x))), np.concatenate(([0.0], np.cumsum(x * x)))
    k = np.arange(edge, n - edge)

    def log_var(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        m = j - i
        v = (c2[j] - c2[i]) / m - ((c1[j] - c1[i]) / m) ** 2
        return np.where(v > 1e-300, np.log(np.maximum(v, 1e-300)), 0.0)

    return int(k[np.argmin(k * log_var(np.zeros_like(k), k) + (n - k + 1) * log_var(k + 1, np.full_like(k, n)))])


def power_pick(x: np.ndarray, dt: float, highpass: float = 1.4, lowpass: float = 6.0, order: int = 3, sta: float = 3.0, sta2: float = 3.0, lta: float = 20.0, hanning: float = 3.0, threshold: float = 2.0, threshold2: float = 2.5, search: float = 4.0, rate: float = 20.0) -> float | None:
    """The first peak of short over long means of the band's smoothed envelope (after Earle and Shearer, 1994), refined by Akaike's criterion."""
    n = int(round(len(x) * dt * rate))
    long, short, short2 = int(lta * rate), int(sta * rate), int(sta2 * rate)
    if n < long + max(short, short2) + 2 or not np.isfinite(x).all() or not np.any(x != x[0]):
        return None
    y = fourier_resample(x, n)
    y = y - (y[0] + (y[-1] - y[0]) * np.arange(n) / (n - 1))
    y = butterworth_td(y, 1 / rate, highpass, lowpass, order)
    width = int(hanning * rate)
    e = np.convolve(envelope(y), np.hanning(width), "same")[:n]
    c = np.concatenate(([0.0], np.cumsum(e)))
    at = np.arange(long + 1, n)  # the long window ends a sample before, the short ones begin here
    mean = lambda i, j, m: (c[np.minimum(j, n)] - c[i]) / m
    background = np.maximum(mean(at - 1 - long, at - 1, long), 1e-5 * max(np.abs(y).max(), 1e-300))
    ratio, ratio2 = mean(at, at + short, short) / background, mean(at, at + short2, short2) / background
    on = np.flatnonzero((ratio[:-1] >= threshold) & (ratio2[:-1] >= threshold2) & (ratio[:-1] > ratio[1:]))
    if not len(on):
        return None
    k, w = int(at[on[0]]), int(search * rate)
    if k - 2 * w <= 0 or k + w >= n:
        return None
    part = (y - np.median(y))[k - 2 * w : k + w]
    best = akaike(part)
    return None if best is None else float((k - 2 * w + best + 1) / rate)


# ---- Baer and Kradolfer ----------------------------------------------------------------------------------------


def baer_pick(x: np.ndarray, dt: float, up: float = 7.0, reset: float = 12.0, longest_dip: int = 20, least_up: int = 60, preset: int = 100) -> float | None:
    """The first time that the characteristic function rises above `up` deviations and stays (Baer and Kradolfer, 1987).

    The function is the standardised square of the envelope x^2 + c x'^2, c the ratio of their sums so far; its mean and
    deviation follow all samples of up to `reset` deviations. It may dip below for longest_dip samples in a row and must have been above for
    least_up in all; preset samples at the start only teach.
    """
    n = len(x)
    if n <= preset + least_up or not np.isfinite(x).all() or not np.any(x != x[0]):
        return None
    x = x - x[0]
    slope = np.diff(x, prepend=x[0])
    power, change = np.cumsum(x * x), np.cumsum(slope * slope)
    e = (x * x + slope * slope * np.divide(power, change, out=np.zeros(n), where=change > 0)) ** 2
    e = (e / max(e.max(), 1e-300)).tolist()
    count, s1, s2 = preset, sum(e[:preset]), sum(v * v for v in e[:preset])
    start, above, dip = None, 0, 0
    for k in range(preset, n):
        v = e[k]
        mean = s1 / count
        spread = max(s2 / count - mean * mean, 0.0) ** 0.5
        z = (v - mean) / spread if spread > 0 else (float("inf") if v > mean else 0.0)
        if z > up:
            if start is None:
                start, above = k, 0
            above, dip = above + 1, 0
            if above >= least_up:
                return start * dt
        elif start is not None:
            dip += 1
            if dip > longest_dip:
                start, above, dip = None, 0, 0
        if z <= reset:
            count, s1, s2 = count + 1, s1 + v, s2 + v * v
    return None


# ---- autoregressive --------------------------------------------------------------------------------------------


def levinson(r: np.ndarray) -> np.ndarray:
    """The prediction-error filter (1, a1, ...) of an autocorrelation, by the Levinson-Durbin recursion."""
    a, error = np.array([1.0]), float(r[0])
    for m in range(1, len(r)):
        if error <= 0:
            return np.pad(a, (0, len(r) - len(a)))
        k = -float(a @ r[m:0:-1]) / error
        a = np.append(a, 0.0)
        a = a + k * a[::-1]
        error *= 1 - k * k
    return a


def prediction_errors(x: np.ndarray, learn: np.ndarray, order: int) -> np.ndarray:
    """What the filter learned from learn doesn't foretell of x; the first order samples have none (0)."""
    y = learn - learn.mean()
    r = np.array([y[: len(y) - k] @ y[k:] for k in range(order + 1)]) / len(y)
    r[0] *= 1 + 1e-9
    e = np.convolve(x - learn.mean(), levinson(r))[: len(x)]
    e[:order] = 0.0
    return e


def onset_between(x: np.ndarray, order: int, edge: int) -> int | None:
    """The sample that best parts x in two autoregressive pieces: errors of a filter of its start, forwards, and of its end, backwards."""
    n = len(x)
    third = n // 3
    if third <= 2 * order or n < 4 * edge:
        return None
    forward = prediction_errors(x, x[:third], order)
    backward = prediction_errors(x[::-1], x[-third:][::-1], order)[::-1]
    f, b = np.concatenate(([0.0], np.cumsum(forward**2))), np.concatenate((np.cumsum(backward[::-1] ** 2)[::-1], [0.0]))
    k = np.arange(order + edge, n - order - edge)
    tiny = 1e-30 * max(float((x * x).max()), 1e-300)
    cost = k * np.log(f[k] / k + tiny) + (n - k) * np.log(b[k] / (n - k) + tiny)
    return int(k[np.argmin(cost)])


def ar_pick(z: np.ndarray, n: np.ndarray, e: np.ndarray, dt: float, f1: float = 1.0, f2: float = 20.0, lta_p: float = 1.0, sta_p: float = 0.1, lta_s: float = 4.0, sta_s: float = 1.0, m_p: int = 2, m_s: int = 8, l_p: float = 0.1, l_s: float = 0.2) -> tuple[float | None, float | None]:
    """(P, S): P on the vertical, S behind it on the sum of both horizontals' squares (after Akazawa, 2004).

    A short over a long mean of squares finds the neighbourhood; within it, autoregressive filters learned before and behind give forward and
    backward prediction errors, whose Akaike criterion is least at the onset. l_p and l_s keep picks off the ends of the neighbourhood.
    """
    size = min(map(len, (z, n, e)))
    if size < 4 * lta_p / dt or not all(np.isfinite(v).all() for v in (z, n, e)):
        return None, None
    band = lambda v: butterworth_td(v[:size] - v[:size].mean(), dt, f1, min(f2, 0.45 / dt), 2)
    z, n, e = band(z), band(n), band(e)
    if not np.any(z):
        return None, None

    def near(power: np.ndarray, short: float, long: float, first: int) -> int | None:
        s, m = max(1, int(round(short / dt))), max(2, int(round(long / dt)))
        c = np.concatenate(([0.0], np.cumsum(power)))
        k = np.arange(max(m, first), size - s)
        if not len(k):
            return None
        background = np.maximum((c[k] - c[k - m]) / m, 1e-12 * power.max())
        return int(k[np.argmax((c[k + s] - c[k]) / s / background)])

    def pick(x: np.ndarray, at: int | None, half: float, order: int, edge: float, first: int) -> int | None:
        if at is None:
            return None
        lo, hi = max(first, at - int(half / dt)), min(size, at + int(half / dt))
        k = onset_between(x[lo:hi], order, max(2, int(edge / dt / 2)))
        return None if k is None else lo + k

    p = pick(z, near(z * z, sta_p, lta_p, 0), lta_p, m_p, l_p, 0)
    if p is None:
        return None, None
    horizontal = n * n + e * e
    first = p + int(2 * l_s / dt)
    at = near(horizontal, sta_s, lta_s, first) if first < size else None
    x = n if (n * n).sum() >= (e * e).sum() else e
    s = pick(x, at, lta_s / 2, m_s, l_s, first)
    return p * dt, None if s is None else s * dt


def ar_picks(traces: DataFrame, keys: list[str], **options) -> DataFrame:
    """keys, ar_p and ar_s (seconds) of records with one vertical and one of each horizontal, of one rate; null for all others.

    traces: keys, channel, sampling_rate, x. The last letter of channel tells components: Z or 3, N or 2, E or 1.
    """
    last = F.right("channel", F.lit(1))
    part = F.when(last.isin("Z", "3"), "z").when(last.isin("N", "2"), "n").when(last.isin("E", "1"), "e")
    d = traces.select(*keys, part.alias("_c"), "sampling_rate", "x")
    of = lambda c: F.max(F.when(F.col("_c") == c, F.struct("sampling_rate", "x"))).alias(f"_{c}")
    many = lambda c: F.count(F.when(F.col("_c") == c, 1)).alias(f"_n{c}")
    g = d.groupBy(*keys).agg(*map(of, "zne"), *map(many, "zne"), F.count(F.lit(1)).alias("_all"))
    whole = (F.col("_nz") == 1) & (F.col("_nn") == 1) & (F.col("_ne") == 1) & (F.col("_z.sampling_rate") == F.col("_n.sampling_rate")) & (F.col("_z.sampling_rate") == F.col("_e.sampling_rate"))
    g = g.select(*keys, F.when(whole, F.struct(F.col("_z.sampling_rate").alias("rate"), F.col("_z.x").alias("z"), F.col("_n.x").alias("n"), F.col("_e.x").alias("e"))).alias("_r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for r in b.column("_r"):
                v = [None] * 3
                if r.is_valid and r["rate"].is_valid:
                    v = [r[c].values.to_numpy(zero_copy_only=False).astype(float) if r[c].is_valid and len(r[c]) else None for c in "zne"]
                got.append(ar_pick(*v, 1 / r["rate"].as_py(), **options) if all(x is not None for x in v) else (None, None))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), *(pa.array([g[i] for g in got], pa.float64()) for i in (0, 1))], [*keys, "ar_p", "ar_s"])

    schema = ", ".join(f"`{k}` {g.schema[k].dataType.simpleString()}" for k in keys)
    return g.mapInArrow(run, f"{schema}, ar_p double, ar_s double")
