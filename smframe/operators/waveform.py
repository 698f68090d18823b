"""Waveform transforms and metrics over a DataFrame of traces (column x: array<double>).

Expressions where the JVM has them; transforms and spectra are Arrow batches through small NumPy helpers, so a
trace never leaves its row and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from smframe.functions import arrays, physics

CM = 0.01


def samples_of(column: pa.Array, i: int) -> np.ndarray | None:
    """The samples of row i, NaN for null ones; None where the trace is null."""
    v = column[i]
    return v.values.to_numpy(zero_copy_only=False).astype(np.float64) if v.is_valid else None


def steps_of(b: pa.RecordBatch, dt: float | None) -> list[float | None]:
    """Each row's sampling interval: dt, or else its own, 1 / sampling_rate."""
    return [dt] * b.num_rows if dt else [1 / r if r else None for r in b.column("sampling_rate").to_pylist()]


def mapped(df: DataFrame, kernel: Callable[[np.ndarray, float], list[np.ndarray]], outs: list[str], dt: float | None = None, source: str = "x") -> DataFrame:
    """df with one array<double> column for each of outs, which kernel(samples, dt) gives for a trace.

    dt: the sampling interval of all traces, or else 1 / sampling_rate of each row. A null trace, or one without a rate,
    gives null; an empty one gives empty arrays.
    """

    def one(x: np.ndarray | None, step: float | None) -> list:
        if x is None or step is None:
            return [None] * len(outs)
        return kernel(x, step) if len(x) else [x] * len(outs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs = b.column(source)
            rows = [one(samples_of(xs, i), step) for i, step in enumerate(steps_of(b, dt))]
            cols = [pa.array([r[k] for r in rows], pa.list_(pa.float64())) for k in range(len(outs))]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, *outs])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"{o} array<double>" for o in outs])
    return df.mapInArrow(run, schema)


def measured(df: DataFrame, dt: float | None = None, **kernels: Callable[[np.ndarray, float], float | None]) -> DataFrame:
    """df with one double column for each kernel(samples, dt); null where a kernel gives None, and for null and empty traces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs, steps = b.column("x"), steps_of(b, dt)
            rows = [(x, t) if (x := samples_of(xs, i)) is not None and len(x) and t else None for i, t in enumerate(steps)]
            cols = [pa.array([None if r is None or (y := f(*r)) is None else float(y) for r in rows], pa.float64()) for f in kernels.values()]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, *kernels])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"{k} double" for k in kernels])
    return df.mapInArrow(run, schema)


# ---- spectra -------------------------------------------------------------------------------------------------


def integrate_fd(x: np.ndarray, dt: float, initial: float = 0.0) -> np.ndarray:
    """The integral by division by 2 pi i f; the mean goes, and the first value becomes initial."""
    f = np.fft.rfftfreq(len(x), dt)
    f[0] = 1.0
    s = np.fft.rfft(x) / (2j * np.pi * f)
    s[0] = 0.0
    y = np.fft.irfft(s, n=len(x))
    return y - y[0] + initial


def differentiate_fd(x: np.ndarray, dt: float) -> np.ndarray:
    return np.fft.irfft(np.fft.rfft(x) * (2j * np.pi * np.fft.rfftfreq(len(x), dt)), n=len(x))


def butterworth_fd(x: np.ndarray, dt: float, low: float | None, high: float | None, order: int = 5) -> np.ndarray:
    """Divides the spectrum by the Butterworth amplitude of a high-pass at low and a low-pass at high; the mean goes."""
    f = np.fft.rfftfreq(len(x), dt)
    f[0] = 1.0
    gain = np.ones_like(f)
    if low:
        gain = gain * np.sqrt(1 + (low / f) ** (2 * order))
    if high:
        gain = gain * np.sqrt(1 + (f / high) ** (2 * order))
    s = np.fft.rfft(x) / gain
    s[0] = 0.0
    return np.fft.irfft(s, n=len(x))


def amplitude(x: np.ndarray, dt: float, n: int | None = None) -> np.ndarray:
    return np.abs(np.fft.rfft(x, n or 1 << max(0, len(x) - 1).bit_length())) * dt


def konno_ohmachi(spec: np.ndarray, freq: np.ndarray, at: np.ndarray, b: float) -> np.ndarray:
    """Smoothing with the window (sin(b log10(f/fc)) / (b log10(f/fc)))^4 within 10^(+-3/b); NaN beyond the spectrum."""
    use = freq > 0
    q = b * np.log10(freq[use][None, :] / at[:, None])
    with np.errstate(invalid="ignore", divide="ignore"):
        w = np.where(np.abs(q) < 1e-12, 1.0, (np.sin(q) / q) ** 4)
    w[np.abs(q) > 3] = 0.0
    total = w.sum(1)
    out = np.full(len(at), np.nan)
    ok = (total > 0) & (at >= freq.min()) & (at <= freq.max())
    out[ok] = (w[ok] @ spec[use]) / total[ok]
    return out


def integrate_td(x: np.ndarray, dt: float) -> np.ndarray:
    """The integral by trapezoids, from 0."""
    return np.concatenate(([0.0], np.cumsum((x[1:] + x[:-1]) * (dt / 2))))


def integrated(df: DataFrame, dt: float | None = None, frequency: bool = True) -> DataFrame:
    return mapped(df, lambda x, t: [integrate_fd(x, t) if frequency else integrate_td(x, t)], ["velocity"], dt)


def differentiated(df: DataFrame, dt: float | None = None) -> DataFrame:
    return mapped(df, lambda x, t: [differentiate_fd(x, t)], ["derivative"], dt)


def filtered(df: DataFrame, dt: float | None = None, low: float | None = None, high: float | None = None, order: int = 5) -> DataFrame:
    return mapped(df, lambda x, t: [butterworth_fd(x, t, low, high, order)], ["filtered"], dt)


def spectra(df: DataFrame, dt: float | None = None) -> DataFrame:
    return mapped(df, lambda x, t: [amplitude(x, t)], ["spec"], dt)


def smoothed(df: DataFrame, dt: float | None, at: list[float], b: float) -> DataFrame:
    """df with `smooth`: the spectrum of spec, of an even number of points, at the given frequencies."""
    centres = np.array(at)
    return mapped(df, lambda s, t: [konno_ohmachi(s, np.fft.rfftfreq(2 * (len(s) - 1), t), centres, b)], ["smooth"], dt, "spec")


# ---- oscillator ----------------------------------------------------------------------------------------------


def oscillator_step(period: float, damping: float, dt: float) -> list[float]:
    """The eight coefficients of the exact recurrence for piecewise linear input (Nigam and Jennings)."""
    w, z = 2 * np.pi / period, damping
    wd = w * np.sqrt(1 - z * z)
    e, s, c = np.exp(-z * w * dt), np.sin(wd * dt), np.cos(wd * dt)
    k, q = 2 * z / (w**3 * dt), (2 * z * z - 1) / (w * w * dt)
    p, r = c - z * w / wd * s, wd * s + z * w * c
    a11, a12 = e * (c + z * w / wd * s), e * s / wd
    b11 = e * ((q + z / w) * s / wd + (k + 1 / w**2) * c) - k
    b12 = -e * (q * s / wd + k * c) - 1 / w**2 + k
    b21 = e * ((q + z / w) * p - (k + 1 / w**2) * r) + 1 / (w * w * dt)
    b22 = -e * (q * p - k * r) - 1 / (w * w * dt)
    return [float(v) for v in (a11, a12, -w * w * a12, e * p, b11, b12, b21, b22)]


def response(x: Column, period: float, damping: float, dt: float) -> Column:
    """Struct sd, sv, sa: the largest magnitudes of relative displacement, relative velocity and total acceleration.

    A fold over the samples in the JVM with the exact recurrence.
    """
    a11, a12, a21, a22, b11, b12, b21, b22 = oscillator_step(period, damping, dt)
    w = 2 * np.pi / period
    zero = lambda n: F.lit(0.0).alias(n)
    start = F.struct(zero("d"), zero("v"), F.lit(None).cast("double").alias("p"), zero("sd"), zero("sv"), zero("sa"))

    def step(s: Column, a: Column) -> Column:
        first = s["p"].isNull()
        d = F.when(first, 0.0).otherwise(a11 * s["d"] + a12 * s["v"] + b11 * s["p"] + b12 * a)
        v = F.when(first, 0.0).otherwise(a21 * s["d"] + a22 * s["v"] + b21 * s["p"] + b22 * a)
        return F.struct(d.alias("d"), v.alias("v"), a.alias("p"), F.greatest(s["sd"], F.abs(d)).alias("sd"), F.greatest(s["sv"], F.abs(v)).alias("sv"), F.greatest(s["sa"], F.abs(2 * damping * w * v + w * w * d)).alias("sa"))

    return F.aggregate(x, start, step, lambda s: F.struct(s["sd"].alias("sd"), s["sv"].alias("sv"), s["sa"].alias("sa")))


def response_spectra(df: DataFrame, periods: list[float], damping: float, dt: float, keys: list[str]) -> DataFrame:
    """keys, period, sd, sv, sa, psv, psa (accelerations in %g) for each trace and period."""
    out = F.explode(F.array(*(F.struct(F.lit(p).alias("period"), response(F.col("x"), p, damping, dt).alias("r")) for p in periods)))
    r = df.select(*keys, out.alias("o")).select(*keys, "o.period", "o.r.*")
    w = 2 * np.pi / F.col("period")
    return r.select(*keys, "period", "sd", "sv", (F.col("sa") * physics.GAL_TO_PCTG).alias("sa"), (w * F.col("sd")).alias("psv"), (w * w * F.col("sd") * physics.GAL_TO_PCTG).alias("psa"))


# ---- records -------------------------------------------------------------------------------------------------


def horizontal_pairs(traces: DataFrame, keys: list[str]) -> DataFrame:
    """keys, x1, x2: the two horizontal traces of each record that has both, in channel order; one shuffle by record."""
    h = traces.where("component <> 'Z'").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("channel", "x"))).alias("h"))  # a record has a few channels
    return h.where(F.size("h") == 2).select(*keys, F.get("h", F.lit(0))["x"].alias("x1"), F.get("h", F.lit(1))["x"].alias("x2"))


def rotd(pairs: DataFrame, keys: list[str], percentiles: list[float], names: list[str]) -> DataFrame:
    """keys and the percentiles, over 0 to 180 degrees, of the peak of x1 cos + x2 sin."""
    theta = np.deg2rad(np.arange(181))
    turn = np.stack((np.cos(theta), np.sin(theta)), axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for p, q in zip(b.column("x1"), b.column("x2")):
                xy, peak = np.stack((np.asarray(p.values, dtype=float), np.asarray(q.values, dtype=float))), np.zeros(181)
                for k in range(0, xy.shape[1], 8192):
                    peak = np.maximum(peak, np.abs(turn @ xy[:, k : k + 8192]).max(1))
                got.append(np.percentile(peak, percentiles))
            if got:
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), *(pa.array(c) for c in np.array(got).T)], [*keys, *names])

    kinds = [f"{k} {pairs.schema[k].dataType.simpleString()}" for k in keys]
    return pairs.select(*keys, "x1", "x2").mapInArrow(run, ", ".join([*kinds, *(f"{n} double" for n in names)]))


def arias(x: Column, dt: float) -> Column:
    """Arias intensity in m/s of a trace in cm/s^2."""
    return arrays.trapezoid(F.transform(x, lambda v: v * v * (CM * CM)), dt) * (np.pi * physics.GAL_TO_PCTG / 2)


def cav(x: Column, dt: float) -> Column:
    """Cumulative absolute velocity in g s."""
    return arrays.trapezoid(F.transform(x, lambda v: F.abs(v) * (CM * physics.GAL_TO_PCTG)), dt)


def husid(x: np.ndarray, dt: float) -> np.ndarray | None:
    """The running share of the Arias intensity; None for a silent trace."""
    run = integrate_td(x * x, dt)
    return run / run[-1] if run[-1] > 0 else None


def duration(x: np.ndarray, dt: float, low: float, high: float) -> float | None:
    """Seconds between the first samples at which the share is nearest to low and to high."""
    h = husid(x, dt)
    return None if h is None else (int(np.argmin(np.abs(h - high))) - int(np.argmin(np.abs(h - low)))) * dt


def durations(df: DataFrame, intervals: list[tuple[float, float]], names: list[str], dt: float | None = None) -> DataFrame:
    return measured(df, dt, **{n: (lambda x, t, lo=lo, hi=hi: duration(x, t, lo, hi)) for n, (lo, hi) in zip(names, intervals)})


# ---- rotated response, resampling ----------------------------------------------------------------------------


def rotd_response(pairs: DataFrame, keys: list[str], periods: list[float], damping: float, dt: float, percentile: float = 50.0) -> DataFrame:
    """keys, period, sd: the percentile over 0 to 180 degrees of the peak displacement of oscillators under the rotated traces.

    The oscillator is linear, so both components' responses are found once and rotated, sample by sample for all
    records of a batch and all periods together.
    """
    theta = np.deg2rad(np.arange(181))
    turn = np.stack((np.cos(theta), np.sin(theta)))
    a11, a12, a21, a22, b11, b12, b21, b22 = np.array([oscillator_step(p, damping, dt) for p in periods]).T

    def peaks(x: np.ndarray) -> np.ndarray:
        """(rows, 2, samples) to (rows, periods, 181)."""
        d = np.zeros((len(x), 2, len(periods)))
        v, most = np.zeros_like(d), np.zeros((len(x), len(periods), 181))
        for k in range(1, x.shape[2]):
            p, q = x[:, :, k - 1, None], x[:, :, k, None]
            d, v = a11 * d + a12 * v + b11 * p + b12 * q, a21 * d + a22 * v + b21 * p + b22 * q
            np.maximum(most, np.abs(np.swapaxes(d, 1, 2) @ turn), out=most)
        return most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                xy = [(np.asarray(p.values, dtype=float), np.asarray(q.values, dtype=float)) for p, q in zip(part.column("x1"), part.column("x2"))]
                for n in {len(p) for p, _ in xy}:
                    at = [i for i, (p, _) in enumerate(xy) if len(p) == n]
                    got = np.percentile(peaks(np.array([xy[i] for i in at])), percentile, axis=2)
                    rows = part.take(pa.array(np.repeat(at, len(periods))))
                    yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in keys), pa.array(np.tile(periods, len(at))), pa.array(got.ravel())], [*keys, "period", "sd"])

    kinds = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in keys)
    return pairs.select(*keys, "x1", "x2").mapInArrow(run, f"{kinds}, period double, sd double")


def lanczos(x: np.ndarray, dt: float, step: float, a: int) -> np.ndarray:
    """x at multiples of step up to its last sample, with the kernel sinc(u) sinc(u / a) for |u| < a."""
    t = np.arange(int(np.floor((len(x) - 1) * dt / step + 1e-9)) + 1) * (step / dt)
    near = np.floor(t).astype(int)[:, None] + np.arange(1 - a, a + 1)[None, :]
    u = t[:, None] - near
    w = np.where(np.abs(u) < a, np.sinc(u) * np.sinc(u / a), 0.0)
    ok = (near >= 0) & (near < len(x))
    return (np.where(ok, x[np.clip(near, 0, len(x) - 1)], 0.0) * w).sum(1)


def resampled(df: DataFrame, dt: float | None, step: float, a: int = 100) -> DataFrame:
    return mapped(df, lambda x, t: [lanczos(x, t, step, a)], ["resampled"], dt)
