"""Noise and signal windows, onset picks, signal-to-noise ratios and the corners they give.

Times are seconds after a trace's first sample. What needs one trace is an Arrow pass; what a record's traces share
(the pick, equal horizontal corners) is a window over the record, whose traces are few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from smframe.functions import physics
from smframe.operators.filters import butterworth_td
from smframe.operators.pickers import ar_picks, baer_pick, power_pick
from smframe.operators.recurrence import two_states
from smframe.operators.relational import failed
from smframe.operators.waveform import amplitude, konno_ohmachi, measured, samples_of

# ---- picks -----------------------------------------------------------------------------------------------------


def state_level(y: np.ndarray, bins: int) -> float:
    """The mode of the lower half of y's histogram."""
    lo, hi = y.min(), y.max()
    counts, edges = np.histogram(y, bins, (lo, hi if hi > lo else lo + 1))
    used = np.flatnonzero(counts)
    lower = counts[used[0] : used[0] + max(1, (used[-1] - used[0]) // 2)]
    k = used[0] + int(np.argmax(lower))
    return float((edges[k] + edges[k + 1]) / 2)


def kalkan_pick(x: np.ndarray, dt: float, damping: float = 0.6, low: float = 0.1, high: float = 20.0) -> float | None:
    """The last zero crossing before the damping energy of a stiff oscillator leaves its state level (Kalkan, 2016)."""
    peak = np.abs(x).max()
    if len(x) < 20 or not peak > 0:
        return None
    y = butterworth_td(x / peak, dt, low, min(high, 0.45 / dt), 4)
    y = y - np.polynomial.Polynomial.fit(t := np.arange(len(y)), y, 1)(t)
    w = 2 * np.pi / (0.01 if dt <= 0.01 else 0.1)
    wd = w * np.sqrt(1 - damping**2)
    e, c, s = np.exp(-damping * w * dt), np.cos(wd * dt), np.sin(wd * dt) / wd
    a11, a12, a21, a22 = e * (c + damping * w * s), e * s, -w * w * e * s, e * (c - damping * w * s)
    # the response to a load held over a step, with unit mass
    b1, b2 = (1 - a11) / (w * w), e * s
    load = np.append(0.0, y[1:])
    _, v = two_states(np.array([[a11, a12], [a21, a22]]), (b1 * load, b2 * load))
    energy = 2 * damping * w * v * v
    bins = int(np.ceil(2 / dt))
    for n in (bins, (bins + 1) // 2):
        beyond = np.flatnonzero(energy > state_level(energy, n))
        if len(beyond):
            cross = np.flatnonzero(y[: beyond[0] - 1] * y[1 : beyond[0]] < 0) if beyond[0] > 1 else []
            if len(cross):
                return float((cross[-1] + 1) * dt)
    return None


def onset_pick(x: np.ndarray, dt: float) -> float | None:
    """The sample that best parts the trace in two by Akaike's criterion."""
    from smframe.operators.corners import akaike_index

    k = akaike_index(x)
    return None if k is None else k * dt


PICKERS = {"kalkan": kalkan_pick, "onset": onset_pick, "power": power_pick, "baer": baer_pick}


def snr_db(x: np.ndarray, dt: float, pick: float) -> float | None:
    """10 log10 of the mean square of the trace over that before the pick."""
    noise = x[: max(0, int(round(pick / dt)))]
    n = float((noise**2).mean()) if len(noise) else 0.0
    return 10 * float(np.log10((x**2).mean() / n)) if n > 0 and np.any(x) else None


def signal_split(traces: DataFrame, keys: list[str], methods: list[str] = ("travel_time",), combine: str = "median", window: float = 10.0, shift: float = 0.0, no_noise: bool = False) -> DataFrame:
    """traces with `split`, the same for all of a record: where noise ends.

    Column arrival holds the travel-time pick. The other methods pick within `window` of it, the record's pick being the
    earliest of its traces; ar picks whole records of three components (column channel), once for all of their traces; median, mean, or the pick of largest mean signal-to-noise ratio combines them, ignoring missing
    ones. The result, shifted, is never before the start; without any pick it is the start.
    """
    if combine not in ("median", "mean", "max_snr"):
        raise ValueError(f"unknown way to combine picks: {combine}")
    if unknown := {*methods} - {"travel_time", "ar", *PICKERS}:
        raise ValueError(f"unknown pickers: {sorted(unknown)}")
    if no_noise:
        return traces.withColumn("split", F.lit(0.0))
    names = [m for m in methods if m != "travel_time"]
    extra = [c for m in methods for c in (f"_pick_{m}", f"_snr_{m}")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in extra]
            ar = b.column("ar_p").to_pylist() if "ar" in methods else [None] * b.num_rows
            for i, (rate, arrival) in enumerate(zip(b.column("sampling_rate").to_pylist(), b.column("arrival").to_pylist())):
                x = samples_of(b.column("x"), i)
                ok = x is not None and len(x) and rate
                first = max(0, int(round((arrival - window) * rate))) if ok and arrival is not None else 0
                part = x[first : int(round((arrival + window) * rate)) + 1] if ok and arrival is not None else x
                for k, m in enumerate(methods):
                    if m == "travel_time":
                        p = arrival if ok and arrival is not None and arrival >= 0 else None
                    elif m == "ar":
                        p = ar[i] if ok else None
                    else:
                        p = PICKERS[m](part, 1 / rate) if ok and len(part) else None
                        p = None if p is None else p + first / rate
                    out[2 * k].append(p)
                    out[2 * k + 1].append(None if p is None else snr_db(part, 1 / rate, p - first / rate))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, pa.float64()) for c in out)], [*b.schema.names, *extra])

    d = traces
    if "ar" in methods:
        d = d.join(ar_picks(traces, keys).drop("ar_s"), keys, "left")
    if names or combine == "max_snr":
        schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema] + [f"{c} double" for c in extra])
        d = d.mapInArrow(run, schema)
    else:
        d = traces.withColumn("_pick_travel_time", F.when(F.col("arrival") >= 0, F.col("arrival"))).withColumn("_snr_travel_time", F.lit(None).cast("double"))
    w = Window.partitionBy(*keys)
    picks = F.filter(F.array(*(F.struct(F.avg(f"_snr_{m}").over(w).alias("snr"), F.min(f"_pick_{m}").over(w).alias("at")) for m in methods)), lambda p: p["at"].isNotNull())
    d = d.withColumn("_p", picks)
    at = F.sort_array(F.transform("_p", lambda p: p["at"]))
    n = F.size("_p")
    if combine == "median":
        best = (F.get(at, F.floor((n - 1) / 2).cast("int")) + F.get(at, F.floor(n / 2).cast("int"))) / 2
    elif combine == "mean":
        best = F.aggregate(at, F.lit(0.0), lambda s, v: s + v) / n
    else:
        best = F.array_max("_p")["at"]
    return d.withColumn("split", F.greatest(F.coalesce(F.when(n > 0, best), F.lit(0.0)) + F.lit(float(shift)), F.lit(0.0))).drop("_p", "ar_p", *extra)


def length(rate: Column | None = None) -> Column:
    """Seconds from the first to the last sample."""
    return (F.size("x") - 1) / (F.col("sampling_rate") if rate is None else rate)


def signal_end(d: DataFrame, method: str = "magnitude", vmin: float = 1.0, floor: float = 120.0, stress_drop: float = 10.0, dur0: float = 0.0, dur1: float = 0.15) -> DataFrame:
    """d with `signal_end`: by velocity (dist_km), source_path (dist_km, magnitude), magnitude, or none (the last sample).

    Column origin, where the method starts from the event, holds its time; split must be there.
    """
    if method == "velocity":
        end = F.col("origin") + F.greatest(F.lit(floor), F.col("dist_km") / vmin)
    elif method == "source_path":
        end = F.col("split") + 1 / physics.brune_f0(physics.moment(F.col("magnitude")), stress_drop) + dur0 + dur1 * F.col("dist_km")
    elif method == "magnitude":
        end = F.col("origin") + duration_of(F.col("magnitude"))
    elif method == "none":
        end = length()
    else:
        raise ValueError(f"unknown method of the signal's end: {method}")
    return d.withColumn("signal_end", F.least(end, length()))


def duration_of(magnitude: Column) -> Column:
    """Fixed value: the expected duration of shaking in seconds, 30 M - 30."""
    return 30 * magnitude - 30


def window_checks(d: DataFrame, min_noise: float = 0.5, min_signal: float = 5.0) -> DataFrame:
    """Fails traces whose noise or signal window is too short (the signal's reason where both are), or that have no split."""
    reason = (
        F.when(F.col("split").isNull(), "Cannot check window because no split time available.")
        .when(length() - F.col("split") < min_signal, "Failed signal window duration check.")
        .when(F.col("split") < min_noise, "Failed noise window duration check.")
    )
    return failed(d, "window_checks", reason, reason.isNotNull())


def cut(d: DataFrame, before: float | None = 30.0) -> DataFrame:
    """x up to signal_end and, unless before is None, from that many seconds before split on; times follow. Failed traces are cut too."""
    first = F.lit(0) if before is None else F.greatest(F.round((F.col("split") - before) * F.col("sampling_rate")), F.lit(0)).cast("int")
    last = F.least(F.round(F.col("signal_end") * F.col("sampling_rate")).cast("int"), F.size("x") - 1)
    d = d.withColumn("_a", F.coalesce(first, F.lit(0)).cast("int")).withColumn("_b", F.coalesce(last, F.size("x") - 1))
    d = d.withColumn("x", F.slice("x", F.col("_a") + 1, F.greatest(F.col("_b") - F.col("_a") + 1, F.lit(0))))
    for c in ("split", "signal_end", "arrival", "origin"):
        if c in d.columns:
            d = d.withColumn(c, F.col(c) - F.col("_a") / F.col("sampling_rate"))
    return d.drop("_a", "_b")


# ---- signal to noise -------------------------------------------------------------------------------------------

LEAST_POINTS, TAPER, MOST_CENTRES = 10, 0.05, 301


def hann_taper(x: np.ndarray, width: float = TAPER) -> np.ndarray:
    k = int(len(x) * width)
    if not k:
        return x
    w = np.ones(len(x))
    w[:k] = 0.5 * (1 - np.cos(np.pi * np.arange(k) / k))
    w[len(x) - k :] = w[:k][::-1]
    return x * w


def snr_of(x: np.ndarray, dt: float, split: float, shaking: float, b: float = 20.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | str:
    """(frequencies, ratios, and the smoothed spectra of signal and of noise over the event), or why there are none. Noise is scaled by the square root of its duration, the signal is the event less it."""
    k = int(round(split / dt))
    noise, event = x[: k + 1], x[k:]
    event = event[: int(round(min(shaking, (len(event) - 1) * dt) / dt)) + 1]
    if len(noise) < LEAST_POINTS:
        return "SNR check; Not enough points in noise window"
    if len(event) < LEAST_POINTS:
        return "SNR check; Not enough points in event window"
    n = 1 << max(len(noise) - 1, len(event) - 1).bit_length()
    freq = np.fft.rfftfreq(n, dt)
    at = np.logspace(np.log10(freq[1]), np.log10(freq[-1]), min(n - 1, MOST_CENTRES))
    at[0], at[-1] = freq[1], freq[-1]  # rounding must not push the ends out of the spectrum

    def smooth(y: np.ndarray) -> np.ndarray:
        s = amplitude(hann_taper(y - y.mean()), dt, n)
        s = konno_ohmachi(s, freq, at, b)
        s[at < 1 / (dt * len(x))] = np.nan
        return s

    noise_s, event_s = smooth(noise), smooth(event)
    before, during = (len(noise) - 1) * dt, (len(event) - 1) * dt
    expected = noise_s * np.sqrt(during / before)
    with np.errstate(invalid="ignore", divide="ignore"):
        return at, ((event_s - expected) / np.sqrt(during)) / (expected / np.sqrt(before)), event_s - expected, expected


def compute_snr(d: DataFrame, b: float = 20.0) -> DataFrame:
    """d with snr_freq, snr, signal_spectrum and noise_spectrum (NaN where the trace is too short for the frequency), and failures where a window has too few points.

    Needs split and magnitude; traces without a split get nulls.
    """
    names = ["snr_freq", "snr", "signal_spectrum", "noise_spectrum", "_why"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, (rate, split, m) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("sampling_rate", "split", "magnitude")))):
                x = samples_of(batch.column("x"), i)
                if x is None or not len(x) or not rate or split is None or m is None:
                    rows.append((None,) * 5)
                    continue
                got = snr_of(x, 1 / rate, split, 30 * m - 30, b)
                rows.append((None, None, None, None, got) if isinstance(got, str) else (*got, None))
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate((*[pa.list_(pa.float64())] * 4, pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*batch.schema.names, *names])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema] + ["snr_freq array<double>", "snr array<double>", "signal_spectrum array<double>", "noise_spectrum array<double>", "_why string"])
    out = d.mapInArrow(run, schema)
    return failed(out, "compute_snr", F.col("_why"), F.col("_why").isNotNull()).drop("_why")


def band(magnitude: Column, min_freq: float | str, stress_drop: float = 10.0, shear_vel: float = 3.7, ceiling: float = 2.0, floor: float = 0.1) -> Column:
    """The least frequency of the required band: given, or for 'f0' the source's corner within floor and ceiling."""
    if min_freq != "f0":
        return F.lit(float(min_freq))
    return F.least(F.greatest(physics.brune_f0(physics.moment(magnitude), stress_drop, shear_vel), F.lit(floor)), F.lit(ceiling))


def snr_check(d: DataFrame, threshold: float = 2.0, min_freq: float | str = "f0", max_freq: float = 5.0, **f0) -> DataFrame:
    """Fails traces whose ratio falls below threshold within the band; a NaN within it passes, no frequency within it fails."""
    lo = band(F.col("magnitude"), min_freq, **f0)
    d = d.withColumn("snr_min_freq", lo).withColumn("snr_max_freq", F.lit(float(max_freq))).withColumn("snr_threshold", F.lit(float(threshold)))
    within = F.filter(F.arrays_zip(F.col("snr_freq").alias("f"), F.col("snr").alias("s")), lambda z: (z["f"] >= F.col("snr_min_freq")) & (z["f"] <= F.col("snr_max_freq")))
    unknown = F.exists(within, lambda z: F.isnan(z["s"]))
    least = F.coalesce(F.array_min(F.transform(within, lambda z: z["s"])), F.lit(0.0))
    return failed(d, "snr_check", "Failed SNR check.", F.col("snr").isNotNull() & ~unknown & (least < threshold))


# ---- corners ---------------------------------------------------------------------------------------------------


def snr_corners(freq: np.ndarray, snr: np.ndarray, threshold: float, least: float, most: float) -> tuple[float, float] | str:
    """The last band above threshold that begins at least or before and ends beyond most."""
    with np.errstate(invalid="ignore"):
        turn = np.nan_to_num(np.diff(np.sign(snr - threshold)))
    lows, highs = [*freq[np.flatnonzero(turn > 0) + 1]], [*freq[np.flatnonzero(turn < 0)]]
    known = snr[~np.isnan(snr)]
    if len(known) and known[0] > threshold:
        lows = [freq[0], *lows]
    if not lows:
        return "SNR not greater than required threshold."
    if len(lows) > len(highs):
        highs = [*highs, freq.max()]
    valid = [(lo, hi) for lo, hi in zip(lows, highs) if lo <= least and hi > most]
    return (float(valid[-1][0]), float(valid[-1][1])) if valid else "SNR not met within the required bandwidth."


def corners_from_snr(d: DataFrame, same_horizontals: bool = True, keys: list[str] = ("record_id",)) -> DataFrame:
    """d with highpass and lowpass, no lower than 1 / signal_end and 1 / the noise window; fails passed traces without such a band.

    same_horizontals: the horizontal traces of a record share the least lowpass and the largest highpass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for f, s, t, lo, hi in zip(*(b.column(c).to_pylist() for c in ("snr_freq", "snr", "snr_threshold", "snr_min_freq", "snr_max_freq"))):
                got = "Cannot use SNR to pick corners because SNR could not be calculated." if s is None else snr_corners(np.array(f), np.array(s, dtype=float), t, lo, hi)
                rows.append((None, None, got) if isinstance(got, str) else (*got, None))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.float64(), pa.float64(), pa.string())))], [*b.schema.names, "highpass", "lowpass", "_why"])

    d = d.drop("highpass", "lowpass")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema] + ["highpass double", "lowpass double", "_why string"])
    out = d.mapInArrow(run, schema)
    noise = F.floor(F.col("split") * F.col("sampling_rate")) + 1
    out = out.withColumn("highpass", F.when(F.col("highpass").isNotNull(), F.greatest("highpass", 1 / F.col("signal_end"), F.col("sampling_rate") / noise)))
    out = failed(out, "get_corner_frequencies", F.col("_why"), F.col("_why").isNotNull()).drop("_why")
    return shared_corners(out, keys) if same_horizontals else out


def shared_corners(d: DataFrame, keys: list[str]) -> DataFrame:
    flat = F.col("component") != "Z"
    w = Window.partitionBy(*keys)
    hp, lp = F.max(F.when(flat, F.col("highpass"))).over(w), F.min(F.when(flat, F.col("lowpass"))).over(w)
    d = d.withColumn("_h", hp).withColumn("_l", lp)
    return d.withColumn("highpass", F.when(flat, F.col("_h")).otherwise(F.col("highpass"))).withColumn("lowpass", F.when(flat, F.col("_l")).otherwise(F.col("lowpass"))).drop("_h", "_l")


def constant_corners(d: DataFrame, highpass: float = 0.08, lowpass: float = 20.0) -> DataFrame:
    return d.withColumn("highpass", F.lit(float(highpass))).withColumn("lowpass", F.lit(float(lowpass)))


def magnitude_corners(d: DataFrame, minmag=(-999.0, 3.5, 5.5), highpass=(0.5, 0.3, 0.1), lowpass=(25.0, 35.0, 40.0)) -> DataFrame:
    """Corners of the last class whose magnitude is exceeded."""

    def pick(values) -> Column:
        out = F.lit(None).cast("double")
        for m, v in zip(minmag, values):
            out = F.when(F.col("magnitude") > m, float(v)).otherwise(out)
        return out

    return d.withColumn("highpass", pick(highpass)).withColumn("lowpass", pick(lowpass))


# ---- adaptive baseline -----------------------------------------------------------------------------------------


def quiet_mean(v: np.ndarray, dt: float, onset: float, corner: float, trailing: bool) -> float:
    """The mean of a leading window, or of a trailing one from its first zero crossing on."""
    n = int(round(max(onset, 1 / corner) / dt))
    if not trailing:
        return float(v[: n + 1].mean())
    tail = v[max(0, len(v) - 1 - n) :]
    cross = np.flatnonzero(tail[:-1] * tail[1:] < 0)
    return float(tail[cross[0] if len(cross) else 0 :].mean())


def trend(t: np.ndarray, v: np.ndarray, near: float = 1e-3) -> np.polynomial.Polynomial:
    """The line through v, or the parabola where it fits better by more than `near`."""
    fits = [np.polynomial.Polynomial.fit(t, v, k) for k in (1, 2)]
    rms = [float(np.sqrt(((v - f(t)) ** 2).mean())) for f in fits]
    return fits[0] if rms[0] - rms[1] < near else fits[1]


def adaptive_baseline(x: np.ndarray, dt: float, onset: float, corner: float, rounds: int = 100) -> np.ndarray:
    """x less the derivative of a velocity baseline in three parts: trends before the onset and after a second break, and a cubic between.

    The break is the one of `rounds` that leaves the least velocity residual.
    """
    from smframe.operators.waveform import integrate_td

    v, t = integrate_td(x, dt), np.arange(len(x)) * dt
    i = max(2, int(round(onset / dt)))
    first, last = i + int(np.ceil(1 / corner / dt)), len(x) - 1 - int(np.ceil(1 / corner / dt))
    if last <= first or len(x) - last < 4:
        return x
    head, best = trend(t[: i + 1], v[: i + 1]), None
    for j in np.unique(np.linspace(first, last, rounds).round().astype(int)):
        tail = trend(t[j:], v[j:])
        h = t[j] - t[i]
        u = (t[i : j + 1] - t[i]) / h
        a, b, c, d = head(t[i]), tail(t[j]), head.deriv()(t[i]) * h, tail.deriv()(t[j]) * h
        mid = a * (1 + 2 * u) * (1 - u) ** 2 + c * u * (1 - u) ** 2 + b * u * u * (3 - 2 * u) + d * u * u * (u - 1)
        base = np.concatenate((head(t[:i]), mid, tail(t[j + 1 :])))
        r = v - base
        loss = sum(float((part**2).mean()) for part in (r[: i + 1], r[i + 1 : j], r[j:]) if len(part))
        if best is None or loss < best[0]:
            best = (loss, base)
    return x - np.gradient(best[1], dt)


def drift_means(d: DataFrame) -> DataFrame:
    """d with lead_vel, trail_vel and trail_dis: means of velocity and displacement where the ground should be at rest. Needs split and highpass."""
    from smframe.operators.waveform import integrate_td

    names = ["lead_vel", "trail_vel", "trail_dis"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, (rate, split, corner) in enumerate(zip(*(b.column(c).to_pylist() for c in ("sampling_rate", "split", "highpass")))):
                x = samples_of(b.column("x"), k)
                if x is None or not len(x) or not rate or split is None or not corner:
                    rows.append((None, None, None))
                    continue
                v = integrate_td(x, 1 / rate)
                s = integrate_td(v, 1 / rate)
                rows.append((quiet_mean(v, 1 / rate, split, corner, False), quiet_mean(v, 1 / rate, split, corner, True), quiet_mean(s, 1 / rate, split, corner, True)))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([r[k] for r in rows], pa.float64()) for k in range(3))], [*b.schema.names, *names])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema] + [f"{n} double" for n in names])
    return d.mapInArrow(run, schema)


def rest_criteria(d: DataFrame, lead: float = 0.1, trail: float = 0.1, displacement: float = 0.1) -> DataFrame:
    """Fails traces that aren't at rest before and after the motion."""
    d = drift_means(d)
    bad = (F.abs("lead_vel") > lead) | (F.abs("trail_vel") > trail) | (F.abs("trail_dis") > displacement)
    return failed(d, "prism_quality_criteria", "Failed PRISM quality criteria.", bad).drop("lead_vel", "trail_vel", "trail_dis")


def tail_ratios(df: DataFrame, seconds: float, dt: float | None = None, frequency: bool = True) -> DataFrame:
    """df with vel_ratio and dis_ratio: the peak of the last seconds over that of the whole, of velocity and displacement."""
    from smframe.operators.waveform import integrate_fd, integrate_td

    integral = integrate_fd if frequency else integrate_td

    def ratio(x: np.ndarray, t: float, times: int) -> float | None:
        for _ in range(times):
            x = integral(x, t)
        top = np.abs(x).max()
        return float(np.abs(x[max(0, len(x) - 1 - int(round(seconds / t))) :]).max() / top) if top > 0 else None

    return measured(df, dt, vel_ratio=lambda x, t: ratio(x, t, 1), dis_ratio=lambda x, t: ratio(x, t, 2))
