"""The processing plan: an ordered list of named steps over traces, each an expression, a gate or an Arrow transform.

A step takes (traces, options) and returns traces. Failed traces keep their rows: a gate keeps the first failure, and
steps leave the samples of failed traces alone, but for cut. Each trace is handled at its own sampling rate. Catalyst
fuses consecutive expression steps into one stage; what a record's traces share is a window over the record.

Columns of traces: x, sampling_rate; by step also record_id and component, magnitude, dist_km, origin (event time), arrival
(travel-time pick), units_type, structure, channel, sensitivity, response_rate, poles, zeros, review. Times are seconds after
the first sample. Steps add split, signal_end, snr_freq, snr, highpass, lowpass and others for later ones.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from smframe.functions import arrays, physics
from smframe.operators import clipping, corners, filters, record_quality, source, windows
from smframe.operators import relational as r
from smframe.operators import waveform as w

Step = Callable[..., DataFrame]
STEPS: dict[str, Step] = {}
FAILURE = "struct<module:string,reason:string>"


def step(f: Step) -> Step:
    """Registers a processing step under its function's name; users register their own the same way."""
    if f.__name__ in STEPS:
        raise ValueError(f"step {f.__name__} exists already")
    STEPS[f.__name__] = f
    return f


def replaced(d: DataFrame, x: Column) -> DataFrame:
    """d with the samples of traces that haven't failed replaced."""
    return d.withColumn("x", F.when(F.col("failure").isNull(), x).otherwise(F.col("x")))


def in_place(d: DataFrame, kernel: Callable[..., np.ndarray], columns: tuple[str, ...] = ()) -> DataFrame:
    """d with x replaced by kernel(x, dt, *columns) where the trace hasn't failed, isn't null or empty, and has a rate and all columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("x")
            xs, failure, out = b.column("x"), b.column("failure"), []
            for i, values in enumerate(zip(b.column("sampling_rate").to_pylist(), *(b.column(c).to_pylist() for c in columns))):
                x = w.samples_of(xs, i)
                skip = failure[i].is_valid or x is None or not len(x) or None in values or not values[0]
                out.append(x if skip else kernel(x, 1 / values[0], *values[1:]))
            yield b.set_column(at, "x", pa.array(out, pa.list_(pa.float64())))

    return d.withColumn("x", F.col("x").cast("array<double>")).mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.withColumn("x", F.col("x").cast("array<double>")).schema))


# ---- gates -----------------------------------------------------------------------------------------------------


@step
def check_free_field(d: DataFrame, reject_non_free_field: bool = True) -> DataFrame:
    return r.failed(d, "check_free_field", "not free field", ~physics.free_field(F.col("structure"))) if reject_non_free_field else d


@step
def check_instrument(d: DataFrame, keys=("record_id",), n_max: int = 3, n_min: int = 2, require_two_horiz: bool = True) -> DataFrame:
    return r.check_instrument(d, [*keys], n_max, n_min, require_two_horiz)


@step
def max_traces(d: DataFrame, n_max: int = 3, keys=("record_id",)) -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return r.failed(d.withColumn("_n", n), "max_traces", "more traces than allowed", F.col("_n") > n_max).drop("_n")


@step
def min_sample_rate(d: DataFrame, least: float = 20.0) -> DataFrame:
    return r.failed(d, "min_sample_rate", "sample rate too low", F.col("sampling_rate") < least)


@step
def check_max_amplitude(d: DataFrame, least: float = 5.0, most: float = 2e6) -> DataFrame:
    """Raw traces (counts) only; others, where units_type is known, pass."""
    peak = arrays.max_abs(F.col("x"))
    bad = (peak < least) | (peak > most)
    return r.failed(d, "check_max_amplitude", "amplitude out of range", bad & F.coalesce(F.col("units_type") == "counts", F.lit(True)) if "units_type" in d.columns else bad)


@step
def check_sta_lta(d: DataFrame, sta_length: float = 1.0, lta_length: float = 20.0, threshold: float = 5.0) -> DataFrame:
    """The largest ratio of trailing means of squares over sta_length and lta_length; traces shorter than that fail."""

    def most(x: np.ndarray, dt: float) -> float | None:
        short, long = int(round(sta_length / dt)), int(round(lta_length / dt))
        if len(x) < long or not short:
            return None
        c = np.concatenate(([0.0], np.cumsum(x * x)))
        end = np.arange(long, len(x) + 1)
        lta = (c[end] - c[end - long]) / long
        sta = (c[end] - c[end - short]) / short
        return float(np.max(np.divide(sta, lta, out=np.zeros_like(sta), where=lta > 0)))

    d = w.measured(d, None, _ratio=most)
    reason = F.when(F.col("_ratio").isNull(), "record shorter than the long window").otherwise("STA/LTA below threshold")
    return r.failed(d, "check_sta_lta", reason, F.col("_ratio").isNull() | (F.col("_ratio") < threshold)).drop("_ratio")


@step
def check_zero_crossings(d: DataFrame, least: float = 0.1) -> DataFrame:
    """Crossings a second of the whole trace, counted from split to signal_end where these are known."""
    x = F.col("x")
    if {"split", "signal_end"} <= {*d.columns}:
        at = lambda c: F.round(F.col(c) * F.col("sampling_rate")).cast("int")
        x = F.when(F.col("split").isNotNull() & F.col("signal_end").isNotNull(), F.slice("x", at("split") + 1, F.greatest(at("signal_end") - at("split"), F.lit(0)))).otherwise(x)
    rate = arrays.zero_crossings(x) * F.col("sampling_rate") / F.size("x")
    return r.failed(d, "check_zero_crossings", "too few zero crossings", rate <= least)


@step
def check_tail(d: DataFrame, duration: float = 5.0, max_vel_ratio: float = 0.3, max_dis_ratio: float = 0.9, frequency: bool = True) -> DataFrame:
    """Fails traces whose velocity or displacement is still large at the end (displacement's reason where both are)."""
    d = windows.tail_ratios(d, duration, None, frequency)
    reason = F.when(F.col("dis_ratio") > max_dis_ratio, F.lit(f"Displacement ratio is greater than {max_dis_ratio}")).when(F.col("vel_ratio") > max_vel_ratio, F.lit(f"Velocity ratio is greater than {max_vel_ratio}"))
    return r.failed(d, "check_tail", reason, reason.isNotNull()).drop("vel_ratio", "dis_ratio")


@step
def check_clipping(d: DataFrame, weights: dict, threshold: float = 0.2, key: str = "record_id") -> DataFrame:
    """Fails every trace of a record that the network takes as clipped. weights: of clipping.network()."""
    ids = d.withColumn("_row", F.col(key))
    found = clipping.detectors(ids, [key, "sampling_rate"])
    p = clipping.record_probability(found, d.select(key, "magnitude", "dist_km").dropDuplicates([key]), key, weights)
    return r.failed(d.join(p, key, "left"), "check_clipping", "Failed clipping check.", F.col("probability") >= threshold).withColumnRenamed("probability", "clipping_probability")


@step
def prism_quality_criteria(d: DataFrame, lead_vel_threshold: float = 0.1, trail_vel_threshold: float = 0.1, trail_dis_threshold: float = 0.1) -> DataFrame:
    return windows.rest_criteria(d, lead_vel_threshold, trail_vel_threshold, trail_dis_threshold)


# ---- windows, noise, corners -----------------------------------------------------------------------------------


@step
def signal_split(d: DataFrame, keys=("record_id",), **options) -> DataFrame:
    return windows.signal_split(d, [*keys], **options)


@step
def signal_end(d: DataFrame, **options) -> DataFrame:
    return windows.signal_end(d, **options)


@step
def window_checks(d: DataFrame, min_noise_duration: float = 0.5, min_signal_duration: float = 5.0) -> DataFrame:
    return windows.window_checks(d, min_noise_duration, min_signal_duration)


@step
def compute_snr(d: DataFrame, smoothing_parameter: float = 20.0) -> DataFrame:
    return windows.compute_snr(d, smoothing_parameter)


@step
def snr_check(d: DataFrame, threshold: float = 2.0, min_freq: float | str = "f0", max_freq: float = 5.0, f0_options: dict | None = None) -> DataFrame:
    return windows.snr_check(d, threshold, min_freq, max_freq, **(f0_options or {}))


@step
def get_corner_frequencies(d: DataFrame, method: str = "snr", constant: dict | None = None, magnitude: dict | None = None, snr: dict | None = None, keys=("record_id",)) -> DataFrame:
    """Column review, a struct of highpass and lowpass, replaces the corners that it holds."""
    kinds = {"constant": lambda: windows.constant_corners(d, **(constant or {})), "magnitude": lambda: windows.magnitude_corners(d, **(magnitude or {})), "snr": lambda: windows.corners_from_snr(d, (snr or {}).get("same_horiz", True), [*keys])}
    if method not in kinds:
        raise ValueError(f"corner frequency method must be one of {sorted(kinds)}, not {method}")
    out = kinds[method]()
    if "review" in d.columns:
        for c in ("highpass", "lowpass"):
            out = out.withColumn(c, F.coalesce(F.col(f"review.{c}"), F.col(c)))
    return out


@step
def lowpass_max_frequency(d: DataFrame, fn_fac: float = 0.75, lp_max: float = 40.0) -> DataFrame:
    capped = F.least(F.col("lowpass"), fn_fac * 0.5 * F.col("sampling_rate"), F.lit(lp_max))
    return d.withColumn("lowpass", F.when(F.col("review.lowpass").isNotNull(), F.col("lowpass")).otherwise(capped) if "review" in d.columns else capped)


@step
def adjust_highpass_corner(d: DataFrame, step_factor: float = 1.5, maximum_freq: float = 0.5, max_final_displacement: float = 0.025, max_displacement_ratio: float = 0.2) -> DataFrame:
    return corner_step(d, "adjust_highpass_corner", "corner above the largest allowed", lambda x, t, lo, hi: corners.raised_corner(x, t, lo, hi, step_factor, maximum_freq, max_final_displacement, max_displacement_ratio), ("highpass", "lowpass"))


@step
def ridder_fchp(d: DataFrame, target: float = 0.02, tol: float = 0.001, maxiter: int = 30, maxfc: float = 0.5, same_horiz: bool = True, order: int = 3, keys=("record_id",)) -> DataFrame:
    """The larger of the corner and the one whose fitted drift meets target."""
    d = corner_step(d, "ridder_fchp", "no corner below the largest allowed", lambda x, t, lo: None if (f := corners.ridder_corner(x, t, target, tol, maxiter, 0.001, maxfc, order)) is None else max(f, lo), ("highpass",))
    return windows.shared_corners(d, [*keys]) if same_horiz else d


def corner_step(d: DataFrame, module: str, reason: str, search, columns: tuple[str, ...]) -> DataFrame:
    """highpass replaced by what search(x, dt, *columns) finds; passed traces for which it finds nothing fail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, values in enumerate(zip(b.column("sampling_rate").to_pylist(), *(b.column(c).to_pylist() for c in columns))):
                x = w.samples_of(b.column("x"), i)
                skip = b.column("failure")[i].is_valid or x is None or not len(x) or not values[0] or values[1] is None
                out.append(None if skip else search(x, 1 / values[0], *values[1:]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], [*b.schema.names, "_f"])

    d = d.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema] + ["_f double"]))
    was = F.col("highpass").isNotNull() & (F.size("x") > 0) & (F.col("sampling_rate") > 0)
    d = r.failed(d, module, reason, F.col("_f").isNull() & was)
    return d.withColumn("highpass", F.coalesce("_f", "highpass")).drop("_f")


# ---- transforms ------------------------------------------------------------------------------------------------


def polynomial(order: int):
    def kernel(x: np.ndarray, dt: float) -> np.ndarray:
        t = np.arange(len(x))
        return x - np.polynomial.Polynomial.fit(t, x, min(order, len(x) - 1))(t)

    return kernel


@step
def detrend(d: DataFrame, method: str = "linear", order: int = 2) -> DataFrame:
    """linear, demean (constant), simple, pre (the mean before split), polynomial of the given order, or baseline_sixth_order."""
    split = F.floor(F.col("split") * F.col("sampling_rate")).cast("int") if "split" in d.columns else F.lit(-1)
    kinds = {
        "linear": lambda: replaced(d, arrays.detrend_linear(F.col("x"))), "demean": lambda: replaced(d, arrays.demean(F.col("x"))), "constant": lambda: replaced(d, arrays.demean(F.col("x"))), "simple": lambda: replaced(d, arrays.detrend_simple(F.col("x"))),
        "pre": lambda: replaced(d, arrays.demean_before(F.col("x"), split)), "polynomial": lambda: in_place(d, polynomial(order)), "baseline_sixth_order": lambda: in_place(d, corners.sixth_order),
    }
    if method not in kinds:
        raise ValueError(f"detrend method must be one of {sorted(kinds)}, not {method}")
    return kinds[method]()


@step
def taper(d: DataFrame, width: float = 0.05, side: str = "both") -> DataFrame:
    return replaced(d, arrays.taper_hann(F.col("x"), width, side))


@step
def cut(d: DataFrame, sec_before_split: float | None = 30.0, first: int | None = None, last: int | None = None) -> DataFrame:
    """From sec_before_split seconds before split to signal_end, or samples first to last, ends included where they exist; failed traces too."""
    if first is None and last is None:
        return windows.cut(d, sec_before_split)
    first = first or 0
    n = F.size("x") - first if last is None else F.least(F.size("x"), F.lit(last + 1)) - first
    return d.withColumn("x", F.slice("x", first + 1, F.greatest(n, F.lit(0))))


@step
def zero_pad(d: DataFrame, length: float | str = "fhp", order: int = 5, samples: int | None = None, keys=("record_id",)) -> DataFrame:
    """Zeros on both sides: samples, or length seconds, or for 'fhp' 0.75 * order over the record's least highpass (Converse and Brady, 1992). Column pad keeps their number."""
    if "pad" in d.columns:
        raise ValueError("traces are padded already")
    if samples is not None:
        n = F.lit(samples)
    elif length == "fhp":
        d = d.withColumn("_f", F.min("highpass").over(Window.partitionBy(*keys)))
        n = F.round(0.75 * order / F.col("_f") * F.col("sampling_rate")).cast("int")
    else:
        n = F.round(F.lit(float(length)) * F.col("sampling_rate")).cast("int")
    d = d.withColumn("pad", F.when(F.col("failure").isNull(), F.coalesce(n, F.lit(0))).otherwise(0)).drop("_f")
    return d.withColumn("x", arrays.zero_pad(F.col("x"), F.col("pad")))


@step
def strip_zero_pad(d: DataFrame) -> DataFrame:
    return d.withColumn("x", arrays.strip_pad(F.col("x"), F.col("pad"))).drop("pad")


def filter_step(d: DataFrame, module: str, low: str | float | None, high: str | float | None, order: int, passes: int, frequency_domain: bool) -> DataFrame:
    """Corners are columns or numbers. Traces whose units_type is known to be other than acc fail."""
    if passes not in (1, 2):
        raise ValueError("passes must be 1 or 2")
    if "units_type" in d.columns:
        d = r.failed(d, module, "units must be acceleration", F.col("units_type") != "acc")
    named = tuple(c for c in (low, high) if isinstance(c, str))

    def kernel(x: np.ndarray, dt: float, *values: float) -> np.ndarray:
        got = dict(zip(named, values))
        lo, hi = (got.get(c, c) if isinstance(c, str) else c for c in (low, high))
        if not frequency_domain:
            return filters.butterworth_td(x, dt, lo, hi, order, passes == 2)
        for _ in range(passes):
            x = w.butterworth_fd(x, dt, lo, hi, order)
        return x

    return in_place(d, kernel, named)


@step
def bandpass_filter(d: DataFrame, frequency_domain: bool = True, filter_order: int = 5, number_of_passes: int = 1, low="highpass", high="lowpass") -> DataFrame:
    return filter_step(d, "bandpass_filter", low, high, filter_order, number_of_passes, frequency_domain)


@step
def highpass_filter(d: DataFrame, frequency_domain: bool = True, filter_order: int = 5, number_of_passes: int = 1, low="highpass") -> DataFrame:
    return filter_step(d, "highpass_filter", low, None, filter_order, number_of_passes, frequency_domain)


@step
def lowpass_filter(d: DataFrame, frequency_domain: bool = True, filter_order: int = 5, number_of_passes: int = 1, high="lowpass") -> DataFrame:
    return filter_step(d, "lowpass_filter", None, high, filter_order, number_of_passes, frequency_domain)


@step
def bandstop_filter(d: DataFrame, **_) -> DataFrame:
    raise ValueError("a frequency-domain band stop is not defined: use high- and low-pass filters")


@step
def integrate(d: DataFrame, frequency: bool = True) -> DataFrame:
    return in_place(d, w.integrate_fd if frequency else w.integrate_td)


@step
def differentiate(d: DataFrame) -> DataFrame:
    return in_place(d, w.differentiate_fd)


@step
def convert_to_acceleration(d: DataFrame, taper: bool = True, width: float = 0.05) -> DataFrame:
    """Velocities are tapered, unless told not to, and differentiated; accelerations stay."""

    def kernel(x: np.ndarray, dt: float, kind: str) -> np.ndarray:
        return x if kind != "vel" else w.differentiate_fd(windows.hann_taper(x, width) if taper else x, dt)

    d = in_place(d, kernel, ("units_type",))
    return d.withColumn("units_type", F.when(F.col("failure").isNull() & (F.col("units_type") == "vel"), "acc").otherwise(F.col("units_type")))


@step
def pre_filter(d: DataFrame, lp_factor: float = 0.8, hp_freq: float = 0.05, corners: int = 20) -> DataFrame:
    """A band-pass from hp_freq to lp_factor times half the sampling rate, in the frequency domain."""
    return in_place(d, lambda x, dt: w.butterworth_fd(x, dt, hp_freq, lp_factor * 0.5 / dt, corners))


def response_of(freq: np.ndarray, poles: list[dict], zeros: list[dict]) -> np.ndarray:
    """The shape of a response, of gain 1 at 1 Hz, from poles and zeros in radians a second."""

    def shape(f: np.ndarray) -> np.ndarray:
        s = 2j * np.pi * f
        top = np.prod([s - complex(z["re"], z["im"]) for z in zeros], axis=0) if zeros else np.ones(len(f), complex)
        return top / (np.prod([s - complex(p["re"], p["im"]) for p in poles], axis=0) if poles else 1.0)

    return shape(freq) / abs(shape(np.array([1.0]))[0])


def cosine_band(freq: np.ndarray, f1: float, f2: float, f3: float, f4: float) -> np.ndarray:
    """1 from f2 to f3, 0 outside f1 to f4, half cosines between."""
    up = 0.5 * (1 - np.cos(np.pi * np.clip((freq - f1) / (f2 - f1), 0, 1)))
    return up * 0.5 * (1 + np.cos(np.pi * np.clip((freq - f3) / (f4 - f3), 0, 1)))


@step
def remove_response(d: DataFrame, output_as_acceleration: bool = True, custom_pre_filt: dict | None = None, water_level: float | None = 60.0, sensitivity_threshold: float = 10.0,
                    pre_filt: bool = True, f1: float = 0.001, f2: float = 0.005, f3: float | None = None, f4: float | None = None) -> DataFrame:
    """Counts to cm/s^2 (accelerometers, N) or cm/s (seismometers, H; accelerations if wished), by sensitivity and, where known, poles and zeros.

    Columns: channel, sensitivity (counts for m/s^2 or m/s), response_rate, poles and zeros (array<struct<re, im>>, null where
    unknown). Without them an accelerometer is divided by its sensitivity, a seismometer fails. The divisor's amplitude is at
    least water_level decibels below its largest. custom_pre_filt: options of pre_filter; without it, and unless pre_filt is false, the spectrum
    is held to a band of cosine flanks f1 to f2 and f3 to f4 (0.9 of half the sampling rate, and half of it).

    Column stage_sensitivity (the product of the stages), where known, is held against sensitivity: where they differ by more than
    sensitivity_threshold percent of their mean, an accelerometer is divided by its sensitivity alone, and a seismometer fails.
    """
    kind = F.substring("channel", 2, 1)
    for c, t in (("response_rate", "double"), ("poles", "array<struct<re:double,im:double>>"), ("zeros", "array<struct<re:double,im:double>>")):
        if c not in d.columns:
            d = d.withColumn(c, F.lit(None).cast(t))
    known = (F.size("poles") > 0) | (F.size("zeros") > 0)
    stage = F.col("stage_sensitivity") if "stage_sensitivity" in d.columns else F.lit(None).cast("double")
    differs = F.coalesce(200 * F.abs(F.col("sensitivity") - stage) > sensitivity_threshold * (F.col("sensitivity") + stage), F.lit(False))
    reason = (
        F.when(~kind.isin("N", "H"), "The instrument type is not supported.")
        .when(F.col("response_rate") != F.col("sampling_rate"), "Sample rate is not consistent between data and metadata")
        .when((kind == "H") & ~F.coalesce(known, F.lit(False)), "Instrument is a seismometer and does not have poles and zeros for response.")
        .when(F.col("sensitivity").isNull() | (F.col("sensitivity") == 0), "No sensitivity in the metadata")
        .when((kind == "H") & differs, "Total and stage sensitivity mismatch.")
    )
    d = r.failed(d, "remove_response", reason, reason.isNotNull())
    d = d.withColumn("_gain", 100 / F.col("sensitivity")).withColumn("_known", F.coalesce(known, F.lit(False)) & ~differs).withColumn("_vel", kind == "H")
    d = d.withColumn("_p", F.coalesce("poles", F.array().cast("array<struct<re:double,im:double>>"))).withColumn("_z", F.coalesce("zeros", F.array().cast("array<struct<re:double,im:double>>")))

    def kernel(x: np.ndarray, dt: float, gain: float, known: bool, vel: bool, poles: list, zeros: list) -> np.ndarray:
        y = x * gain
        if known:
            if custom_pre_filt:
                y = w.butterworth_fd(y, dt, custom_pre_filt["hp_freq"], custom_pre_filt["lp_factor"] * 0.5 / dt, custom_pre_filt["corners"])
            h = response_of(np.fft.rfftfreq(len(y), dt), poles, zeros)
            size = np.abs(h)
            if water_level is not None:
                floor = size.max() * 10 ** (-water_level / 20)
                h = np.where(size < floor, np.where(size > 0, h / np.where(size > 0, size, 1.0), 1.0) * floor, h)
            if pre_filt and not custom_pre_filt:
                freq, nyquist = np.fft.rfftfreq(len(y), dt), 0.5 / dt
                y = np.fft.irfft(np.fft.rfft(y) * cosine_band(freq, f1, f2, 0.9 * nyquist if f3 is None else f3, nyquist if f4 is None else f4), len(y))
            s = np.divide(np.fft.rfft(y), h, out=np.zeros(len(h), complex), where=np.abs(h) > 0)
            s[0] = 0.0
            y = np.fft.irfft(s, len(y))
        return w.differentiate_fd(windows.hann_taper(y), dt) if vel and output_as_acceleration else y

    d = in_place(d, kernel, ("_gain", "_known", "_vel", "_p", "_z"))
    out = F.when(F.col("_vel") & F.lit(not output_as_acceleration), "vel").otherwise("acc")
    before = F.col("units_type") if "units_type" in d.columns else F.lit(None).cast("string")
    d = d.withColumn("units_type", F.when(F.col("failure").isNull(), out).otherwise(before)).drop("_gain", "_known", "_vel", "_p", "_z")
    return r.failed(d, "remove_response", "Non-finite values encountered after removing instrument response.", F.exists("x", lambda v: F.isnan(v)))


@step
def resample(d: DataFrame, new_sampling_rate: float, a: int = 100) -> DataFrame:
    """Lanczos interpolation to another rate."""
    d = in_place(d, lambda x, dt: w.lanczos(x, dt, 1 / new_sampling_rate, a))
    return d.withColumn("sampling_rate", F.when(F.col("failure").isNull(), F.lit(float(new_sampling_rate))).otherwise(F.col("sampling_rate")))


@step
def prism_adaptive_baseline(d: DataFrame, n_iter: int = 100, lead_vel_threshold: float = 0.1, trail_vel_threshold: float = 0.1) -> DataFrame:
    """Traces whose velocity isn't at rest before and after the motion lose a baseline in three parts; others stay."""

    def kernel(x: np.ndarray, dt: float, split: float, corner: float) -> np.ndarray:
        v = w.integrate_td(x - x[: int(round(split / dt)) + 1].mean(), dt)
        moved = abs(windows.quiet_mean(v, dt, split, corner, False)) > lead_vel_threshold or abs(windows.quiet_mean(v, dt, split, corner, True)) > trail_vel_threshold
        return windows.adaptive_baseline(x, dt, split, corner, n_iter) if moved else x

    return in_place(d, kernel, ("split", "highpass"))


@step
def nnet_qa(d: DataFrame, weights: dict, acceptance_threshold: float = 0.5, model_name: str = "CantWell", keys=("record_id",)) -> DataFrame:
    """Needs what compute_snr gives, split and channel."""
    return record_quality.nnet_qa(d, weights, acceptance_threshold, model_name, [*keys])


@step
def fit_spectra(d: DataFrame, kappa: float = 0.035, moment_factor: float = 100.0, min_stress: float = 0.1, max_stress: float = 10_000.0) -> DataFrame:
    """A Brune spectrum's moment and stress drop, from the signal's smoothed spectrum within the corners; failed traces get none."""
    d = r.failed(d, "fit_spectra", "Unit type must be acc to fit spectra.", F.col("units_type") != "acc")
    known = d.withColumn("_spectrum", F.when(F.col("failure").isNull(), F.col("signal_spectrum")))
    return source.fit_spectra(known, kappa, moment_factor, min_stress, max_stress, spec="_spectrum").drop("_spectrum")


# ---- the interpreter -------------------------------------------------------------------------------------------


def run(traces: DataFrame, plan: list[dict]) -> DataFrame:
    """Applies a list of single-key dictionaries {step: options or None}.

    Column provenance lists the steps that each trace took, with their options as JSON; a failed trace takes no further ones.
    """
    d = traces if "failure" in traces.columns else traces.withColumn("failure", F.lit(None).cast(FAILURE))
    d = d.withColumn("provenance", F.array().cast("array<struct<step:string,options:string>>"))
    for entry in plan:
        if len(entry) != 1:
            raise ValueError(f"a step is one name with its options, not {entry}")
        (name, options), = entry.items()
        if name not in STEPS:
            raise ValueError(f"unknown processing step {name}")
        taken = F.struct(F.lit(name).alias("step"), F.lit(json.dumps({k: v for k, v in (options or {}).items() if k != "weights"}, sort_keys=True)).alias("options"))
        d = d.withColumn("provenance", F.when(F.col("failure").isNull(), F.array_append("provenance", taken)).otherwise(F.col("provenance")))
        d = STEPS[name](d, **(options or {}))
    return d.withColumn("process_level", F.lit("V2"))
