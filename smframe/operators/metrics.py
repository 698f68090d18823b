"""The metric registry: every supported pair of component and measure, computed from traces into one long table.

Measures of single traces share one Arrow pass (samples, velocity, oscillators are computed once a trace); rotated ones
share one over horizontal pairs; means are aggregations of the long table. Each trace has its own sampling rate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from smframe.functions.physics import GAL_TO_PCTG
from smframe.operators import waveform as w
from smframe.operators.recurrence import two_states

SPECTRAL = ("sa", "psa", "sv", "psv", "sd")
SCALAR = ("pga", "pgv", "arias", "cav")
MEANS = ("pga", "pgv", "sa", "arias", "duration", "cav")
#: What each component supports.
REGISTRY = {
    "channels": (*SCALAR, "duration", *SPECTRAL, "fas"),
    "arithmetic_mean": MEANS,
    "geometric_mean": MEANS,
    "quadratic_mean": ("fas",),
    "rotd": ("pga", "pgv", *SPECTRAL),
}
KEYS = tuple(f"{c}-{m}" for c, ms in REGISTRY.items() for m in ms)


@dataclass(frozen=True)
class Options:
    """periods in s, damping as a share, intervals of duration in percent, frequencies of smoothed spectra, percentiles of rotation."""

    periods: tuple[float, ...] = (0.3, 1.0, 3.0)
    damping: float = 0.05
    intervals: tuple[tuple[int, int], ...] = ((5, 75), (5, 95))
    frequencies: tuple[float, ...] = field(default_factory=lambda: tuple(float(f) for f in np.logspace(-2, 2, 401)))
    bandwidth: float = 188.5
    percentiles: tuple[float, ...] = (50.0,)
    frequency_domain: bool = True


def upsampling(period: float, dt: float) -> int:
    """How much finer a trace must be sampled for an oscillator: so that a period has ten samples, as a power of two."""
    n = int(10 * dt / period - 0.01) + 1
    return 1 << (n - 1).bit_length() if n > 1 else 1


def finer(x: np.ndarray, times: int) -> np.ndarray:
    """Band-limited interpolation by zeros behind the spectrum, whose upper edge is tapered over two per cent."""
    if times == 1:
        return x
    s = np.fft.rfft(x)
    k = max(1, int(0.02 * len(s)))
    s[-k:] *= 0.5 * (1 + np.cos(np.pi * np.arange(1, k + 1) / k))
    return np.fft.irfft(s, len(x) * times) * times


def oscillate(x: np.ndarray, dt: float, period: float, damping: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Displacement, velocity (relative) and total acceleration of an oscillator under rows of x, from rest."""
    times = upsampling(period, dt)
    y = np.stack([finer(r, times) for r in x])
    a11, a12, a21, a22, b11, b12, b21, b22 = w.oscillator_step(period, damping, dt / times)
    om = 2 * np.pi / period
    f = [np.zeros_like(y), np.zeros_like(y)]
    for g, b0, b1 in ((f[0], b11, b12), (f[1], b21, b22)):
        g[:, 1:] = b0 * y[:, :-1] + b1 * y[:, 1:]
    d, v = two_states(np.array([[a11, a12], [a21, a22]]), f)
    return d, v, -(2 * damping * om * v + om * om * d)


def spectral_name(kind: str, period: float, damping: float) -> str:
    return f"{kind.upper()}(T={period:.4f}, D={100 * damping:.3f})"


def spectral_values(peaks: tuple[float, float, float], period: float) -> dict[str, float]:
    """From peak displacement, velocity and total acceleration (cm, s); accelerations in %g."""
    d, v, a = peaks
    om = 2 * np.pi / period
    return {"sd": d, "sv": v, "sa": a * GAL_TO_PCTG, "psv": om * d, "psa": om * om * d * GAL_TO_PCTG}


def channel_values(x: np.ndarray, dt: float, wanted: set[str], o: Options) -> Iterator[tuple[str, float | None]]:
    """(identifier, value) of the wanted measures of one trace of acceleration in cm/s^2."""
    if "pga" in wanted:
        yield "PGA", float(np.abs(x).max()) * GAL_TO_PCTG
    if "pgv" in wanted:
        yield "PGV", float(np.abs((w.integrate_fd if o.frequency_domain else w.integrate_td)(x, dt)).max())
    if "arias" in wanted:
        yield "Arias", float(w.integrate_td((x * w.CM) ** 2, dt)[-1] * np.pi * GAL_TO_PCTG / 2)
    if "cav" in wanted:
        yield "CAV", float(w.integrate_td(np.abs(x) * w.CM * GAL_TO_PCTG, dt)[-1])
    if "duration" in wanted:
        for lo, hi in o.intervals:
            yield f"Duration({lo}-{hi})", w.duration(x, dt, lo / 100, hi / 100)
    if kinds := [k for k in SPECTRAL if k in wanted]:
        for p in o.periods:
            got = spectral_values(tuple(float(np.abs(y).max()) for y in oscillate(x[None, :], dt, p, o.damping)), p)
            yield from ((spectral_name(k, p, o.damping), got[k]) for k in kinds)
    if "fas" in wanted:
        n = 1 << max(0, len(x) - 1).bit_length()
        s = w.konno_ohmachi(w.amplitude(x, dt, n), np.fft.rfftfreq(n, dt), np.array(o.frequencies), o.bandwidth)
        yield from ((f"FAS(f={f:.6f})", None if np.isnan(v) else float(v)) for f, v in zip(o.frequencies, s))


def rotated_values(x: np.ndarray, y: np.ndarray, dt: float, wanted: set[str], o: Options) -> Iterator[tuple[str, np.ndarray]]:
    """(identifier, peaks at 0 to 180 degrees) of the wanted measures of two horizontal traces."""
    theta = np.deg2rad(np.arange(181))
    turn = np.stack((np.cos(theta), np.sin(theta)), axis=1)

    def peaks(xy: np.ndarray) -> np.ndarray:
        top = np.zeros(181)
        for k in range(0, xy.shape[1], 8192):
            top = np.maximum(top, np.abs(turn @ xy[:, k : k + 8192]).max(1))
        return top

    xy = np.stack((x, y))
    if "pga" in wanted:
        yield "PGA", peaks(xy) * GAL_TO_PCTG
    if "pgv" in wanted:
        yield "PGV", peaks(np.stack([(w.integrate_fd if o.frequency_domain else w.integrate_td)(r, dt) for r in xy]))
    if kinds := [k for k in SPECTRAL if k in wanted]:
        for p in o.periods:
            # the oscillator is linear: the responses of both traces are rotated, which equals responses to rotated traces
            d, v, a = (peaks(r) for r in oscillate(xy, dt, p, o.damping))
            got = spectral_values((d, v, a), p)
            yield from ((spectral_name(k, p, o.damping), got[k]) for k in kinds)


def long_pass(df: DataFrame, columns: list[str], key: str, schema: str, rows) -> DataFrame:
    """key and what rows(arrays, dt) yields for each row of df with all columns, a rate and samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        for b in batches:
            at, out = [], []
            for i, rate in enumerate(b.column("sampling_rate").to_pylist()):
                xs = [w.samples_of(b.column(c), i) for c in columns]
                if not rate or any(x is None or not len(x) for x in xs):
                    continue
                got = [*rows(xs, 1 / rate)]
                at += [i] * len(got)
                out += got
            if out:
                keep = [c for c in b.schema.names if c not in (*columns, "sampling_rate")]
                part = b.select(keep).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c) for c in zip(*out))], [*keep, *names])

    keep = [f for f in df.schema if f.name not in (*columns, "sampling_rate")]
    return df.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), schema]))


def compute(traces: DataFrame, wanted: list[str], key: str = "record_id", options: Options = Options()) -> DataFrame:
    """key, imc, imt, result: the wanted pairs 'component-measure' of KEYS, for records of which no trace has failed.

    traces: key, component (H1, H2, Z), sampling_rate, x in cm/s^2, and failure where there may be failures.
    Means are over all of a record's traces, the vertical too; rotated measures need both horizontals, of equal rate and length.
    """
    if unknown := [k for k in wanted if k not in KEYS]:
        raise ValueError(f"unsupported metrics: {unknown}")
    of = {c: {k.split("-")[1] for k in wanted if k.startswith(c + "-")} for c in REGISTRY}
    d = traces
    if "failure" in traces.columns:
        bad = traces.where(F.col("failure").isNotNull()).select(key).distinct()
        d = traces.join(bad, key, "left_anti")
    d = d.select(key, "component", "sampling_rate", "x")
    parts = []
    single = of["channels"] | of["arithmetic_mean"] | of["geometric_mean"] | of["quadratic_mean"]
    kind = lambda imt: F.lower(F.regexp_extract(imt, r"^[A-Za-z]+", 0))
    if single:
        each = long_pass(d, ["x"], key, "imt string, result double", lambda xs, dt: channel_values(xs[0], dt, single, options))
        if of["channels"]:
            parts.append(each.where(kind(F.col("imt")).isin(*of["channels"])).select(key, F.concat(F.lit("Channels(component="), "component", F.lit(")")).alias("imc"), "imt", "result"))
        means = {"arithmetic_mean": ("ArithmeticMean()", F.avg("result")), "geometric_mean": ("GeometricMean()", F.exp(F.avg(F.ln("result")))), "quadratic_mean": ("QuadraticMean()", F.sqrt(F.avg(F.col("result") * F.col("result"))))}
        for c, (name, how) in means.items():
            if of[c]:
                parts.append(each.where(kind(F.col("imt")).isin(*of[c])).groupBy(key, "imt").agg(how.alias("result")).select(key, F.lit(name).alias("imc"), "imt", "result"))
    if of["rotd"]:
        h = d.where("component <> 'Z'").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("component", "sampling_rate", "x"))).alias("h"))  # a record has a few traces
        at = lambda i, c: F.get("h", F.lit(i))[c]
        pair = h.where((F.size("h") == 2) & (at(0, "sampling_rate") == at(1, "sampling_rate")) & (F.size(at(0, "x")) == F.size(at(1, "x"))))
        pair = pair.select(key, at(0, "sampling_rate").alias("sampling_rate"), at(0, "x").alias("x1"), at(1, "x").alias("x2"))

        def rotated(xs, dt):
            for imt, top in rotated_values(*xs, dt, of["rotd"], options):
                for p in options.percentiles:
                    yield f"RotD(percentile={p:.1f})", imt, float(np.percentile(top, p))

        parts.append(long_pass(pair, ["x1", "x2"], key, "imc string, imt string, result double", rotated).select(key, "imc", "imt", "result"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def select(metrics: DataFrame, imt: str, **attributes: str) -> DataFrame:
    """The rows of one measure whose identifier holds all attributes, as select(m, 'SA', T='1.0000')."""
    out = metrics.where(F.lower(F.regexp_extract("imt", r"^[A-Za-z]+", 0)) == imt.lower())
    for k, v in attributes.items():
        out = out.where(F.regexp_extract("imt", rf"[(, ]{k}=([^,)]+)", 1) == v)
    return out


def tables(metrics: DataFrame, key: str, imc: str, names: list[str]) -> DataFrame:
    """The wide table of one component: a column for each of the given identifiers."""
    from smframe.sources.tables import metric_table

    return metric_table(metrics.where(F.col("imc") == imc), [key], "imt", "result", names)
