"""Fits of a source spectrum (Brune) with path and site terms to smoothed signal spectra.

Two parameters, the logarithms of moment and stress drop, within bounds, by least squares on logarithms of amplitude: a
damped Gauss-Newton iteration that runs for all traces of a batch at once and projects onto the bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from smframe.functions import physics as p

FIT = "struct<stress_drop:double,stress_drop_lnsd:double,epi_dist:double,kappa:double,moment:double,moment_lnsd:double,magnitude:double,f0:double,minimize_message:string,minimize_success:boolean,mean_squared_error:double,R2:double>"
DONE, LIMIT, FEW = "converged", "iteration limit", "too few frequencies"


def path_and_site(freq: np.ndarray, dist: np.ndarray, kappa: float) -> np.ndarray:
    """The logarithm of all that doesn't depend on the source; dist goes along the rows of freq."""
    spread = np.where(dist <= 40.0, -np.log(dist), -0.5 * np.log(dist * 40.0))
    loss = -np.pi * freq * dist / (180 * freq**0.45) / 3.5
    crust = np.interp(freq, p.CRUST_HZ, np.log(p.CRUST_GAIN))
    return spread + loss + crust - np.pi * kappa * freq


def source_level(freq: np.ndarray) -> np.ndarray:
    """The logarithm of a unit moment's acceleration spectrum below the corner, at 1 km."""
    return np.log(p.PARTITION * p.HORIZONTAL * p.SURFACE / (4 * np.pi * p.DENSITY * p.BETA**3) * 1e-20) + 2 * np.log(2 * np.pi * freq)


def fit(freq: np.ndarray, spec: np.ndarray, keep: np.ndarray, dist: np.ndarray, magnitude: np.ndarray, kappa: float, moment_factor: float, min_stress: float, max_stress: float, rounds: int = 100) -> dict[str, np.ndarray]:
    """Arrays of the fields of FIT for rows of spectra; keep marks the frequencies that count."""
    with np.errstate(divide="ignore", invalid="ignore"):
        fixed = np.where(keep, source_level(freq) + path_and_site(freq, dist[:, None], kappa), 0.0)
        y = np.where(keep, np.log(spec), 0.0)
    n = keep.sum(1)
    start = np.stack([np.log(10.0) * (1.5 * magnitude + 16.05), np.full(len(dist), 0.5 * np.log(min_stress * max_stress))], 1)
    low = np.stack([start[:, 0] - np.log(moment_factor), np.full(len(dist), np.log(min_stress))], 1)
    high = np.stack([start[:, 0] + np.log(moment_factor), np.full(len(dist), np.log(max_stress))], 1)
    corner = np.log(4.906e6 * p.BETA)

    def state(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Residuals and (f / f0) ** 2."""
        q = np.where(keep, (freq / np.exp(corner + (x[:, 1] - x[:, 0]) / 3)[:, None]) ** 2, 0.0)
        return np.where(keep, y - (fixed + x[:, :1] - np.log1p(q)), 0.0), q

    x, damping, ended = start.copy(), np.full(len(dist), 1e-3), n < 3
    r, q = state(x)
    cost = (r**2).sum(1)
    few = ended.copy()
    for _ in range(rounds):
        if ended.all():
            break
        turn = np.where(keep, 2 * q / (1 + q) / 3, 0.0)
        jm, js = np.where(keep, 1.0, 0.0) - turn, turn
        g = np.stack([(jm * r).sum(1), (js * r).sum(1)], 1)
        a, b, c = (jm * jm).sum(1), (jm * js).sum(1), (js * js).sum(1)
        # a parameter at a bound that would leave it stays there
        held = ((x <= low) & (g < 0)) | ((x >= high) & (g > 0))
        g = np.where(held, 0.0, g)
        b = np.where(held.any(1), 0.0, b)
        a, c = a * (1 + damping) + 1e-300, c * (1 + damping) + 1e-300
        det = a * c - b * b
        step = np.where(held, 0.0, np.stack([(c * g[:, 0] - b * g[:, 1]) / det, (a * g[:, 1] - b * g[:, 0]) / det], 1))
        new = np.clip(x + step, low, high)
        r2, q2 = state(new)
        cost2 = (r2**2).sum(1)
        better = (cost2 <= cost) & ~ended
        moved = np.abs(new - x).max(1)
        x = np.where(better[:, None], new, x)
        r, q, cost = np.where(better[:, None], r2, r), np.where(better[:, None], q2, q), np.where(better, cost2, cost)
        damping = np.where(better, damping / 5, damping * 4)
        ended |= (moved < 1e-10) & (better | (damping > 1e6))
    turn = np.where(keep, 2 * q / (1 + q) / 3, 0.0)
    jm, js = np.where(keep, 1.0, 0.0) - turn, turn
    a, b, c = (jm * jm).sum(1), (jm * js).sum(1), (js * js).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        s2 = cost / (n - 2)
        det = a * c - b * b
        sd = np.sqrt(np.stack([s2 * c / det, s2 * a / det], 1))
        moment, stress = np.exp(x[:, 0]), np.exp(x[:, 1])
        # goodness of fit over all frequencies of the spectrum
        known = np.isfinite(spec) & (freq > 0)
        model = np.where(known, np.exp(source_level(freq) + path_and_site(freq, dist[:, None], kappa) + x[:, :1] - np.log1p((freq / np.exp(corner + (x[:, 1] - x[:, 0]) / 3)[:, None]) ** 2)), 0.0)
        obs, m = np.where(known, spec, 0.0), np.maximum(1, known.sum(1))
        ssr = ((obs - model) ** 2).sum(1)
        sst = (np.where(known, obs - (obs.sum(1) / m)[:, None], 0.0) ** 2).sum(1)
    message = np.where(few, FEW, np.where(ended, DONE, LIMIT))
    return {
        "stress_drop": stress, "stress_drop_lnsd": sd[:, 1], "epi_dist": dist, "kappa": np.full(len(dist), kappa), "moment": moment, "moment_lnsd": sd[:, 0],
        "magnitude": 2 / 3 * (np.log10(moment) - 16.05), "f0": np.exp(corner + (x[:, 1] - x[:, 0]) / 3), "minimize_message": message, "minimize_success": ended & ~few,
        "mean_squared_error": ssr / m, "R2": 1 - np.divide(ssr, sst, out=np.full(len(ssr), np.nan), where=sst > 0),
    }


def fit_spectra(d: DataFrame, kappa: float = 0.035, moment_factor: float = 100.0, min_stress: float = 0.1, max_stress: float = 10_000.0, freq: str = "snr_freq", spec: str = "signal_spectrum") -> DataFrame:
    """d with fit_spectra, a struct: moment (dyne-cm), stress drop (bars), their logarithms' deviations, magnitude, corner and fit.

    Needs freq and spec (arrays), highpass and lowpass (which bound the frequencies that count), dist_km and magnitude (of
    the catalog: the start, within moment_factor of which the moment stays). Traces without one of them have none; of fewer
    than three frequencies nothing is fitted and minimize_success is false. Deviations don't know that neighbouring
    frequencies are smoothed together, so they are too small.
    """
    names = [x.split(":")[0] for x in FIT[7:-1].split(",")]
    kind = pa.struct([(x.split(":")[0], {"double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}[x.split(":")[1]]) for x in FIT[7:-1].split(",")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in (freq, spec, "highpass", "lowpass", "dist_km", "magnitude")]
            rows = [k for k, v in enumerate(zip(*cols)) if None not in v and len(v[0]) == len(v[1]) > 0 and v[4] > 0]
            out: list = [None] * batch.num_rows
            # traces of like size meet, so that no short one is padded to the length of the longest
            for size in {len(cols[0][k]).bit_length() for k in rows}:
                own = [k for k in rows if len(cols[0][k]).bit_length() == size]
                width = max(len(cols[0][k]) for k in own)
                f, s = np.ones((len(own), width)), np.full((len(own), width), np.nan)
                for i, k in enumerate(own):
                    f[i, : len(cols[0][k])], s[i, : len(cols[1][k])] = cols[0][k], np.array(cols[1][k], float)
                lo, hi, dist, mag = (np.array([cols[c][k] for k in own], float) for c in (2, 3, 4, 5))
                keep = (np.nan_to_num(s) > 0) & np.isfinite(s) & (f >= lo[:, None]) & (f <= hi[:, None]) & (f > 0)
                got = fit(f, s, keep, dist, mag, kappa, moment_factor, min_stress, max_stress)
                for i, k in enumerate(own):
                    ok = bool(got["minimize_message"][i] != FEW)
                    out[k] = {c: got[c][i].item() if ok or c in ("epi_dist", "kappa", "minimize_message", "minimize_success") else None for c in names}
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], [*batch.schema.names, "fit_spectra"])

    schema = ", ".join([f"`{x.name}` {x.dataType.simpleString()}" for x in d.schema] + [f"fit_spectra {FIT}"])
    return d.mapInArrow(run, schema)


#: The columns of the table of fits, in order.
FIT_COLUMNS = ("EarthquakeId EarthquakeTime EarthquakeLatitude EarthquakeLongitude EarthquakeDepth EarthquakeMagnitude EarthquakeMagnitudeType TraceID StationLatitude StationLongitude StationElevation "
               "fmin fmax epi_dist f0 kappa magnitude minimize_message minimize_success moment moment_lnsd stress_drop stress_drop_lnsd R2 mean_squared_error").split()  # fmt: skip


def fit_table(d: DataFrame, events: DataFrame, stations: DataFrame) -> DataFrame:
    """One row for each fitted trace of a record that passed, with the columns FIT_COLUMNS.

    d: event_id, network, station, location, channel, highpass, lowpass, failure and fit_spectra. events: event_id, time, latitude,
    longitude, depth_km, magnitude, magnitude_type. stations: network, station, latitude, longitude, elevation.
    """
    e = events.select("event_id", *(F.col(c).alias(f"Earthquake{n}") for c, n in (("time", "Time"), ("latitude", "Latitude"), ("longitude", "Longitude"), ("depth_km", "Depth"), ("magnitude", "Magnitude"), ("magnitude_type", "MagnitudeType"))))
    s = stations.select("network", "station", F.col("latitude").alias("StationLatitude"), F.col("longitude").alias("StationLongitude"), F.col("elevation").alias("StationElevation"))
    t = d.where("failure is null and fit_spectra is not null").join(e, "event_id").join(s, ["network", "station"], "left")
    fit_columns = [x.split(":")[0] for x in FIT[7:-1].split(",")]
    t = t.select(F.col("event_id").alias("EarthquakeId"), *(c for c in FIT_COLUMNS[1:7]), F.concat_ws(".", "network", "station", "location", "channel").alias("TraceID"), "StationLatitude", "StationLongitude", "StationElevation",
                 F.col("highpass").alias("fmin"), F.col("lowpass").alias("fmax"), *(F.col(f"fit_spectra.{c}").alias(c) for c in fit_columns))
    return t.select(FIT_COLUMNS)
