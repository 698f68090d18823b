"""The record check by a neural network (Bellagamba et al., 2019): twenty measures of a record's two horizontals, then three layers.

The measures are an Arrow pass over records, whose two horizontals meet in one grouping on the record's key. Deskewing, standardising,
decorrelating and the layers are expressions over the array of measures; their numbers are a parameter (see Weights), as the network is trained elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from smframe.functions.arrays import let
from smframe.operators.relational import failed

FEATURES = (
    "noise_low_ratio", "signal_low_ratio", "snr_min", "snr_max", "snr_mean", "tail", "tail_peak", "tail_noise", "tail_peak_noise", "head",
    "snr_low", "snr_half", "snr_one", "snr_two", "snr_five", "low_slope", "noise_peak", "bracketed", "ds575", "ds595",
)
#: The exponents that deskew each measure; log for a logarithm, a pair (factor, exponent) where there is a factor.
DESKEW = {
    "Cant": ("log", "log", -0.2, 0.12, 0.16, 0.48, 0.37, 0.25, 0.23, 0.05, -0.06, "log", 0.05, 0.08, 0.1, "log", "log", (-1.0, -1.2), 0.33, 0.43),
    "CantWell": ("log", "log", -0.2, 0.05, 0.05, 0.3, 0.37, 0.1, 0.23, 0.2, -0.06, "log", 0.05, 0.08, 0.05, "log", "log", (-1.0, -1.2), 0.33, 0.43),
}
G = 981.0
COLUMNS = ("x", "signal_spectrum", "noise_spectrum")


def features(a: list[np.ndarray], signal: list[np.ndarray], noise: list[np.ndarray], freq: np.ndarray, split: float, dt: float) -> list[float]:
    """The measures of two horizontals in cm/s^2, with smoothed spectra of signal and noise (NaN counts as 0) at freq; infinite or NaN where they don't exist."""
    a = [v / G for v in a]
    s, n = ([np.nan_to_num(v, nan=0.0) / G for v in w] for w in (signal, noise))
    size = [np.abs(v) for v in a]
    both = lambda f: float(np.sqrt(np.prod([f(v) for v in size])))
    seconds, before = (len(a[0]) - 1) * dt, int(split / dt)
    last = lambda most: max(1, int(min(most, 0.1 * seconds) / dt))
    with np.errstate(all="ignore"):
        peak = both(np.max)
        noise_peak, noise_mean = both(lambda v: v[:before].max(initial=0.0)), both(lambda v: v[:before].mean() if before else 0.0)
        tail, tail_peak, head = both(lambda v: v[-last(5.0) :].mean()) / peak, both(lambda v: v[-last(2.0) :].max()) / peak, both(lambda v: v[: max(1, int(1 / dt))].max()) / peak

        def bracket(share: float) -> float:
            def span(v: np.ndarray) -> float:
                at = np.flatnonzero(v >= share * v.max())
                return (at[-1] - at[0]) * dt

            return both(span)

        def until(share: float):
            """Seconds from 5 % of the energy to the share."""
            def span(v: np.ndarray) -> float:
                e = np.concatenate(([0.0], np.cumsum((v[1:] ** 2 + v[:-1] ** 2) / 2)))
                return (np.argmax(e / e[-1] > share) - np.argmax(e / e[-1] > 0.05)) * dt

            return both(span)

        level, quiet = np.sqrt(s[0] * s[1]) if (s[0] * s[1] >= 0).all() else np.sqrt(np.abs(s[0]) * np.abs(s[1])), np.sqrt(np.abs(n[0]) * np.abs(n[1]))
        ratio = level / quiet

        def ends(lo: float, hi: float) -> tuple[int, int]:
            """The first frequency above lo and the last one below hi."""
            return int(np.argmax(freq > lo)), len(freq) - 1 - int(np.argmax((freq < hi)[::-1]))

        def mean(y: np.ndarray, lo: float, hi: float) -> float:
            i, j = ends(lo, hi)
            return float(np.trapezoid(y[i:j], freq[i:j]) / (freq[j] - freq[i]))

        i, j = ends(0.1, 20.0)
        low = lambda y: float(np.trapezoid(y[:i], freq[:i]) / (freq[i] - freq[0]))
        return [
            max(low(n[k]) / s[k].max() for k in (0, 1)), max(low(s[k]) / s[k].max() for k in (0, 1)), float(ratio[i:j].min(initial=np.inf)), float(ratio.max()), mean(ratio, 0.1, 10.0),
            tail, tail_peak, tail / noise_mean, tail_peak / noise_peak, head,
            mean(ratio, 0.1, 0.5), mean(ratio, 0.5, 1.0), mean(ratio, 1.0, 2.0), mean(ratio, 2.0, 5.0), mean(ratio, 5.0, 10.0), mean(level, 0.1, 0.5) / mean(level, 0.5, 1.0),
            noise_peak / peak, bracket(0.1) / bracket(0.2), until(0.75), until(0.95),
        ]


def measured_records(d: DataFrame, keys: list[str]) -> DataFrame:
    """keys, features (array of 20, null where why isn't), and why, of every record.

    d: keys, channel, sampling_rate, split, snr_freq, x, signal_spectrum, noise_spectrum. Channels without a Z are horizontals, taken in order of channel.
    """
    horizontal = ~F.upper("channel").contains("Z")
    known = F.col("signal_spectrum").isNotNull() & F.col("noise_spectrum").isNotNull() & F.col("snr_freq").isNotNull() & F.col("split").isNotNull()
    own = F.struct("channel", "sampling_rate", "split", "snr_freq", *COLUMNS)
    # a record's traces are few
    g = d.groupBy(*keys).agg(
        F.count(F.when(horizontal, 1)).alias("_n"), F.max(~F.exists("x", lambda v: v != 0)).alias("_zero"), F.min(known).alias("_known"),
        F.slice(F.sort_array(F.collect_list(F.when(horizontal, own))), 1, 2).alias("_h"),
    )
    why = (
        F.when(F.col("_n") != 2, "Stream does not contain two horizontal components. NNet QA check will not be performed.")
        .when(F.coalesce("_zero", F.lit(True)), "The data contains all zeros, so the nnet_qa check is not able to be performed.")
        .when(~F.col("_known"), "One or more traces in the stream does have the required trace parameters to perform the nnet_qa check.")
    )
    g = g.select(*keys, F.when(why.isNull(), F.col("_h")).alias("_h"), why.alias("why"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for h in b.column("_h"):
                if not h.is_valid:
                    out.append(None)
                    continue
                get = lambda c: [np.array(h[k][c].as_py(), float) for k in (0, 1)]  # noqa: E731,B023
                x, s, n = map(get, COLUMNS)
                m = min(map(len, x))
                out.append(features([v[:m] for v in x], s, n, np.array(h[0]["snr_freq"].as_py()), h[0]["split"].as_py(), 1 / h[0]["sampling_rate"].as_py()) if m > 1 else [float("nan")] * 20)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(out, pa.list_(pa.float64())), b.column("why")], [*keys, "features", "why"])

    schema = ", ".join(f"`{k}` {g.schema[k].dataType.simpleString()}" for k in keys)
    return g.mapInArrow(run, f"{schema}, features array<double>, why string")


def times(matrix: list[list[float]], x: Column) -> Column:
    """A matrix (rows) with a vector, as an expression over arrays."""
    rows = F.expr(f"array({', '.join(f'array({", ".join(f"{float(v)!r}D" for v in r)})' for r in matrix)})")
    return F.transform(rows, lambda r: F.aggregate(F.zip_with(r, x, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))


def plus(x: Column, y: list[float]) -> Column:
    return F.zip_with(x, F.lit([float(v) for v in y]), lambda a, b: a + b)


def deskewed(x: Column, model: str) -> Column:
    out = []
    for k, power in enumerate(DESKEW[model]):
        v = F.get(x, F.lit(k))
        factor, power = power if isinstance(power, tuple) else (1.0, power)
        out.append(F.log(v) if power == "log" else factor * F.pow(v, F.lit(power)))
    return F.array(*out)


def scores(x: Column, model: str, weights: dict) -> Column:
    """The two outputs (low, high quality) for an array of measures.

    weights: mu, sigma, decorrelate (rows), and of each of three layers a pair (matrix: a row for each input, bias), all with logistic output.
    """
    def layer(columns: list[list[float]], bias: list[float]):
        return lambda v: F.transform(plus(times(columns, v), bias), lambda a: 1 / (1 + F.exp(-a)))

    x = plus(deskewed(x, model), [-m for m in weights["mu"]])
    x = F.zip_with(x, F.lit([float(s) for s in weights["sigma"]]), lambda a, s: a / s)
    x = let(x, lambda v: times(weights["decorrelate"], v))
    for matrix, bias in weights["layers"]:
        x = let(x, layer([[row[j] for row in matrix] for j in range(len(bias))], bias))
    return x


def nnet_qa(d: DataFrame, weights: dict, acceptance_threshold: float = 0.5, model: str = "CantWell", keys: list[str] = ("record_id",)) -> DataFrame:
    """d with score_hq, null where it can't be told; all traces of a record fail if it can't be or is below the threshold. A NaN score fails."""
    keys = [*keys]
    m = measured_records(d, keys)
    m = m.withColumn("score_hq", F.when(F.col("features").isNotNull(), F.get(scores(F.col("features"), model, weights), F.lit(1))))
    bad = F.coalesce(F.isnan("score_hq") | (F.col("score_hq") < acceptance_threshold), F.lit(False)) | (F.col("score_hq").isNull() & F.col("why").isNull())
    m = m.select(*(F.col(k).alias(f"_{k}") for k in keys), "score_hq", F.coalesce("why", F.when(bad, "Failed NNet QA check.")).alias("_why"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    out = d.join(m, on, "left")
    return failed(out, "nnet_qa", F.col("_why"), F.col("_why").isNotNull()).drop("_why", *(f"_{k}" for k in keys))
