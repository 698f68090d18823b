"""Baseline correction, and the search of high-pass corners on displacement, as Arrow batches over traces."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from smframe.operators.waveform import butterworth_fd, integrate_fd, integrate_td, mapped, measured


def displacement(x: np.ndarray, dt: float, frequency: bool = True) -> np.ndarray:
    integral = integrate_fd if frequency else integrate_td
    return integral(integral(x, dt), dt)


def sixth_order(x: np.ndarray, dt: float, frequency: bool = True) -> np.ndarray:
    """x less the second derivative of a t^6 + ... + e t^2 fitted to its displacement.

    The fitted drift starts at rest, as displacement in the time domain does; a frequency-domain one is periodic, so there
    the corrected trace's displacement need not be smaller.
    """
    t = np.arange(len(x)) * dt
    scale = max(t[-1], dt)
    u = t / scale  # keeps the fit well conditioned
    powers = np.arange(2, 7)
    c, *_ = np.linalg.lstsq(u[:, None] ** powers, displacement(x, dt, frequency), rcond=None)
    return x - ((powers * (powers - 1) * c) * u[:, None] ** (powers - 2)).sum(1) / scale**2


def raised_corner(x: np.ndarray, dt: float, low: float, high: float | None, factor: float = 1.5, most: float = 0.5, final: float = 0.025, share: float = 0.2) -> float | None:
    """The first of low, low * factor, ... at which the filtered, baseline-corrected displacement ends small; None above `most`."""
    while low <= most:
        d = np.abs(displacement(sixth_order(butterworth_fd(x, dt, low, high), dt), dt))
        if d[-1] <= final and (d.max() == 0 or d[-1] / d.max() <= share):
            return low
        low *= factor
    return None


def drift(x: np.ndarray, dt: float, corner: float, order: int = 3) -> float:
    """The largest value of a polynomial fitted to the displacement above corner, over its peak."""
    d = displacement(butterworth_fd(x, dt, corner, None), dt)
    t = np.linspace(-1, 1, len(d))
    peak = np.abs(d).max()
    return float(np.abs(np.polynomial.chebyshev.Chebyshev.fit(t, d, order)(t)).max() / peak) if peak > 0 else 0.0


def ridder_corner(x: np.ndarray, dt: float, target: float = 0.02, tolerance: float = 0.001, rounds: int = 30, least: float = 0.001, most: float = 0.5, order: int = 3) -> float | None:
    """The corner at which drift() meets target, by Ridder's root search between least and most; None where it stays above target."""
    g = lambda f: drift(x, dt, f, order) - target
    a, b = least, most
    ga, gb = g(a), g(b)
    if ga <= 0:
        return a
    if gb > 0:
        return None
    for _ in range(rounds):
        m = (a + b) / 2
        gm = g(m)
        root = np.sqrt(gm * gm - ga * gb)
        if root == 0:
            return m
        f = m + (m - a) * (1 if ga >= gb else -1) * gm / root
        gf = g(f)
        if abs(gf) <= tolerance or b - a < 1e-9:
            return float(f)
        if gm * gf < 0:
            (a, ga), (b, gb) = sorted(((m, gm), (f, gf)))
        elif ga * gf < 0:
            b, gb = f, gf
        else:
            a, ga = f, gf
    return float(f)


def akaike_index(x: np.ndarray) -> int | None:
    """The sample that best parts x into two stationary pieces: the least of n log var + (N - n) log var, by running sums."""
    n = len(x)
    if n < 12:
        return None
    y = x - np.median(x)
    s, q = np.cumsum(y), np.cumsum(y * y)
    k = np.arange(5, n - 5)
    left = np.maximum(q[k - 1] / k - (s[k - 1] / k) ** 2, 1e-300)
    m = n - k
    right = np.maximum((q[-1] - q[k - 1]) / m - ((s[-1] - s[k - 1]) / m) ** 2, 1e-300)
    return int(k[np.argmin(k * np.log(left) + m * np.log(right))])


def corrected(df: DataFrame, dt: float | None = None, frequency: bool = True) -> DataFrame:
    return mapped(df, lambda x, t: [sixth_order(x, t, frequency)], ["baseline"], dt)


def adjusted_corners(df: DataFrame, dt: float | None, low: float, high: float | None = None) -> DataFrame:
    """df with raised, ridder (Hz) and onset (sample): null where the search fails."""
    return measured(df, dt, raised=lambda x, t: raised_corner(x, t, low, high), ridder=ridder_corner, onset=lambda x, t: akaike_index(x))
