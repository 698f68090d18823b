"""Butterworth filters in the time domain: second-order sections by the bilinear transform."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from smframe.operators.recurrence import second_order
from smframe.operators.waveform import mapped


def sections(dt: float, low: float | None, high: float | None, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(numerator, denominator) of each section; low alone is a high-pass, high alone a low-pass, both a band-pass.

    The gain is one at the Nyquist frequency, at zero, and at the band's geometric centre (prewarped) respectively.
    """
    nyquist = 0.5 / dt
    if (low is not None and not 0 < low < nyquist) or (high is not None and not 0 < high < nyquist) or (low is None and high is None):
        raise ValueError("corners must lie between 0 and half the sampling rate")
    warp = lambda f: 2 / dt * np.tan(np.pi * f * dt)
    analog = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    if low is None:
        poles, zero, at = analog * warp(high), (1.0, 1.0), 0.0
    elif high is None:
        poles, zero, at = warp(low) / analog, (1.0, -1.0), np.pi
    else:
        a, b = warp(low), warp(high)
        half = analog * (b - a) / 2
        root = np.sqrt(half * half - a * b + 0j)
        poles, zero, at = np.concatenate((half + root, half - root)), None, 2 * np.arctan(np.sqrt(a * b) * dt / 2)
    digital = (1 + poles * dt / 2) / (1 - poles * dt / 2)
    up = digital[digital.imag > 1e-10]
    real = np.sort(digital[np.abs(digital.imag) <= 1e-10].real)
    pairs = [np.array([1.0, -2 * p.real, abs(p) ** 2]) for p in up]
    pairs += [np.array([1.0, -(real[k] + real[k + 1]), real[k] * real[k + 1]]) for k in range(0, len(real) - 1, 2)]
    if len(real) % 2:
        pairs.append(np.array([1.0, -real[-1]]))
    z = np.exp(1j * at)
    out = []
    for d in pairs:
        n = np.array([1.0, 0.0, -1.0]) if zero is None else np.array([1.0]) if len(d) == 1 else np.polynomial.polynomial.polypow(zero, len(d) - 1)
        gain = abs(np.polyval(n[::-1], 1 / z) / np.polyval(d[::-1], 1 / z))
        out.append((n / gain, d))
    return out


def run_section(x: np.ndarray, n: np.ndarray, d: np.ndarray) -> np.ndarray:
    """One section over a trace, from rest."""
    return second_order(np.asarray(x, float), n, d)


def butterworth_td(x: np.ndarray, dt: float, low: float | None, high: float | None, order: int = 5, zero_phase: bool = False) -> np.ndarray:
    for n, d in sections(dt, low, high, order):
        x = run_section(x, n, d)
    return butterworth_td(x[::-1], dt, low, high, order)[::-1] if zero_phase else x


def filtered_td(df: DataFrame, dt: float | None = None, low: float | None = None, high: float | None = None, order: int = 5, zero_phase: bool = False) -> DataFrame:
    """df with `filtered`; the corners are the plan's, the sampling interval is dt or each row's own."""
    return mapped(df, lambda x, t: [butterworth_td(x, t, low, high, order, zero_phase)], ["filtered"], dt)
