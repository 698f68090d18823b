"""Blocked recurrences equal plain loops, and what is built on them."""

import time

import numpy as np
import pytest

from smframe.operators import clipping, filters, metrics, recurrence
from smframe.operators import waveform as w


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 500])
@pytest.mark.parametrize("pole", [0.0, 0.5, -0.9, 0.999, 0.7 + 0.7j])
def test_one_pole(n, pole):
    c = np.random.default_rng(n).normal(size=(3, n))
    z, at = np.zeros((3, n), complex), np.zeros(3)
    for k in range(n):
        z[:, k] = at = pole * at + c[:, k]
    assert np.allclose(recurrence.one_pole(c, pole), z, atol=1e-11)


def test_what_is_not_finite_spoils_only_what_follows():
    c = np.ones(200)
    c[100] = np.nan
    z = recurrence.one_pole(c, 0.5)
    assert np.isfinite(z[:100]).all() and np.isnan(z[100:]).all()


def test_sections_equal_the_difference_equation():
    x = np.random.default_rng(1).normal(size=700)
    for low, high, order in ((0.5, None, 4), (None, 10.0, 5), (0.1, 20.0, 2), (1.0, 3.0, 3)):
        for n, d in filters.sections(0.01, low, high, order):
            b, a, y = np.pad(n, (0, 3 - len(n))), np.pad(d, (0, 3 - len(d))), np.zeros(700)
            for k in range(700):
                y[k] = sum(b[j] * x[k - j] for j in range(3) if k >= j) - sum(a[j] * y[k - j] for j in (1, 2) if k >= j)
            assert np.allclose(filters.run_section(x, n, d), y, rtol=1e-9, atol=1e-9)


def test_oscillators_equal_the_step_by_step_solution_and_are_quick():
    x = np.random.default_rng(2).normal(size=(2, 900))
    for period in (0.05, 0.3, 3.0):
        times = metrics.upsampling(period, 0.01)
        y = np.stack([metrics.finer(r, times) for r in x])
        a11, a12, a21, a22, b11, b12, b21, b22 = w.oscillator_step(period, 0.05, 0.01 / times)
        d = v = np.zeros(2)
        want = []
        for k in range(1, y.shape[1]):
            p, q = y[:, k - 1], y[:, k]
            d, v = a11 * d + a12 * v + b11 * p + b12 * q, a21 * d + a22 * v + b21 * p + b22 * q
            want.append((d, v))
        got = metrics.oscillate(x, 0.01, period, 0.05)
        for k in (0, 1):
            assert np.allclose(got[k][:, 1:].T, [s[k] for s in want], rtol=1e-8, atol=1e-10 * np.abs(got[k]).max())
    began = time.time()
    for period in np.logspace(-2, 1, 21):
        metrics.oscillate(np.random.default_rng(3).normal(size=(1, 20_000)), 0.01, float(period), 0.05)
    assert time.time() - began < 6


def test_smoothing_and_the_histogram_detector():
    y = np.random.default_rng(4).uniform(0, 9, 800)
    level, at = [], 0.0
    for v in y:
        level.append(at)
        at = 0.2 * v + 0.8 * at
    weight = 0.8 ** np.arange(800)
    assert np.allclose(clipping.exponential_smoothing(y, 0.2), level + weight * (weight * (y - level)).sum() / (weight * weight).sum())
    # a trace cut off at two thirds of its size gathers where it is cut; the whole one doesn't
    t = np.arange(60_000) * 0.005
    x = np.sin(2 * np.pi * 0.8 * t) * np.exp(-t / 200) * (1 + 0.3 * np.sin(2 * np.pi * 0.013 * t))
    cut = np.clip(x, -0.66, 0.66)
    lim = clipping.Limits()
    assert clipping.histogram_intervals(cut, lim) >= 1
    began = time.time()
    clipping.histogram_intervals(x, lim)
    assert time.time() - began < 2
