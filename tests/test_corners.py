"""Corner searches and the onset on signals whose answer is known."""

import numpy as np

from smframe.operators import corners as c


def burst(n=2000, at=800):
    r = np.random.default_rng(0)
    x = r.normal(size=n) * 0.01
    x[at:] += r.normal(size=n - at) * np.exp(-np.arange(n - at) / 400)
    return x


def test_onset_is_found():
    assert abs(c.akaike_index(burst()) - 800) <= 5
    assert c.akaike_index(np.zeros(5)) is None


def test_polynomial_drift_is_removed():
    t = np.arange(4000) * 0.01
    x = np.sin(2 * np.pi * 2 * t)
    x = x + 0.02 * (t - t.mean())
    d = c.displacement(x, 0.01, frequency=False)
    e = c.displacement(c.sixth_order(x, 0.01, frequency=False), 0.01, frequency=False)
    assert np.abs(e).max() < 0.05 * np.abs(d).max()


def test_ridder_meets_its_target():
    t = np.arange(4000) * 0.01
    x = burst(4000, 1000) * 100 + 0.5 * np.sin(2 * np.pi * 0.02 * t)
    f = c.ridder_corner(x, 0.01)
    assert f is not None and (f == 0.001 or abs(c.drift(x, 0.01, f) - 0.02) <= 0.002)


def test_corners_rise_until_displacement_is_small():
    x = burst(4000, 1000) + 0.05 * np.sin(2 * np.pi * 0.03 * np.arange(4000) * 0.01)
    f = c.raised_corner(x, 0.01, 0.01, None, final=0.01)
    assert f is None or f >= 0.01
    assert c.raised_corner(x, 0.01, 0.6, None) is None


def test_as_a_job(spark):
    rows = [(i, burst(400, 150).tolist()) for i in range(3)] + [(9, [0.0] * 40)]
    d = spark.createDataFrame(rows, "id long, x array<double>")
    got = {r.id: r for r in c.adjusted_corners(d, 0.01, 0.05, 40.0).collect()}
    assert abs(got[0].onset - 150) <= 5 and got[0].raised == got[1].raised and got[9].ridder == 0.001
    assert len(c.corrected(d, 0.01).first()["baseline"]) == 400
