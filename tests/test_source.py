"""Fits of source spectra: planted parameters come back, bounds hold, odd rows give nothing."""

import numpy as np
import pytest

from smframe.functions import physics as p
from smframe.operators import source
from smframe.plans import process


def spectrum(freq, magnitude, stress, dist, kappa=0.035):
    m0 = 10 ** (1.5 * magnitude + 16.05)
    f0 = 4.906e6 * p.BETA * (stress / m0) ** (1 / 3)
    return np.exp(source.source_level(freq) + source.path_and_site(freq, np.array([dist]), kappa) + np.log(m0) - np.log1p((freq / f0) ** 2)), f0


@pytest.fixture(scope="module")
def fitted(spark):
    freq = np.logspace(-1.3, 1.6, 80)
    rows, want = [], {}
    for k, (m, stress, dist) in enumerate([(4.2, 30.0, 12.0), (5.0, 200.0, 55.0), (6.1, 80.0, 140.0), (5.5, 2.0, 8.0)]):
        spec, f0 = spectrum(freq, m, stress, dist)
        rows.append((k, freq.tolist(), spec.tolist(), 0.06, 35.0, dist, m + 0.3, "acc"))
        want[k] = (m, stress, f0)
    spec, _ = spectrum(freq, 5.0, 1e6, 20.0)
    bad = spec.tolist()
    rows += [(10, freq.tolist(), bad, 0.06, 35.0, 20.0, 5.0, "acc"), (11, freq.tolist(), bad, 5.0, 5.01, 20.0, 5.0, "acc"), (12, None, bad, 0.1, 20.0, 20.0, 5.0, "acc"), (13, freq.tolist(), bad, None, 20.0, 20.0, 5.0, "acc"), (14, [], [], 0.1, 20.0, 20.0, 5.0, "acc")]
    rows += [(15, freq[:20].tolist(), spec[:20].tolist(), 0.06, 35.0, 20.0, 5.0, "vel"), (16, freq.tolist(), [float("nan")] * 5 + spec[5:].tolist(), 0.06, 35.0, 20.0, 5.0, "acc")]
    d = spark.createDataFrame(rows, "id int, snr_freq array<double>, signal_spectrum array<double>, highpass double, lowpass double, dist_km double, magnitude double, units_type string")
    return d, want


def test_planted_parameters_come_back(fitted):
    d, want = fitted
    got = {r["id"]: r["fit_spectra"] for r in source.fit_spectra(d).collect()}
    for k, (m, stress, f0) in want.items():
        assert got[k]["minimize_success"] and np.isclose(got[k]["magnitude"], m, atol=1e-6) and np.isclose(got[k]["stress_drop"], stress, rtol=1e-5) and np.isclose(got[k]["f0"], f0, rtol=1e-5)
        assert got[k]["R2"] > 0.999999 and got[k]["moment_lnsd"] < 1e-6
    # the stress drop stays within its bounds
    assert np.isclose(got[10]["stress_drop"], 10_000.0) and got[10]["minimize_success"]
    assert got[11]["moment"] is None and got[11]["minimize_message"] == source.FEW and not got[11]["minimize_success"]
    assert got[12] is None and got[13] is None and got[14] is None
    assert got[16]["moment"] is not None and np.isfinite(got[16]["mean_squared_error"])


def test_bounded_fit_is_a_least_one():
    """No point of a fine grid within the bounds is better."""
    r, freq = np.random.default_rng(3), np.logspace(-1, 1.4, 40)[None, :]
    for m, stress in ((4.5, 60.0), (6.0, 9000.0), (3.2, 5.0)):
        spec = spectrum(freq[0], m, stress, 30.0)[0] * np.exp(r.normal(0, 0.4, 40))
        got = source.fit(freq, spec[None, :], np.ones((1, 40), bool), np.array([30.0]), np.array([m - 0.5]), 0.035, 100.0, 0.1, 10_000.0)
        fixed = source.source_level(freq[0]) + source.path_and_site(freq[0], np.array([30.0]), 0.035)

        def cost(x, t):
            f0 = 4.906e6 * p.BETA * np.exp((t - x) / 3)
            return ((np.log(spec) - fixed - x + np.log1p((freq[0] / f0) ** 2)) ** 2).sum()

        best = cost(np.log(got["moment"][0]), np.log(got["stress_drop"][0]))
        start = np.log(10) * (1.5 * (m - 0.5) + 16.05)
        assert all(best <= cost(a, b) + 1e-9 for a in np.linspace(start - np.log(100), start + np.log(100), 60) for b in np.linspace(np.log(0.1), np.log(10_000), 60))


def test_step_and_table(spark, fitted):
    d, _ = fitted
    got = {r["id"]: r for r in process.run(d.withColumn("x", d["snr_freq"]), [{"fit_spectra": None}]).collect()}
    assert got[15]["failure"]["module"] == "fit_spectra" and got[15]["fit_spectra"] is None and got[0]["fit_spectra"]["minimize_success"]
    t = source.fit_spectra(d).selectExpr("*", "cast(null as string) as failure", "'e1' as event_id", "'NC' as network", "'AAA' as station", "'--' as location", "'HN1' as channel")
    events = spark.createDataFrame([("e1", "2020-01-01T00:00:00", 1.0, 2.0, 3.0, 5.0, "mw")], "event_id string, time string, latitude double, longitude double, depth_km double, magnitude double, magnitude_type string")
    places = spark.createDataFrame([("NC", "AAA", 3.0, 4.0, 5.0)], "network string, station string, latitude double, longitude double, elevation double")
    table = source.fit_table(t, events, places)
    assert table.columns == source.FIT_COLUMNS and {r["TraceID"] for r in table.collect()} == {"NC.AAA.--.HN1"} and table.count() == t.where("fit_spectra is not null").count()
