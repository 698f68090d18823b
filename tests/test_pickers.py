"""Pickers find planted onsets, agree with plain loops, and give nothing where there is nothing."""

import numpy as np
import pytest

from smframe.operators import pickers as pk
from smframe.operators import windows


def planted(seed, n=5000, onset=2600, noise=0.02, colour=0.0):
    r = np.random.default_rng(seed)
    x = r.normal(0, 1, n)
    for k in range(1, n):
        x[k] += colour * x[k - 1]
    x[:onset] *= noise
    return x


@pytest.mark.parametrize("seed", range(5))
@pytest.mark.parametrize("colour", [0.0, 0.6])
def test_planted_onsets(seed, colour):
    z = planted(seed, colour=colour)
    h = planted(seed + 50, onset=3000, noise=0.05, colour=colour)
    p, s = pk.ar_pick(z, h, 0.7 * planted(seed + 90, onset=3000, noise=0.05, colour=colour), 0.01)
    assert abs(p - 26.0) <= 0.1 and abs(s - 30.0) <= 0.2
    assert abs(pk.baer_pick(z, 0.01) - 26.0) <= 0.25  # a dip of 0.2 s may join an outlier to the onset
    assert abs(pk.power_pick(z, 0.01) - 26.0) <= 0.3


def test_nothing_to_pick():
    for x in (np.zeros(5000), np.full(5000, 3.0), np.ones(3), np.zeros(0), np.full(5000, np.nan)):
        assert pk.power_pick(x, 0.01) is None and pk.baer_pick(x, 0.01) is None and pk.ar_pick(x, x, x, 0.01)[0] is None


def test_levinson_solves_the_normal_equations():
    r = np.random.default_rng(2)
    for order in (1, 2, 5, 9):
        x = r.normal(size=400)
        c = np.array([x[: 400 - k] @ x[k:] for k in range(order + 1)])
        m = np.array([[c[abs(i - j)] for j in range(order)] for i in range(order)])
        assert np.allclose(pk.levinson(c)[1:], np.linalg.solve(m, -c[1:]))
    assert pk.levinson(np.zeros(4)).tolist() == [1.0, 0.0, 0.0, 0.0]


def test_a_filter_foretells_its_own_process():
    r = np.random.default_rng(3)
    x = r.normal(size=4000)
    for k in range(2, 4000):
        x[k] += 1.2 * x[k - 1] - 0.6 * x[k - 2]
    assert 0.9 < pk.prediction_errors(x, x, 2)[2:].var() < 1.1 < x.var()


def test_akaike_equals_a_plain_loop():
    r = np.random.default_rng(4)
    for _ in range(10):
        x = np.concatenate((r.normal(0, 1, int(r.integers(10, 60))), r.normal(0, 9, int(r.integers(10, 60)))))
        n = len(x)
        cost = {k: k * np.log(x[:k].var()) + (n - k + 1) * np.log(x[k + 1 :].var()) for k in range(5, n - 5)}
        assert pk.akaike(x) == min(cost, key=cost.get)
    assert pk.akaike(np.ones(12)) is None


def test_baer_equals_its_definition():
    """The running mean and deviation, sample by sample, from the lists of what has been learned."""
    for seed in range(4):
        x = planted(seed, 900, 500, 0.2)
        x[200:215] *= 30  # too short a burst
        y = x - x[0]
        slope = np.append(0.0, np.diff(y))
        e = np.array([(y[k] ** 2 + slope[k] ** 2 * ((y[: k + 1] ** 2).sum() / s if (s := (slope[: k + 1] ** 2).sum()) else 0)) ** 2 for k in range(900)])
        learned, start, above, dip, want = [*e[:100]], None, 0, 0, None
        for k in range(100, 900):
            z = (e[k] - np.mean(learned)) / np.std(learned)
            if z > 7:
                start, above, dip = k if start is None else start, above + 1 if start is not None else 1, 0
                if above >= 60:
                    want = start * 0.01
                    break
            elif start is not None:
                dip += 1
                if dip > 20:
                    start, above, dip = None, 0, 0
            if z <= 12:
                learned.append(e[k])
        assert pk.baer_pick(x, 0.01) == want


def test_resampling_keeps_slow_waves():
    t = np.arange(4000) * 0.01
    x = np.sin(2 * np.pi * 0.5 * t)
    y = pk.fourier_resample(x, 800)
    assert np.abs(y - np.sin(2 * np.pi * 0.5 * np.arange(800) * 0.05)).max() < 0.01
    assert np.allclose(pk.envelope(x), 1.0, atol=1e-6)


def test_records_of_three_components(spark):
    z, h = planted(1).tolist(), planted(2, onset=3000, noise=0.05).tolist()
    rows = [("a", "HNZ", 100.0, z), ("a", "HNN", 100.0, h), ("a", "HNE", 100.0, h), ("b", "HNZ", 100.0, z), ("b", "HN1", 100.0, h), ("c", "HNZ", 100.0, z), ("c", "HN2", 50.0, h), ("c", "HN1", 100.0, h), ("d", "HNZ", 100.0, None), ("d", "HN2", 100.0, h), ("d", "HN1", 100.0, h), (None, "HN3", 100.0, z), (None, "HN2", 100.0, h), (None, "HN1", 100.0, h), ("e", "HNZ", 100.0, z), ("e", "BHZ", 100.0, z), ("e", "HN2", 100.0, h), ("e", "HN1", 100.0, h)]
    d = spark.createDataFrame(rows, "record_id string, channel string, sampling_rate double, x array<double>")
    got = {r["record_id"]: r["ar_p"] for r in pk.ar_picks(d, ["record_id"]).collect()}
    assert abs(got["a"] - 26) <= 0.1 and abs(got[None] - 26) <= 0.1 and [got[k] for k in "bcde"] == [None] * 4
    split = windows.signal_split(d.selectExpr("*", "cast(26.05 as double) as arrival").where("record_id is not null"), ["record_id"], ["travel_time", "ar", "baer", "power"])
    by = {r["record_id"]: r["split"] for r in split.select("record_id", "split").distinct().collect()}
    assert abs(by["a"] - 26) <= 0.15 and abs(by["b"] - 26) <= 0.2 and split.columns == [*d.columns, "arrival", "split"]
