"""Operators on hand-made cases, gates and edge cases that the tables don't hold."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from smframe.functions import arrays, physics
from smframe.operators import clipping
from smframe.operators import relational as r
from smframe.operators import waveform as w


def one(spark, x, expr):
    return spark.createDataFrame([([float(v) for v in x],)], "x array<double>").select(expr.alias("y")).first()["y"]


def test_integration_loses_the_mean_and_starts_at_zero():
    x = np.sin(np.arange(201) * 0.1) + 3  # odd, so there is no Nyquist term to lose
    y = w.integrate_fd(x, 0.01)
    assert y[0] == 0 and abs(w.differentiate_fd(y, 0.01) - (x - x.mean())).max() < 1e-9


def test_butterworth_halves_power_at_the_corner():
    t = np.arange(1000) * 0.01
    x = np.sin(2 * np.pi * 5 * t)
    y = w.butterworth_fd(x, 0.01, None, 5.0)
    assert abs(y.std() / x.std() - math.sqrt(0.5)) < 1e-6


def test_konno_ohmachi_keeps_a_flat_spectrum():
    f = np.linspace(0, 50, 513)
    got = w.konno_ohmachi(np.ones_like(f), f, np.array([0.5, 1.0, 10.0, 60.0]), 20.0)
    assert np.allclose(got[:3], 1) and np.isnan(got[3])


def test_oscillator_against_a_fine_integration(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=300)
    got = one(spark, x, w.response(F.col("x"), 0.5, 0.05, 0.01))
    om, z, n = 2 * np.pi / 0.5, 0.05, 200
    u = v = peak = 0.0
    for a, b in zip(x, x[1:]):
        for k in range(n):
            h, g = 0.01 / n, a + (b - a) * (k + 0.5) / n
            acc = -g - 2 * z * om * v - om * om * u
            vm, um = v + acc * h / 2, u + v * h / 2
            acc = -g - 2 * z * om * vm - om * om * um
            u, v = u + vm * h, v + acc * h
        peak = max(peak, abs(u))
    assert abs(got["sd"] - peak) < 1e-4 * peak


def test_small_arrays(spark):
    assert one(spark, [1, -1, 1], arrays.zero_crossings(F.col("x"))) == 2
    assert one(spark, [5], arrays.detrend_linear(F.col("x"))) == [0.0]
    assert one(spark, [1, 3, 5, 7], arrays.detrend_linear(F.col("x"))) == pytest.approx([0, 0, 0, 0])
    assert one(spark, [2, 4, 9], arrays.detrend_simple(F.col("x"))) == pytest.approx([0, -1.5, 0])
    assert one(spark, [1, 2, 4], arrays.trapezoid(F.col("x"), 1.0)) == 4.5
    assert one(spark, [1, 2, 4], arrays.gradient(F.col("x"), 1.0)) == [1.0, 1.5, 2.0]
    assert one(spark, [0, 0], arrays.decibels(F.col("x"), F.col("x"))) is None
    assert one(spark, [3, -4, 4], arrays.argmax_abs(F.col("x"))) == 1


def test_clip_tail():
    x = np.array([10.0] * 5 + [0.1] * 3 + [9.0] + [0.1] * 4)
    assert len(clipping.without_tail(x, 0.05)) == 9



def test_first_failure_wins_and_review_can_accept(spark):
    d = spark.createDataFrame([(1, 5.0)], "id long, x double")
    d = r.failed(d, "a", "first", F.col("x") > 1)
    d = r.failed(d, "b", "second", F.col("x") > 2)
    assert d.first()["failure"]["reason"] == "first"


def test_colocated_prefers_and_fails_the_rest(spark):
    rows = [("S1", "HN", 10.0), ("S1", "BH", 10.0), ("S2", "XX", 10.0), ("S2", "YY", 10.0), ("S3", "ZZ", 10.0), ("S4", "HN", 500.0), ("S4", "HH", 500.0)]
    d = spark.createDataFrame(rows, "station string, instrument string, dist_km double")
    got = {(x.station, x.instrument): x.reason for x in r.select_colocated(d, ["station"], ["HN?", "BH?"], ["HH?", "HN?"], F.lit(100.0)).collect()}
    assert got[("S1", "HN")] is None and got[("S1", "BH")] == "colocated with HN"
    assert got[("S2", "XX")] == got[("S2", "YY")] == "no preferred instrument"
    assert got[("S3", "ZZ")] is None and got[("S4", "HH")] is None and got[("S4", "HN")] == "colocated with HH"


def test_physics(spark):
    d = spark.range(1)
    assert d.select(physics.magnitude(physics.moment(F.lit(6.5)))).first()[0] == pytest.approx(6.5)
    f0 = physics.brune_f0(physics.moment(F.lit(6.5)), 120.0)
    assert d.select(physics.brune_stress(physics.moment(F.lit(6.5)), f0)).first()[0] == pytest.approx(120)
    assert d.select(physics.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))).first()[0] == pytest.approx(math.pi * 6371)
    assert d.select(physics.back_azimuth(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(-5.0))).first()[0] == pytest.approx(270)
    assert d.select(physics.crust(F.lit(0.0001))).first()[0] == pytest.approx(1.0) and d.select(physics.crust(F.lit(100.0))).first()[0] == pytest.approx(4.49)


def test_bounds_cross_the_antimeridian(spark):
    s = spark.createDataFrame([(1, 0.0, 179.0), (2, 0.0, -179.0), (3, 0.0, 0.0)], "id long, lat double, lon double")
    b = spark.createDataFrame([("p", 170.0, -170.0, -10.0, 10.0)], "provider string, west double, east double, south double, north double")
    assert sorted(x.id for x in r.within_bounds(s, b).collect()) == [1, 2]


def test_nearest_event_reaches_over_narrow_cells(spark):
    pairs = [(69.0, x, 69.0, x + 25.0) for x in (0.0, 4.0, 6.0, 9.0)] + [(5.0, 5.0, 12.0, 5.0), (84.0, 10.0, 86.0, -170.0)]
    t = spark.createDataFrame([(i, a, b, 0.0, 0.0, 5.0) for i, (a, b, _, _) in enumerate(pairs)], "station long, lat double, lon double, time_s double, depth double, magnitude double")
    for cell in (10.0, 3.0):
        c = spark.createDataFrame([(i, y, x, 0.0, 0.0, 5.0) for i, (_, _, y, x) in enumerate(pairs)], "event long, lat double, lon double, time_s double, depth double, magnitude double")
        got = r.nearest_event(t, c, "station", 1200.0, 60.0, 30.0, 1.0, cell)
        assert {x.station for x in got.select("station").collect()} == {*range(len(pairs))}


def test_colocated_records_that_failed_before_take_no_part(spark):
    d = spark.createDataFrame([("A", "HN", "noisy"), ("A", "BH", None), ("B", "HN", None), ("B", "BH", None), ("C", "XX", "late"), ("C", "YY", "late")], "station string, instrument string, reason string")
    got = {(x.station, x.instrument): x.reason for x in r.select_colocated(d, ["station"], ["HN?", "BH?"]).collect()}
    assert got == {("A", "HN"): "noisy", ("A", "BH"): None, ("B", "HN"): None, ("B", "BH"): "colocated with HN", ("C", "XX"): "late", ("C", "YY"): "late"}
