"""The step interpreter and the streaming form of the metrics."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from smframe.operators import clipping, filters, windows
from smframe.operators import waveform as w
from smframe.plans import process
from smframe.streaming import incremental


@pytest.fixture(scope="module")
def traces(spark):
    rows = [(1, "H1", 100.0, [1.0, -2.0, 3.0, -4.0] * 8), (1, "H2", 100.0, [float(i) for i in range(32)]), (2, "H1", 10.0, [0.0] * 32)]
    return spark.createDataFrame(rows, "record_id long, component string, sampling_rate double, x array<double>")


def test_plan_runs_in_order(traces):
    got = process.run(traces, [{"check_instrument": None}, {"min_sample_rate": {"least": 20}}, {"detrend": {"method": "linear"}}, {"cut": {"first": 4, "last": 19}}, {"taper": None}]).collect()
    by = {(r.record_id, r.component): r for r in got}
    assert by[(1, "H1")].failure is None and len(by[(1, "H1")].x) == 16
    assert by[(2, "H1")].failure.module == "check_instrument"  # the first failure stays
    assert max(abs(v) for v in by[(1, "H2")].x) < 1e-9
    assert [x.step for x in by[(1, "H1")].provenance] == ["check_instrument", "min_sample_rate", "detrend", "cut", "taper"]
    assert by[(1, "H1")].provenance[2].options == '{"method": "linear"}'
    assert [x.step for x in by[(2, "H1")].provenance] == ["check_instrument"] and by[(2, "H1")].x == [0.0] * 16  # cut, not tapered


def test_pads_and_filters(traces):
    d = process.run(traces, [{"zero_pad": {"samples": 4}}, {"strip_zero_pad": None}])
    assert [r.x for r in d.orderBy("record_id", "component").collect()] == [r.x for r in traces.orderBy("record_id", "component").collect()]
    d = process.run(traces, [{"bandpass_filter": {"low": 1.0, "high": 4.0, "number_of_passes": 2}}, {"integrate": None}, {"differentiate": None}])
    assert all(len(r.x) == 32 for r in d.collect())


def test_bad_plans_raise(traces):
    for plan, what in (([{"nothing": None}], "unknown"), ([{"detrend": {"method": "x"}}], "method"), ([{"cut": None, "taper": None}], "one name"), ([{"bandpass_filter": {"number_of_passes": 3}}], "passes")):
        with pytest.raises(ValueError, match=what):
            process.run(traces, plan)
    with pytest.raises(ValueError, match="exists"):
        process.step(process.STEPS["cut"])


def record(rate, n=6000, onset=20.0, seed=0):
    r = np.random.default_rng(seed)
    t = np.arange(n) / rate
    motion = np.where(t > onset, np.exp(-(t - onset) / 6) * np.sin(2 * np.pi * 1.7 * t), 0.0)
    return (r.normal(size=n) * 0.02 + 40 * motion + 10 * np.where(t > onset, np.exp(-(t - onset) / 6), 0) * r.normal(size=n)).tolist()


PRODUCTION = [
    {"check_free_field": None}, {"check_instrument": None}, {"min_sample_rate": None}, {"signal_split": {"shift": -2.0}}, {"signal_end": {"method": "none"}}, {"window_checks": None}, {"detrend": None}, {"detrend": {"method": "demean"}}, {"check_zero_crossings": None},
    {"remove_response": {"custom_pre_filt": {"lp_factor": 0.8, "hp_freq": 0.005, "corners": 40}}}, {"cut": None}, {"taper": None}, {"convert_to_acceleration": {"taper": False}}, {"compute_snr": None}, {"snr_check": None}, {"get_corner_frequencies": None}, {"lowpass_max_frequency": None},
    {"ridder_fchp": None}, {"zero_pad": None}, {"highpass_filter": None}, {"lowpass_filter": None}, {"strip_zero_pad": None}, {"detrend": {"method": "baseline_sixth_order"}}, {"check_tail": {"max_vel_ratio": 0.9, "max_dis_ratio": 1.1}},
]


def test_the_production_list_runs_at_each_traces_rate(spark):
    poles = [{"re": -222.0, "im": 222.0}, {"re": -222.0, "im": -222.0}]
    rows = [(k, c, f"HN{c[-1]}", rate, [v * 1000 for v in record(rate, int(60 * rate), seed=k * 3 + i)], poles) for k, rate in ((1, 100.0), (2, 200.0)) for i, c in enumerate(("H1", "H2", "Z"))]
    rows += [(3, c, "HX1", 100.0, record(100.0), None) for c in ("H1", "H2")] + [(4, c, "HN1", 100.0, None if c == "H1" else [], None) for c in ("H1", "H2")]
    d = spark.createDataFrame(rows, "record_id long, component string, channel string, sampling_rate double, x array<double>, poles array<struct<re:double,im:double>>")
    d = d.withColumns({"structure": F.lit(""), "sensitivity": F.lit(1e5), "magnitude": F.lit(5.0), "dist_km": F.lit(60.0), "arrival": F.lit(22.0), "origin": F.lit(10.0), "zeros": F.lit(None).cast("array<struct<re:double,im:double>>")})
    got = process.run(d, PRODUCTION).collect()
    by = {(x.record_id, x.component): x for x in got}
    assert len(got) == len(rows) and all(x.process_level == "V2" for x in got)
    for k in (1, 2):
        assert by[(k, "H1")].failure is None, by[(k, "H1")].failure
        assert by[(k, "H1")].highpass == by[(k, "H2")].highpass and by[(k, "H1")].units_type == "acc" and len(by[(k, "H1")].provenance) == len(PRODUCTION)
    # counts / sensitivity in m/s^2, times 100: the same motion whatever the rate
    peaks = [max(map(abs, by[(k, "H1")].x)) for k in (1, 2)]
    assert 0.5 < peaks[0] / peaks[1] < 2 and 10 < peaks[0] < 100
    assert by[(3, "H1")].failure.module == "remove_response" and by[(4, "H1")].x is None


def test_each_rate_gives_its_own_integral(spark):
    t = {rate: np.arange(int(10 * rate)) / rate for rate in (50.0, 100.0)}
    rows = [(1, rate, np.cos(2 * np.pi * t[rate]).tolist()) for rate in t] + [(1, 100.0, None), (1, 100.0, []), (1, None, [1.0])]
    d = spark.createDataFrame(rows, "record_id long, sampling_rate double, x array<double>")
    got = w.integrated(d).collect()
    peaks = [max(map(abs, x.velocity)) for x in got if x.velocity]
    assert all(abs(p - 1 / (2 * np.pi)) < 0.01 for p in peaks) and len(peaks) == 2
    assert [x.velocity for x in got if not x.velocity] == [None, [], None]
    assert len(process.run(d, [{"integrate": None}, {"detrend": {"method": "polynomial"}}, {"detrend": {"method": "baseline_sixth_order"}}]).collect()) == 5


def test_oscillator_against_the_closed_form():
    """A constant load of 1: d = -(1 - e^(-zwt) (cos wd t + z w / wd sin wd t)) / w^2."""
    for period in (0.1, 0.5, 2.0):
        a11, a12, a21, a22, b11, b12, b21, b22 = w.oscillator_step(period, 0.05, 0.01)
        om = 2 * np.pi / period
        wd = om * np.sqrt(1 - 0.05**2)
        d = v = 0.0
        for k in range(1, 300):
            d, v = a11 * d + a12 * v + b11 + b12, a21 * d + a22 * v + b21 + b22
            e = np.exp(-0.05 * om * k * 0.01)
            assert abs(d + (1 - e * (np.cos(wd * k * 0.01) + 0.05 * om / wd * np.sin(wd * k * 0.01))) / om**2) < 1e-9


def test_steady_extremes_are_scaled_first():
    """A clipped trace with amplitudes of hundreds counts as one with amplitudes near one."""
    x = np.clip(np.sin(np.arange(2000) / 40) * 500, -300, 300)
    n = [clipping.steady(x * k, 12, 0.001, 0.85) for k in (1e-3, 1.0, 1e4)]
    assert n[0] == n[1] == n[2] > 300
    assert clipping.steady(np.sin(np.arange(2000) / 3.0), 12, 0.001, 0.85) <= 12


def test_filters_in_time():
    x = np.sin(2 * np.pi * 5 * np.arange(4000) * 0.01) + np.sin(2 * np.pi * 0.2 * np.arange(4000) * 0.01)
    high = filters.butterworth_td(x, 0.01, 1.0, None)
    low = filters.butterworth_td(x, 0.01, None, 1.0, zero_phase=True)
    assert abs(np.abs(high[2000:]).max() - 1) < 0.02 and np.abs(low[1000:3000] - np.sin(2 * np.pi * 0.2 * np.arange(1000, 3000) * 0.01)).max() < 0.02


def test_adaptive_baseline_takes_a_step_out():
    t = np.arange(6000) * 0.01
    clean = np.where(t > 15, np.exp(-(t - 15) / 3) * np.sin(2 * np.pi * 2 * t), 0.0)
    x = clean + 0.3 * (t > 20)
    y = windows.adaptive_baseline(x, 0.01, 15.0, 0.2)
    end = lambda z: abs(w.integrate_td(z, 0.01)[-1])
    assert end(y) < 0.1 * end(x)


def test_kalkan_pick():
    p = windows.kalkan_pick(np.array(record(100.0, 4000, 20.0)), 0.01)
    assert p is not None and abs(p - 20.0) < 1.0


def test_stream_equals_batch(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [("N", f"S{i}", t + datetime.timedelta(seconds=20 * i), [float(i), -2.0 * i]) for i in range(12)]
    d = spark.createDataFrame(rows, "network string, station string, ts timestamp, x array<double>")
    d.repartition(3).write.parquet(f"{tmp_path}/in")
    p = incremental.peaks(spark, f"{tmp_path}/in", d.schema)
    incremental.append(p, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(60)
    got = {r.station: r.pga for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {f"S{i}": 2.0 * i for i in range(12)}
    q = incremental.append(incremental.triggers(p, 4.0, late="0 seconds"), f"{tmp_path}/trig", f"{tmp_path}/check2")
    q.awaitTermination(60)
    w = spark.read.parquet(f"{tmp_path}/trig").select(F.col("window.start").alias("s"), "stations", "pga").orderBy("s").collect()
    assert w[0]["stations"] == 1 and w[0]["pga"] == 4.0


def test_sensitivities_that_differ_and_the_band_of_the_response(spark):
    paz = [{"re": -50.0, "im": 40.0}, {"re": -50.0, "im": -40.0}]
    x = record(100.0, 2000, 5.0)
    rows = [("same", "HNE", 1000.0, 1040.0), ("off", "HNE", 1000.0, 1200.0), ("off", "HHE", 1000.0, 1200.0), ("unknown", "HHE", 1000.0, None)]
    d = spark.createDataFrame([(k, c, s, g, 100.0, x, paz, []) for k, c, s, g in rows], "id string, channel string, sensitivity double, stage_sensitivity double, sampling_rate double, x array<double>, poles array<struct<re:double,im:double>>, zeros array<struct<re:double,im:double>>")
    got = {(r["id"], r["channel"]): r for r in process.run(d, [{"remove_response": {"output_as_acceleration": False}}]).collect()}
    assert got["off", "HHE"]["failure"]["reason"] == "Total and stage sensitivity mismatch." and got["unknown", "HHE"]["failure"] is None
    # an accelerometer in doubt is divided by its sensitivity alone
    assert np.allclose(got["off", "HNE"]["x"], 0.1 * np.array(x)) and not np.allclose(got["same", "HNE"]["x"], 0.1 * np.array(x))
    band = process.cosine_band(np.array([0.0, 0.001, 0.003, 0.005, 10.0, 45.0, 47.5, 50.0]), 0.001, 0.005, 45.0, 50.0)
    assert np.allclose(band, [0, 0, 0.5, 1, 1, 1, 0.5, 0])
    s = np.abs(np.fft.rfft(got["same", "HNE"]["x"]))
    assert s[-1] < 1e-6 * s.max()
