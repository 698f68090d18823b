"""The record check: measures against plain loops, the layers against NumPy, and its gates."""

import numpy as np
import pytest

from smframe.operators import record_quality as rq
from smframe.operators import windows
from smframe.plans import process


def weights(seed=1, hidden=(20, 15)):
    r = np.random.default_rng(seed)
    sizes = [20, *hidden, 2]
    return {"mu": r.normal(size=20).tolist(), "sigma": r.uniform(0.5, 2, 20).tolist(), "decorrelate": r.normal(size=(20, 20)).tolist(), "layers": [(r.normal(size=(a, b)).tolist(), r.normal(size=b).tolist()) for a, b in zip(sizes, sizes[1:])]}


def plain(a, s, n, f, split, dt):
    """The measures as the paper's procedure takes them, one list at a time."""
    a1, a2 = (v / 981 for v in a)
    s1, s2 = (np.where(np.isnan(v), 0, v) / 981 for v in s)
    n1, n2 = (np.where(np.isnan(v), 0, v) / 981 for v in n)
    p = int(np.floor(split / dt))
    gm = lambda u, v: (u * v) ** 0.5
    pga = gm(max(map(abs, a1)), max(map(abs, a2)))
    pn, pna = gm(max(map(abs, a1[:p])), max(map(abs, a2[:p]))), gm(sum(map(abs, a1[:p])) / p, sum(map(abs, a2[:p])) / p)
    end = (len(a1) - 1) * dt
    k5, k2, k1 = int(min(5.0, 0.1 * end) / dt), int(min(2.0, 0.1 * end) / dt), int(1.0 / dt)
    tail = gm(np.mean(np.abs(a1[-k5:])), np.mean(np.abs(a2[-k5:]))) / pga
    peak = gm(np.max(np.abs(a1[-k2:])), np.max(np.abs(a2[-k2:]))) / pga
    head = gm(np.max(np.abs(a1[:k1])), np.max(np.abs(a2[:k1]))) / pga

    def bracket(v, q):
        i = [k for k, y in enumerate(v) if abs(y) >= q * max(map(abs, v))]
        return (max(i) - min(i)) * dt

    def arias(v, q):
        e, out = [0.0], []
        for x, y in zip(v, v[1:]):
            e.append(e[-1] + (x * x + y * y) / 2 * dt)
        for z in (0.05, q):
            out.append(min(k for k, y in enumerate(e) if y / max(e) > z))
        return (out[1] - out[0]) * dt

    level, quiet = np.sqrt(np.abs(s1) * np.abs(s2)), np.sqrt(np.abs(n1) * np.abs(n2))
    snr = level / quiet

    def ends(lo, hi):
        return min(k for k, v in enumerate(f) if v > lo), max(k for k, v in enumerate(f) if v < hi)

    def area(y, i, j):
        return sum((y[k] + y[k + 1]) / 2 * (f[k + 1] - f[k]) for k in range(i, j - 1))

    def mean(y, lo, hi):
        i, j = ends(lo, hi)
        return area(y, i, j) / (f[j] - f[i])

    i, j = ends(0.1, 20)
    low = lambda y: area(y, 0, i) / (f[i] - f[0])
    return [max(low(n1) / max(s1), low(n2) / max(s2)), max(low(s1) / max(s1), low(s2) / max(s2)), min(snr[i:j]), max(snr), mean(snr, 0.1, 10), tail, peak, tail / pna, peak / pn, head,
            *(mean(snr, a, b) for a, b in ((0.1, 0.5), (0.5, 1), (1, 2), (2, 5), (5, 10))), mean(level, 0.1, 0.5) / mean(level, 0.5, 1), pn / pga, gm(bracket(a1, 0.1), bracket(a2, 0.1)) / gm(bracket(a1, 0.2), bracket(a2, 0.2)),
            gm(arias(a1, 0.75), arias(a2, 0.75)), gm(arias(a1, 0.95), arias(a2, 0.95))]


def rows(seed):
    r = np.random.default_rng(seed)
    f = np.logspace(-1.6, 1.6, 120)
    x = [np.concatenate((r.normal(0, 0.1, 300), r.normal(0, 1, 700) * np.exp(-np.arange(700) / 200))) for _ in range(3)]
    s, n = ([r.uniform(lo, lo + 1, 120) for _ in range(3)] for lo in (2, 0.1))
    s[0][:4] = n[0][:4] = np.nan
    return [("r%d" % seed, c, 100.0, 3.0, f.tolist(), *(v[k].tolist() for v in (x, s, n))) for k, c in enumerate(("HN1", "HN2", "HNZ"))]


SCHEMA = "record_id string, channel string, sampling_rate double, split double, snr_freq array<double>, x array<double>, signal_spectrum array<double>, noise_spectrum array<double>"


@pytest.mark.filterwarnings("ignore")
def test_measures_and_scores(spark):
    data = [r for k in range(5) for r in rows(k)]
    d = spark.createDataFrame(data, SCHEMA).repartition(3)
    w = weights()
    m = rq.measured_records(d, ["record_id"])
    for model in rq.DESKEW:
        got = {r["record_id"]: r for r in m.select("record_id", "features", rq.scores(m["features"], model, w).alias("s")).collect()}
        for k in range(5):
            h = [r for r in data if r[0] == f"r{k}"][:2]
            want = plain(*([np.array(r[i]) for r in h] for i in (5, 6, 7)), np.array(h[0][4]), 3.0, 0.01)
            mine = got[f"r{k}"]["features"]
            ok = ~np.isnan(want)
            assert np.allclose(np.array(mine)[ok], np.array(want)[ok]) and np.isnan(np.array(mine)[~ok]).all()
            v = np.array([np.log(x) if p == "log" else p[0] * x ** p[1] if isinstance(p, tuple) else x**p for x, p in zip(mine, rq.DESKEW[model])])
            v = np.array(w["decorrelate"]) @ ((v - w["mu"]) / w["sigma"])
            for a, b in w["layers"]:
                v = 1 / (1 + np.exp(-(v @ np.array(a) + b)))
            assert np.allclose(got[f"r{k}"]["s"], v, equal_nan=True) and len(v) == 2


def test_gates(spark):
    one, two = rows(1), rows(2)
    data = [*one, *two[:1], *[("z", *r[1:5], [0.0] * 10, *r[6:]) for r in one], *[("n", *r[1:6], None, r[7]) for r in one], *[(None, *r[1:]) for r in one], *[("e", *r[1:5], [], *r[6:]) for r in one]]
    d = spark.createDataFrame(data, SCHEMA).selectExpr("*", "cast(null as struct<module:string,reason:string>) as failure")
    score = rq.nnet_qa(d, weights()).where("record_id = 'r1'").first()["score_hq"]
    for threshold in (0.0, 1.01):
        got = {}
        for r in process.run(d, [{"nnet_qa": {"weights": weights(), "acceptance_threshold": threshold}}]).collect():
            got.setdefault(r["record_id"], set()).add(r["failure"]["reason"] if r["failure"] else None)
        assert all(len(v) == 1 for v in got.values()) and len(got) == 6
        assert "two horizontal" in [*got["r2"]][0] and "all zeros" in [*got["z"]][0] and "required" in [*got["n"]][0]
        passed = score is not None and score == score and score >= threshold
        assert got["r1"] == got[None] == ({None} if passed else {"Failed NNet QA check."})


def test_after_compute_snr(spark):
    """The measures take what the steps before leave."""
    r = np.random.default_rng(5)
    data = [("a", c, 100.0, 20.0, 5.0, np.concatenate((r.normal(0, 0.02, 2000), r.normal(0, 1, 4000))).tolist()) for c in ("HNE", "HNN", "HNZ")]
    d = spark.createDataFrame(data, "record_id string, channel string, sampling_rate double, split double, magnitude double, x array<double>").selectExpr("*", "cast(null as struct<module:string,reason:string>) as failure")
    got = rq.measured_records(windows.compute_snr(d), ["record_id"]).first()
    assert got["why"] is None and np.isfinite(got["features"][4]) and got["features"][4] > 5
