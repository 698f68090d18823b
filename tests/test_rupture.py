"""Distances to ruptures in closed form, and that cells lose no pair anywhere on the globe."""

import math
import random

import numpy as np
import pytest

from smframe.functions.physics import EARTH_KM
from smframe.operators import rupture as ru

KM = ru.DEGREE_KM
CORNERS = "array<struct<lat:double,lon:double,depth:double>>"


def test_closed_forms(spark):
    """A vertical fault along the equator, a dipping one, a point; places beside, above, beyond the end."""
    vertical = [(0.0, 0.0, 2.0), (0.0, 0.5, 2.0), (0.0, 0.5, 12.0), (0.0, 0.0, 12.0)]
    flat = [(0.0, 0.0, 10.0), (0.0, 0.4, 10.0), (0.3, 0.4, 10.0), (0.3, 0.0, 10.0)]
    point = [(1.0, 1.0, 5.0)] * 4
    quads = spark.createDataFrame([(1, vertical), (2, flat), (3, point), (4, vertical), (4, [(0.9, 0.0, 0.0), (0.9, 0.5, 0.0), (0.9, 0.5, 3.0), (0.9, 0.0, 3.0)])], f"event long, corners {CORNERS}")
    rows = [(1, "beside", 0.1, 0.25), (1, "end", 0.0, 0.7), (1, "top", 0.0, 0.25), (2, "above", 0.15, 0.2), (2, "beside", -0.2, 0.2), (3, "on", 1.0, 1.0), (3, "off", 1.2, 1.0), (4, "two", 0.8, 0.25), (9, "none", 0.0, 0.0)]
    got = {(r["event"], r["station"]): (r["rrup_km"], r["rjb_km"]) for r in ru.distances(spark.createDataFrame(rows, "event long, station string, lat double, lon double"), quads).collect()}
    want = {(1, "beside"): (math.hypot(0.1 * KM, 2), 0.1 * KM), (1, "end"): (math.hypot(0.2 * KM, 2), 0.2 * KM), (1, "top"): (2, 0), (2, "above"): (10, 0), (2, "beside"): (math.hypot(0.2 * KM, 10), 0.2 * KM), (3, "on"): (5, 0), (3, "off"): (math.hypot(0.2 * KM, 5), 0.2 * KM), (4, "two"): (0.1 * KM, 0.1 * KM)}
    for k, (a, b) in want.items():
        # chords and arcs differ a little
        assert got[k][0] == pytest.approx(a, abs=0.12) and got[k][1] == pytest.approx(b, abs=0.12), k
    assert got[9, "none"] == (None, None)


def brute(p, corners):
    """The least distance over a fine grid of each triangle's points."""
    def xyz(lat, lon, z):
        a, b = math.radians(lat), math.radians(lon)
        return (EARTH_KM - z) * np.array([math.cos(a) * math.cos(b), math.cos(a) * math.sin(b), math.sin(a)])

    q, best = [xyz(*c) for c in corners], 1e9
    for i, j, k in ru.TRIANGLES:
        u, v = np.meshgrid(np.linspace(0, 1, 301), np.linspace(0, 1, 301))
        ok = u + v <= 1
        g = q[i] + u[ok][:, None] * (q[j] - q[i]) + v[ok][:, None] * (q[k] - q[i])
        best = min(best, float(np.sqrt(((g - xyz(*p, 0.0)) ** 2).sum(1)).min()))
    return best


def test_equals_a_search_over_points_and_cells_lose_nothing(spark):
    r = random.Random(4)
    quads, stations = [], []
    centres = [(0.2, 179.9), (89.5, 30.0), (-89.9, 10.0), (45.0, -180.0), (12.0, 0.05), (-33.0, 77.7), (60.0, 359.9)]
    for e, (lat, lon) in enumerate(centres):
        d = lambda: r.uniform(-0.3, 0.3)
        quads.append((e, [(min(90.0, max(-90.0, lat + d())), lon + d(), r.uniform(0, 20)) for _ in range(4)]))
        for k in range(60):
            stations.append((f"{e}-{k}", min(90.0, max(-90.0, lat + r.uniform(-2, 2))), (lon + r.uniform(-2, 2) + 180) % 360 - 180 if abs(lat) < 80 else r.uniform(-180, 180)))
    s, q = spark.createDataFrame(stations, "station string, lat double, lon double"), spark.createDataFrame(quads, f"event long, corners {CORNERS}")
    got = {(x["event"], x["station"]): (x["rrup_km"], x["rjb_km"]) for x in ru.within(s, q, 120.0).collect()}
    want = {}
    for e, c in quads:
        for name, lat, lon in stations:
            flat = [(a, b, 0.0) for a, b, _ in c]
            if abs(lat - c[0][0]) < 3 and (near := brute((lat, lon), flat)) <= 121:
                want[e, name] = (brute((lat, lon), c), near)
    sure = {k for k, v in want.items() if v[1] <= 119}
    assert len(sure) > 100 and sure <= {*got} <= {*want}
    assert all(abs(got[k][0] - want[k][0]) < 0.3 and abs(got[k][1] - want[k][1]) < 0.3 and got[k][0] <= want[k][0] + 1e-6 for k in got)


def test_pairs_are_met_by_compiled_steps_alone(spark):
    """One join; above it no lambda, which Spark evaluates by interpretation for each pair, and each step written once."""
    s, q = spark.createDataFrame([("a", 0.0, 0.0)], "station string, lat double, lon double"), spark.createDataFrame([(1, [(0.0, 0.0, 1.0)] * 4)], f"event long, corners {CORNERS}")
    lines = ru.within(s, q, 100.0)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = [k for k, line in enumerate(lines) if "Join" in line]
    assert len(joins) == 1
    assert not any("lambda" in line for line in lines[: joins[0] + 1])
    assert max(map(len, lines[: joins[0] + 1])) < 5000


def test_events_of_several_quads_and_stations_of_two_places(spark):
    """The nearest by Rrup may be beyond km by Rjb; a station's two places count as one; what isn't known gives no row."""
    deep, shallow = [(0.0, lon, 60.0) for lon in (0.0, 0.01, 0.01, 0.0)], [(1.0, lon, 0.0) for lon in (0.0, 0.01, 0.01, 0.0)]
    quads = [(1, deep), (1, shallow), (2, deep), (3, shallow), (4, None), (5, [(0.0, 0.0, None)] * 4)]
    places = [("a", 0.44, 0.0), ("b", 0.44, 0.0), ("b", 0.7, 0.0), ("b", 0.7, 0.0), ("c", 5.0, 0.0), ("d", None, 0.0)]
    s, q = spark.createDataFrame(places, "station string, lat double, lon double"), spark.createDataFrame(quads, f"event long, corners {CORNERS}")
    got = {(r["event"], r["station"]): (r["rrup_km"], r["rjb_km"]) for r in ru.within(s, q, 50.0).collect()}
    want = {(1, "a"): (0.56 * KM, 0.44 * KM), (1, "b"): (0.3 * KM, 0.3 * KM), (2, "a"): (math.hypot(0.44 * KM, 60), 0.44 * KM), (2, "b"): (math.hypot(0.44 * KM, 60), 0.44 * KM), (3, "b"): (0.3 * KM, 0.3 * KM)}
    got = {k: v for k, v in got.items() if k[0] != 5}  # its projection is known, its depth is not
    assert {*got} == {*want}
    assert all(got[k] == pytest.approx(v, abs=0.5) for k, v in want.items())
