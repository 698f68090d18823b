"""Duplicates equal the rule replayed trace by trace, across cells, poles and the date line."""

import random

import pytest

from smframe.operators import duplicates as du

SCHEMA = "event int, n int, network string, station string, location string, channel string, lat double, lon double, process_level string, source_format string, start long, npts int, sampling_rate double"


def replay(rows, tolerance):
    """Every newcomer against the whole list of those kept."""
    kept, gone = [], {}
    way = lambda c: "1" if c[2] in "1N" else "2" if c[2] in "2E" else "Z"
    for t in sorted(rows, key=lambda r: r["n"]):
        def same(o, t=t):
            if o["event"] != t["event"] or o["station"] != t["station"] or o["channel"][:2] != t["channel"][:2] or way(o["channel"]) != way(t["channel"]):
                return False
            return (o["network"], o["location"]) == (t["network"], t["location"]) or (None not in (o["lat"], t["lat"]) and du.haversine_m((o["lat"], o["lon"]), (t["lat"], t["lon"])) < tolerance)

        hit = next((o for o in kept if same(o)), None)
        if hit is None:
            kept.append(t)
        elif du.preferred(t, hit):
            kept.remove(hit)
            kept.append(t)
            gone[hit["n"]] = t["n"]
        else:
            gone[t["n"]] = hit["n"]
    return gone


@pytest.mark.parametrize("tolerance", [500.0, 120.0, 0.0])
def test_equals_the_rule_in_order(spark, tolerance):
    r = random.Random(int(tolerance))
    names = SCHEMA.replace(",", "").split()[::2]
    rows = []
    for k in range(900):
        lat, lon = r.choice([(34.0, -118.0), (0.0, 179.9999), (89.9999, 12.0)])
        lon = lon + r.uniform(-0.012, 0.012)
        place = (lat + r.uniform(-0.008, 0.00009), (lon + 180) % 360 - 180) if r.random() < 0.95 else (None, None)
        rows.append(dict(zip(names, (r.randrange(2), k, r.choice("AB"), r.choice(["S1", "S2"]), r.choice(["--", "00", "10", "20", "30"]) + str(k) * (r.random() < 0.7), r.choice(["HN1", "HNN", "HNE", "HN2", "HNZ", "BNZ"]), *place, r.choice(["V0", "V1", "V2"]), r.choice(["cosmos", "dmg", "knet"]), r.choice([0, None, 5]), r.randrange(3), r.choice([50.0, 100.0])))))
    d = spark.createDataFrame([tuple(x.values()) for x in rows], SCHEMA).repartition(5)
    got = {x["arrival"]: x["removed_by"] for x in du.removed(d, ["event"], "n", tolerance).collect()}
    assert got == replay(rows, tolerance) and len(got) > 20
    assert du.without_duplicates(d, ["event"], "n", tolerance).count() == len(rows) - len(got)


def test_preferences():
    t = {"process_level": "V0", "source_format": "cosmos", "start": 5, "npts": 10, "sampling_rate": 100.0, "location": "00"}
    assert du.preferred(t, t)
    assert du.preferred(t | {"process_level": "V1"}, t) and not du.preferred(t | {"process_level": "V2"}, t)
    assert not du.preferred(t | {"source_format": "dmg"}, t) and du.preferred(t | {"source_format": "other", "npts": 11}, t)
    assert not du.preferred(t | {"start": None}, t) and not du.preferred(t | {"npts": 9}, t) and du.preferred(t | {"sampling_rate": 200.0}, t) and not du.preferred(t | {"location": "10"}, t)
    assert not du.preferred(t | {"location": "--"}, t) and du.preferred(t, t | {"location": "--"})


def test_empty(spark):
    assert du.removed(spark.createDataFrame([], SCHEMA), ["event"], "n").collect() == []
