"""Metric documents come back with the digits that the format keeps."""

import pytest

from smframe.sources import metric_xml as mx

SCHEMA = "record string, type string, units string, period double, damping double, component string, original_channel string, percentile double, value double"
ROWS = [
    ("a", "SA", "%g", 1.0, 0.05, "H1", "HNE", None, 12.3456789012), ("a", "SA", "%g", 1.0, 0.05, "RotD", None, 50.0, 1.5e-9), ("a", "SA", "%g", 0.3, 0.05, "H1", "HNE", None, -7.0),
    ("a", "PGA", "cm/s^2 & <more>", None, None, "GreaterOfTwoHorizontals", None, None, 123456789.123), ("b", "PGV", None, None, None, "Z", 'H"Z', None, None), (None, "PGA", "%g", None, None, "H2", "HN2", None, 3.0),
]


def test_round_trip(spark):
    d = spark.createDataFrame(ROWS, SCHEMA)
    docs = mx.waveform_documents(d, ["record"])
    text = {r["record"]: r["document"] for r in docs.collect()}
    assert text["a"].startswith("<waveform_metrics>") and '<sa units="%g" period="1.000" damping="0.05"><H1 original_channel="HNE">12.345679</H1>' in text["a"]
    got = {(r["record"], r["type"], r["period"], r["component"]): r for r in mx.waveform_metrics(docs, ["record"]).collect()}
    assert len(got) == len(ROWS) and all(r["problem"] is None for r in got.values())
    for record, kind, units, period, damping, component, channel, percentile, value in ROWS:
        r = got[record, kind.lower(), period, component]
        assert (r["units"], r["damping"], r["original_channel"], r["percentile"]) == (units or "", damping, channel, percentile)
        assert r["value"] == pytest.approx(value, rel=6e-8) if value is not None else r["value"] != r["value"]


def test_stations_broken_documents_and_inserts(spark):
    s = spark.createDataFrame([("a", 12.345, None, 271.0), ("b", 1.0, 2.0, None)], "record string, epicentral double, rupture double, back_azimuth double")
    docs = mx.station_documents(s, ["record"], ["epicentral", "rupture"])
    got = {(r["record"], r["name"]): (r["value"], r["units"]) for r in mx.station_metrics(docs, ["record"]).collect()}
    assert got == {("a", "epicentral"): (12.35, "km"), ("a", "back_azimuth"): (271.0, None), ("b", "epicentral"): (1.0, "km"), ("b", "rupture"): (2.0, "km")}
    bad = spark.createDataFrame([("x", "<waveform_metrics><sa"), ("y", None), ("z", "<other/>"), ("w", '<waveform_metrics><pga units="g"><H1>abc</H1></pga></waveform_metrics>')], "record string, document string")
    assert {r["record"] for r in mx.waveform_metrics(bad, ["record"]).where("problem is not null").collect()} == {"x", "y", "z", "w"}
    new = spark.createDataFrame([("a", "new"), ("c", "new"), (None, "new")], "record string, document string")
    old = spark.createDataFrame([("a", "old"), ("b", "old"), (None, "old")], "record string, document string")
    assert sorted(map(str, [tuple(r) for r in mx.inserted(old, new, ["record"]).collect()])) == sorted(map(str, [("a", "old"), ("b", "old"), (None, "old"), ("c", "new")]))
    assert sorted(map(str, [tuple(r) for r in mx.inserted(old, new, ["record"], True).collect()])) == sorted(map(str, [("a", "new"), ("b", "old"), (None, "new"), ("c", "new")]))
