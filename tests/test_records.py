"""Readers on small files written here in each format."""

import datetime

import pytest

from smframe.plans import reader_queries
from smframe.sources import records

KNET = "\n".join(
    ["Origin Time       2008/06/14 08:43:00", "Lat.              39.0", "Long.             140.8", "Depth. (km)       8", "Mag.              7.2", "Station Code      ABC001", "Station Lat.      40.5", "Station Long.     139.9", "Station Height(m) 42",
     "Record Time       2008/06/14 08:44:18", "Sampling Freq(Hz) 100Hz", "Duration Time(s)  0.1", "Dir.              {}", "Scale Factor      2000(gal)/1000", "Max. Acc. (gal)   1", "Last Correction   2008/06/14 08:44:03", "Memo.", " 1 2 3 4 5 6 7 8", " -9 10", ""]
)
KEYS = {"EVENT_NAME": "X", "NETWORK": "HI", "STATION_CODE": "ARS", "STATION_LATITUDE_DEGREE": "37.6", "STATION_LONGITUDE_DEGREE": "22.7", "STATION_ELEVATION_M": "34", "STREAM": "HNZ", "SAMPLING_INTERVAL_S": "0.005", "DATE_TIME_FIRST_SAMPLE_YYYYMMDD_HHMMSS": "20190728_160919.870", "LOW_CUT_FREQUENCY_HZ": "0.1", "HIGH_CUT_FREQUENCY_HZ": "30"}
ESM = "\n".join([f"{k}: {v}" for k, v in KEYS.items()] + [f"USER{i}: " for i in range(64 - len(KEYS))] + ["0.5", "-1.5e-1", ""])
AT2 = "TITLE\nSomewhere, 1/1/2000, STA, HNE\nACCELERATION TIME SERIES IN UNITS OF G\nNPTS=   5, DT=   .0200 SEC,\n  .1000000E-01  .2 .3\n -.4 .5\n"
CWB = "\n".join(
    ["#Earthquake Information", "#StationCode: TAP001", "#StationLongitude(E): 121.5", "#StationLatitude(N): 24.9", "#StartTime(GMT+8): 2018/02/06-23:50:00.000", "#SampleRate(Hz): 200", *["#More: 1"] * 15, "#Data: 4F10.3", "     0.000    -1.000     2.000     3.000", "     0.005    -4.000     5.000     6.000", ""]
)
NSMN = "\n".join(["STRONG GROUND MOTION RECORDS OF TURKIYE", "PLACE : Bodrum", *["-"] * 4, "STATION ID : 4809", "COORDINATES : 37.03N - 27.43E", "ALTITUDE (m) : 6", "TYPE : X", "SERIAL : 1", "TIME : 20/07/2017 22:30:58.000000 (GMT)", "NUMBER OF DATA : 2", "INTERVAL : 0.01", *["-"] * 4, "  1.0  2.0  3.0", " -4.0 -5.0 -6.0", ""])


@pytest.fixture(scope="module")
def traces(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("records")
    for name, text in {"a.NS": KNET.format("N-S"), "b.UD2": KNET.format("3"), "sub/c.ASC": ESM.replace("\n", "\r\n"), "d.AT2": AT2, "f.cwb": CWB, "g.nsmn": NSMN, "e.txt": "nothing"}.items():
        (d / name).parent.mkdir(exist_ok=True)
        (d / name).write_text(text)
    return str(d)


def test_every_format(spark, traces):
    rows = records.read(spark, traces).collect()
    got = {r["path"].rpartition("/")[2]: r for r in rows}
    assert set(got) == {"a.NS", "b.UD2", "c.ASC", "d.AT2", "f.cwb", "g.nsmn"}
    three = {(r["format"], r["channel"]): r for r in rows if r["format"] in ("cwb", "nsmn")}
    assert three[("cwb", "HNZ")]["x"] == [-1.0, -4.0] and three[("cwb", "HN2")]["x"] == [3.0, 6.0] and three[("cwb", "HN1")]["lat"] == 24.9
    assert three[("nsmn", "HN1")]["x"] == [1.0, -4.0] and three[("nsmn", "HNZ")]["x"] == [3.0, -6.0]
    n = three[("nsmn", "HN2")]
    assert (n["lat"], n["lon"], n["elevation"], n["station"]) == (37.03, 27.43, 6.0, "4809") and n["start"] == datetime.datetime(2017, 7, 20, 22, 30, 58)
    assert three[("cwb", "HNZ")]["start"] == datetime.datetime(2018, 2, 6, 15, 50)
    k = got["a.NS"]
    assert k["x"] == [2.0, 4.0, 6.0, 8.0, 10.0, 12.0, 14.0, 16.0, -18.0, 20.0] and k["channel"] == "HN1" and k["structure"] == "" and k["station"] == "ABC001"
    assert k["start"] == datetime.datetime(2008, 6, 13, 23, 44, 3) and k["sampling_rate"] == 100
    assert got["b.UD2"]["channel"] == "HNZ" and got["b.UD2"]["structure"] == "borehole"
    e = got["c.ASC"]
    assert e["x"] == [0.5, -0.15] and e["sampling_rate"] == pytest.approx(200) and (e["lowcut"], e["highcut"]) == (0.1, 30) and e["start"].microsecond == 870000
    assert got["d.AT2"]["x"] == pytest.approx([9.80665, 196.133, 294.1995, -392.266, 490.3325]) and got["d.AT2"]["channel"] == "HNE"


def test_unreadable_files_are_told(spark, traces):
    got = records.unreadable(records.files(spark, traces)).collect()
    assert [r["path"].rpartition("/")[2] for r in got] == ["e.txt"]


def test_write_keeps_other_partitions(spark, traces, tmp_path):
    from pyspark.sql import functions as F

    t = records.read(spark, traces).drop("path")
    records.write(t.withColumn("label", F.lit("a")), f"{tmp_path}/w", ["label"])
    records.write(t.limit(1).withColumn("label", F.lit("b")), f"{tmp_path}/w", ["label"])
    assert {(r["label"], r["count"]) for r in spark.read.parquet(f"{tmp_path}/w").groupBy("label").count().collect()} == {("a", 10), ("b", 1)}


def as_text(kind, station, counts):
    """A file of a format with few samples: the header of the query's files, its count changed."""
    head = {**reader_queries.HEADERS}[kind].replace("{station}", station).replace("{code}", f"{station:7}")
    block = lambda per, width, f=1: "\n".join("".join(f"{v * f:{width}d}" for v in counts[i : i + per]) for i in range(0, len(counts), per))
    if kind == "geonet":
        parts = [(reader_queries.geonet_header(w).replace("{station}", station), f) for w, f in (("S16W", 1), ("N10W", 2), ("Up", 3))]
        return "\n".join(h.replace(f"{64:8}", f"{len(counts):8}") + "\n" + block(10, 8, f) for h, f in parts)
    if kind == "smc":
        head = head.replace(f"{64:10}", f"{len(counts):10}")
    if kind == "cosmos":
        return head.replace("   64  raw", f"   {len(counts)}  raw") + "\n" + block(8, 10) + "\nEnd-of-data"
    return head + "\n" + (block(8, 10) if kind in ("smc", "dmg") else "\n".join(map(str, counts)))


def parsed(spark, *texts):
    d = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string")
    return records.parse(records.sniffed(d)).orderBy("path").collect()


def test_smc_headers(spark):
    text = as_text("smc", "AB12", [1, -2, 3])
    flagged = text.replace("         3         0", "         3         1")
    blank = text.replace("\nAB12\n", "\n*\n").replace("    -32768" * 8 + "\n" + "    -32768" * 8, "    -32768" * 5 + "      1675" + "    -32768" * 2 + "\n" + "    -32768" * 8)
    rows = parsed(spark, text, flagged, blank)
    assert [(r["path"], r["station"]) for r in rows] == [("0", "AB12"), ("2", "1675")]
    one = rows[0]
    assert (one["channel"], one["location"], one["network"], one["structure"]) == ("HN1", "--", "US", "")
    assert one["start"] == datetime.datetime(1989, 10, 18, 0, 4, 5, 250000) and (one["lat"], one["lon"], one["elevation"]) == (37.5, -122.25, 0.0)
    assert [r["x"] for r in rows] == [[1.0, -2.0, 3.0]] * 2


def test_cosmos_headers(spark):
    text = as_text("cosmos", "J2236", [1, -2, 3])
    galileo = text.replace("       0       1      50", "       2       1      11", 1)
    degrees = text.replace("       0       1      50", "       2       1      25", 1)
    named = text.replace("| none", "|<SCNL>1795.HNE.NP.01    <AUTH> 2019")
    two = text + "\n" + text.replace("     340", "     400")
    r = {k: [t for t in parsed(spark, text, galileo, degrees, named, two) if t["path"] == k] for k in "01234"}
    first = r["0"][0]
    assert (first["network"], first["station"], first["location"], first["channel"], first["units"], first["structure"]) == ("CE", "J2236", "02", "HN1", "counts", "Building")
    assert first["start"] == datetime.datetime(2005, 6, 16, 20, 53, 4, 400000) and (first["lat"], first["lon"], first["elevation"], first["sampling_rate"]) == (34.046, -117.035, 15.0, 100.0)
    assert first["x"] == [1.0, -2.0, 3.0] and r["1"][0]["x"] == pytest.approx([0.980665, -1.96133, 2.941995]) and r["1"][0]["units"] == "cm/s^2"
    assert r["2"][0]["x"] is None and r["2"][0]["units"] is None
    assert (r["3"][0]["station"], r["3"][0]["network"], r["3"][0]["location"]) == ("1795", "NP", "01")
    assert sorted(t["channel"] for t in r["4"]) == ["HN1", "HNZ"]


def test_geonet_directions(spark):
    text = as_text("geonet", "WPWS", [10, -20, 30])
    same = text.replace("N10W", "S20W")
    west = text.replace("S16W", "S80W").replace("N10W", "N80E")
    r = parsed(spark, text, same, west)
    assert [t["channel"] for t in r] == ["HN1", "HN2", "HNZ"] * 2 + ["HN2", "HN1", "HNZ"]
    assert r[0]["x"] == [1.0, -2.0, 3.0] and r[2]["x"] == [3.0, -6.0, 9.0] and r[0]["sampling_rate"] == 50
    assert r[0]["start"] == datetime.datetime(2018, 2, 12, 21, 15, 17) and r[0]["lat"] == pytest.approx(-39.943889) and r[0]["lon"] == pytest.approx(176.584444)


def test_dmg_headers(spark):
    text = as_text("dmg", "36456", [10, -20, 30]).replace("   64", "    3")
    tenths, strange = text.replace("CM/SEC/SEC", "G/10"), text.replace("CM/SEC/SEC", "FURLONGS")
    summer, two = text.replace("1983 16:42 PDT", "1983 23:42 UTC"), text + "\n/& END\n" + text.replace("   90", "  500")
    r = parsed(spark, text, tenths, strange, summer, two)
    assert [(t["path"], t["channel"]) for t in r[:4]] == [(k, "BN2") for k in "0123"] and sorted(t["channel"] for t in r[4:]) == ["BN2", "BNZ"]
    assert [t["x"] for t in r] == [[10.0, -20.0, 30.0], pytest.approx([980.665, -1961.33, 2941.995]), None, *[[10.0, -20.0, 30.0]] * 3]
    first = r[0]
    assert (first["station"], first["network"], first["lat"], first["lon"], first["lowcut"], first["highcut"]) == ("36456", "CE", 35.908, -120.458, 0.1, 23.0)
    assert first["start"] == datetime.datetime(1983, 5, 2, 23, 42, 48, 200000) and r[3]["start"] == datetime.datetime(1983, 5, 2, 16, 42, 48, 200000)


def test_headers_that_say_nothing_give_nulls(spark):
    """Files cut off after their first lines, empty and null texts don't stop the others."""
    cut = ["\n".join(as_text(k, "AB1", [1]).split("\n")[:n]) for k in reader_queries.HEADERS for n in (1, 4, 14)]
    whole = as_text("esm", "AB1", [1])
    rows = parsed(spark, *cut, "", None, whole)
    assert rows[-1] is not None and [r["x"] for r in rows if r["path"] == str(len(cut) + 2)] == [[1.0]]
