"""Reading records: each trace at hand written in every text format, then read back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from smframe.functions import arrays
from smframe.plans.relational_queries import r6
from smframe.sources import cosmos_writer, metric_xml, miniseed, records
from smframe.sources.adapters import SQL, traces

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: Headers by format, with {station} for the code; samples follow. Their reals and integers are those of each format's header.
SMC = "\n".join(
    ["1 UNCORRECTED ACCELEROGRAM", "*", "{station}", "*", "*", "*", "*", "data source = USGS", "*", "*", "*"]
    + ["".join(f"{v:10d}" for v in line) for line in ([-32768, 1989, 291, 0, 4, 5, 250, 1], [1, 3, 3, -32768, 90, 360, 101, 1], [64, 0, *[-32768] * 6], [-32768] * 8, [-32768] * 8, [-32768] * 8)]
    + ["".join(f"{v:15.5E}" for v in line) for line in ([1.7e38, 200.0, 1.7e38, 1.7e38, 1.7e38], [1.7e38] * 5, [37.5, 122.25, 1.7e38, 1.7e38, 1.7e38], *[[1.7e38] * 5] * 7)]
    + ["| a comment"]
)


def _cosmos() -> str:
    whole, real = dict.fromkeys(range(100), -999), dict.fromkeys(range(100), -999.0)
    whole |= {0: 0, 1: 1, 2: 50, 10: 5, 18: 10, 39: 2005, 41: 6, 42: 16, 43: 20, 44: 53, 53: 340, 55: 2}
    real |= {0: 34.046, 1: -117.035, 2: 15.0, 29: 4.4, 61: 10.0, 62: 640.0}
    text = ["Raw acceleration counts   (Format v01.20 with 13 text lines)", "", "", "", "Statn No: 01-23075  Code:CE-{station}  Somewhere", *[""] * 7, "Values used when parameter or data value is unknown/unspecified:   -999, -999.0"]
    rows = lambda v, per, form: ["".join(format(v[i], form) for i in range(j, min(j + per, 100))) for j in range(0, 100, per)]
    return "\n".join([*text, " 100 Integer-header values follow on  10 lines, Format= (10I8)", *rows(whole, 10, "8d"), " 100 Real-header values follow on  17 lines, Format= (6F13.6)", *rows(real, 6, "13.6f"), '  1 Comment line(s) follow, each starting with a "|":', "| none", "   64  raw accel. pts, approx 1 secs, units=counts (50),Format=(8I10)"])


def geonet_header(way: str) -> str:
    header = [[0] * 10 for _ in range(10)]
    header[0][8:], header[1][8:], header[3][8:] = [2018, 2], [12, 21], [15, 17000]
    header[2][:6], header[3][0], header[6][5] = [39, 56, 38, 176, 35, 4], 64, 0.02
    return "\n".join(["Uncorrected accelerogram 20180212_211554 GNS Science", "Site {station}   39 56 38S  176 35 04E", *["-"] * 10, f"Component {way}", *["-"] * 3, *("".join(f"{v:8}" for v in line) for line in header)])


def _dmg() -> str:
    whole, real = {26: 90, 52: 64}, {60: 0.02, 61: 0.1, 72: 23.0}
    text = ["CORRECTED ACCELEROGRAM", "UNCORRECTED ACCELEROGRAM DATA   PROCESSED: 6/06/83, CE", "X", "MAY 2, 1983 16:42 PDT", "TRIGGER TIME: 05/02/83, 16:42:48.2 PDT", "STATION NO. {code} 35.908N, 120.458W  SMA-1", *[""] * 19]
    rows = lambda v, n, per, form: ["".join(format(v.get(i, 0), form) for i in range(j, j + per)) for j in range(0, n * per, per)]
    return "\n".join([*text, *rows(whole, 7, 16, "5d"), *rows(real, 13, 8, "10.3f"), "   64 POINTS OF ACCEL DATA EQUALLY SPACED AT  .020 SEC.  (UNITS: CM/SEC/SEC)"])


KEYS = {"NETWORK": "HI", "STATION_CODE": "{station}", "STREAM": "HNZ", "SAMPLING_INTERVAL_S": "0.005"}
HEADERS = {
    "knet": "\n".join(["Origin Time       2008/06/14 08:43:00", *["-"] * 4, "Station Code      {station}", "Station Lat.      40.5", "Station Long.     139.9", "Station Height(m) 42", "Record Time       2008/06/14 08:44:18", "Sampling Freq(Hz) 100Hz", "Duration Time(s)  0.64", "Dir.              N-S", "Scale Factor      2000(gal)/1000", *["-"] * 3]),
    "esm": "\n".join(["EVENT_NAME: X", *(f"{k}: {v}" for k, v in KEYS.items()), *(f"USER{i}: " for i in range(63 - len(KEYS)))]),
    "at2": "T\nX, 1/1/2000, {station}, HNE\nG\nNPTS=   64, DT=   .0100 SEC,",
    "cwb": "\n".join(["#Earthquake Information", "#StationCode: {station}", "#SampleRate(Hz): 200", *["#More: 1"] * 18, "#Data: 4F10.3"]),
    "nsmn": "\n".join(["STRONG GROUND MOTION RECORDS OF TURKIYE", *["-"] * 5, "STATION ID : {station}", "COORDINATES : 37.03N - 27.43E", *["-"] * 5, "INTERVAL : 0.01", *["-"] * 4]),
    "smc": SMC,
    "cosmos": _cosmos(),
    "geonet": geonet_header("S16W"),
    "dmg": _dmg(),
}


def rows(x: Column, per: int, width: int) -> Column:
    """Samples in rows of fields of equal width."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / per).cast("int")), lambda r: F.array_join(F.transform(F.slice(x, r * per + 1, F.lit(per)), lambda v: F.lpad(v.cast("string"), width, " ")), "")), "\n")


def table(x: Column, factors: tuple[int, ...]) -> Column:
    """A row of the factors' multiples for each sample."""
    return F.array_join(F.transform(x, lambda v: F.concat_ws("  ", *((v * f).cast("string") for f in factors))), "\n")


def written(kind: str, station: Column, x: Column) -> Column:
    """The text of a file of a format; its samples are whole numbers."""
    head = lambda text: F.replace(F.replace(F.lit(text), F.lit("{station}"), station), F.lit("{code}"), F.rpad(station, 7, " "))
    if kind == "geonet":
        return F.concat_ws("\n", *(part for way, f in (("S16W", 1), ("N10W", 2), ("Up", 3)) for part in (head(geonet_header(way)), rows(scaled(x, f), 10, 8))))
    body = {"cwb": lambda: table(x, (0, 1, 2, 3)), "nsmn": lambda: table(x, (1, 2, 3)), "smc": lambda: rows(x, 8, 10), "cosmos": lambda: rows(x, 8, 10), "dmg": lambda: rows(x, 8, 10), "esm": lambda: F.array_join(x.cast("array<string>"), "\n")}
    return F.concat_ws("\n", head(HEADERS[kind]), body.get(kind, lambda: F.array_join(x.cast("array<string>"), " "))(), F.lit("End-of-data" if kind == "cosmos" else ""))


def scaled(x: Column, f: int) -> Column:
    return F.transform(x, lambda v: v * f)


ORACLE["read_formats"] = "WITH RECURSIVE " + SQL + """, f AS (SELECT * FROM (VALUES ('knet', 'HN1', 2.0, 100.0), ('esm', 'HNZ', 1.0, 200.0), ('at2', 'HNE', 980.665, 100.0), ('cwb', 'HNZ', 1.0, 200.0), ('cwb', 'HN1', 2.0, 200.0), ('cwb', 'HN2', 3.0, 200.0),
    ('nsmn', 'HN1', 1.0, 100.0), ('nsmn', 'HN2', 2.0, 100.0), ('nsmn', 'HNZ', 3.0, 100.0), ('smc', 'HN1', 1.0, 200.0), ('cosmos', 'HN1', 1.0, 100.0), ('dmg', 'BN2', 1.0, 50.0), ('geonet', 'HN1', 0.1, 50.0), ('geonet', 'HN2', 0.2, 50.0), ('geonet', 'HNZ', 0.3, 50.0)) v(format, channel, k, rate)),
  s AS (SELECT trace_id, any_value(station) AS station, count(*) AS n, sum(floor(v * 1000)) AS total, max(abs(floor(v * 1000))) AS peak FROM sm GROUP BY trace_id)
  SELECT trace_id, format, channel, CASE format WHEN 'smc' THEN substr(station, 1, 4) WHEN 'dmg' THEN substr(station, 1, 5) ELSE station END AS station, rate::DOUBLE AS sampling_rate, n, round(total * k::DOUBLE, 3) + 0.0 AS total, round(peak * k::DOUBLE, 3) + 0.0 AS peak FROM s, f"""


def read_formats(spark, sf):
    x = F.transform("x", lambda v: F.floor(v * 1000).cast("long"))
    texts = traces(spark, sf).withColumn("counts", x).select(F.col("trace_id").cast("string").alias("path"), F.explode(F.array(*(written(k, F.col("station"), F.col("counts")) for k in HEADERS))).alias("text"))
    d = records.parse(records.sniffed(texts))
    return d.select(F.col("path").cast("long").alias("trace_id"), "format", "channel", "station", r6(F.col("sampling_rate")).alias("sampling_rate"), F.size("x").alias("n"),
        r6(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 3).alias("total"), r6(F.array_max(F.transform("x", lambda v: F.abs(v))), 3).alias("peak"))


QUERIES["read_formats"] = read_formats


def miniseed_round_trip(spark, sf):
    """Each trace's counts written as records of Steim-2 and read back: what is joined, and that it is whole."""
    t = traces(spark, sf).select("network", F.substring("station", 2, 5).alias("station"), "location", "channel", (F.col("trace_id") * 1_000_000).alias("start_us"), F.lit(100.0).alias("sampling_rate"), F.transform("x", lambda v: F.round(v * 10_000).cast("double")).alias("x"))
    d = miniseed.traces(miniseed.records_of(miniseed.written(t, length=256)))
    return d.select("station", "channel", "start_us", "sampling_rate", "npts", F.aggregate("x", F.lit(0.0), lambda a, v: a + v).alias("total"), F.array_max("x").alias("most"), F.element_at("x", -1).alias("last"), "integers")


QUERIES["miniseed_round_trip"] = miniseed_round_trip
ORACLE["miniseed_round_trip"] = "WITH " + SQL + """
  SELECT substr(station, 2) AS station, channel, trace_id * 1000000 AS start_us, 100.0::DOUBLE AS sampling_rate, npts::INTEGER AS npts, list_sum(list_transform(x, lambda v: round(v * 10000))) AS total,
    list_max(list_transform(x, lambda v: round(v * 10000))) AS most, round(x[-1] * 10000) AS last, true AS integers FROM tr"""


def cosmos_round_trip(spark, sf):
    """Each trace written as a COSMOS file's text and read back."""
    given = {"start": F.timestamp_micros(F.col("trace_id") * 1_000_000), "sampling_rate": F.lit(100.0), "lat": F.col("record_id") / 100.0, "lon": F.lit(-120.5), "elevation": F.lit(10.0), "units": F.lit("cm/s^2"), "structure": F.lit("Building"), "lowcut": F.lit(0.1), "highcut": F.lit(40.0)}
    t = traces(spark, sf).withColumns(given)
    d = records.parse(records.sniffed(cosmos_writer.written(t).where("problem is null").select(F.col("record").alias("path"), "text")))
    return d.select("network", "station", "location", F.right("channel", F.lit(1)).alias("way"), (F.unix_micros("start") / 1_000_000).cast("long").alias("second"), "sampling_rate", r6("lat").alias("lat"), "structure", "lowcut", "highcut", F.size("x").alias("npts"), r6(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 4).alias("total"), r6(F.element_at("x", -1), 4).alias("last"))


QUERIES["cosmos_round_trip"] = cosmos_round_trip
ORACLE["cosmos_round_trip"] = "WITH " + SQL + """
  SELECT network, station, location, channel[3] AS way, trace_id AS second, 100.0::DOUBLE AS sampling_rate, round(record_id / 100.0::DOUBLE, 6) AS lat, 'Building' AS structure, 0.1::DOUBLE AS lowcut, 40.0::DOUBLE AS highcut, npts::INTEGER AS npts, round(list_sum(x), 4) AS total, round(x[-1], 4) AS last FROM tr"""


def metric_xml_round_trip(spark, sf):
    """Each channel's peak and the larger one of both horizontals written as one XML document a record and parsed again."""
    peak = traces(spark, sf).select("record_id", "component", "channel", arrays.max_abs(F.col("x")).alias("value"))
    none = F.lit(None)
    one = peak.select("record_id", "component", F.col("channel").alias("original_channel"), "value")
    two = peak.where("component <> 'Z'").groupBy("record_id").agg(F.max("value").alias("value")).select("record_id", F.lit("GreaterOfTwoHorizontals").alias("component"), none.cast("string").alias("original_channel"), "value")
    m = one.unionByName(two).select("record_id", F.lit("PGA").alias("type"), F.lit("cm/s^2").alias("units"), none.cast("double").alias("period"), none.cast("double").alias("damping"), "component", "original_channel", none.cast("double").alias("percentile"), "value")
    d = metric_xml.waveform_metrics(metric_xml.waveform_documents(m, ["record_id"]), ["record_id"])
    return d.select("record_id", "type", "units", "component", "original_channel", r6("value", 5).alias("value"))


QUERIES["metric_xml_round_trip"] = metric_xml_round_trip
ORACLE["metric_xml_round_trip"] = "WITH " + SQL + """, p AS (SELECT record_id, component, channel, list_max(list_transform(x, lambda v: abs(v))) AS v FROM tr)
  SELECT record_id, 'pga' AS type, 'cm/s^2' AS units, component, channel AS original_channel, round(v, 5) AS value FROM p
  UNION ALL SELECT record_id, 'pga', 'cm/s^2', 'GreaterOfTwoHorizontals', NULL, round(max(v), 5) FROM p WHERE component <> 'Z' GROUP BY record_id"""
