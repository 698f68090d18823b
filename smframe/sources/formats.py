"""Text record formats as expressions: each reader turns the text of one file into an array of traces, without a scan of its own.

A reader is a function of (text, lines). What a file lacks is null. Times are UTC. Samples are in cm/s^2 where units
says so; counts stay counts. A channel whose direction the header doesn't tell is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from smframe.functions.arrays import let

TRACE = {
    "format": "string", "network": "string", "station": "string", "location": "string", "channel": "string", "start": "timestamp", "sampling_rate": "double", "lat": "double", "lon": "double", "elevation": "double",
    "units": "string", "structure": "string", "lowcut": "double", "highcut": "double", "x": "array<double>",
}
NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
G = 980.665


def trace(**given) -> Column:
    """One trace; what isn't given is null, but location, units and structure have defaults."""
    given = {"location": F.lit("--"), "units": F.lit("cm/s^2"), "structure": F.lit("")} | given
    return F.struct(*(given.get(k, F.lit(None)).cast(t).alias(k) for k, t in TRACE.items()))


def numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda v: v.cast("double"))


def after(lines: Column, rows: int) -> Column:
    """The text behind the first rows."""
    return F.array_join(F.slice(lines, rows + 1, F.greatest(F.size(lines) - rows, F.lit(0))), " ")


def at(lines: Column, row: Column | int) -> Column:
    return F.get(lines, F.lit(row) if isinstance(row, int) else row)


def word(line: Column, n: int) -> Column:
    return F.get(F.split(F.trim(line), r"\s+"), F.lit(n))


def first_double(c: Column) -> Column:
    return F.regexp_extract(c, NUMBER, 0).try_cast("double")


def fixed(lines: Column, first: Column | int, rows: Column | int, width: Column | int) -> Column:
    """The numbers of fields of equal width in rows from first on (from 0); null where a field isn't a number."""
    first, rows, width = (F.lit(c) if isinstance(c, int) else c for c in (first, rows, width))
    cut = F.concat(F.lit(".{1,"), width.cast("string"), F.lit("}"))
    fields = F.flatten(F.transform(F.slice(lines, first + 1, F.greatest(rows, F.lit(0))), lambda r: F.regexp_extract_all(F.rtrim(r), cut, F.lit(0))))
    return F.transform(fields, lambda v: F.trim(v).try_cast("double"))


def without(values: Column, missing: Column) -> Column:
    """values with null for the number that marks what is missing."""
    return let(missing, lambda m: F.transform(values, lambda v: F.when(m.isNull() | (v != m), v)))


def band(rate: Column) -> Column:
    return F.when((rate >= 10) & (rate < 80), "B").otherwise("H")


def channel(rate: Column, kind: Column) -> Column:
    """Band, N, and 1 (north), 2 (east) or Z."""
    return F.concat(band(rate), F.lit("N"), kind)


def north_or_east(angle: Column) -> Column:
    """1 where the azimuth lies nearer to north or south, else 2."""
    return F.when((angle > 315) | (angle < 45) | ((angle > 135) & (angle < 225)), "1").when(angle.isNotNull(), "2")


def moment(year, month, day, hour, minute, second) -> Column:
    """A time, or null where a part is missing or out of range."""
    return F.try_make_timestamp(*(c.cast("int") for c in (year, month, day, hour, minute)), second)


def knet(text: Column, lines: Column) -> Column:
    """Counts times the scale factor, in cm/s^2. Record times are Japanese and 15 s late."""
    rate = F.regexp_extract(word(at(lines, 10), 2), r"\d+", 0).try_cast("double")
    way = word(at(lines, 12), 1)
    kind = F.when(way.isin("N-S", "1", "4"), "1").when(way.isin("E-W", "2", "5"), "2").when(way.isin("U-D", "3", "6"), "Z")
    scale = F.regexp_extract(at(lines, 13), r"([\d.]+)\(gal\)/", 1).try_cast("double") / F.regexp_extract(at(lines, 13), r"/([\d.]+)", 1).try_cast("double")
    when = F.try_to_timestamp(F.concat_ws(" ", word(at(lines, 9), 2), word(at(lines, 9), 3)), F.lit("yyyy/MM/dd HH:mm:ss")) - F.expr("INTERVAL '9:00:15' HOUR TO SECOND")
    n = F.greatest((word(at(lines, 11), 2).try_cast("double") * rate).cast("int"), F.lit(0))
    x = let(scale, lambda s: F.transform(F.slice(numbers(after(lines, 17)), F.lit(1), n), lambda v: v * s))
    return F.array(trace(format=F.lit("knet"), network=F.lit("BO"), station=word(at(lines, 5), 2), channel=channel(rate, kind), start=when, sampling_rate=rate, lat=word(at(lines, 6), 2).try_cast("double"),
        lon=word(at(lines, 7), 2).try_cast("double"), elevation=word(at(lines, 8), 2).try_cast("double"), structure=F.when(way.isin("1", "2", "3"), "borehole").otherwise(""), x=x))


def esm(text: Column, lines: Column) -> Column:
    """64 lines of KEY: value, then one sample a line, in cm/s^2."""
    value = lambda key: F.trim(F.regexp_extract(text, f"(?m)^{key}:(.*)$", 1))
    number = lambda key: first_double(value(key))
    when = F.try_to_timestamp(F.regexp_replace(value("DATE_TIME_FIRST_SAMPLE_YYYYMMDD_HHMMSS"), r"^(\d{8}_\d{6})$", "$1.000"), F.lit("yyyyMMdd_HHmmss.SSS"))
    return F.array(trace(format=F.lit("esm"), network=value("NETWORK"), station=value("STATION_CODE"), channel=value("STREAM"), start=when, sampling_rate=F.try_divide(F.lit(1.0), number("SAMPLING_INTERVAL_S")),
        lat=number("STATION_LATITUDE_DEGREE"), lon=number("STATION_LONGITUDE_DEGREE"), elevation=number("STATION_ELEVATION_M"), lowcut=number("LOW_CUT_FREQUENCY_HZ"), highcut=number("HIGH_CUT_FREQUENCY_HZ"), x=numbers(after(lines, 64))))


def at2(text: Column, lines: Column) -> Column:
    """Four title lines, then samples in g; given in cm/s^2. The last field of the second line but units names the channel."""
    dt = F.regexp_extract(at(lines, 3), rf"DT\s*=\s*({NUMBER})", 1).try_cast("double")
    n = F.regexp_extract(at(lines, 3), r"NPTS\s*=\s*(\d+)", 1).try_cast("int")
    title = F.split(at(lines, 1), r"\s*,\s*")
    x = F.transform(F.slice(numbers(after(lines, 4)), F.lit(1), n), lambda v: v * G)
    return F.array(trace(format=F.lit("at2"), network=F.lit(""), station=F.get(title, F.lit(2)), channel=F.get(title, F.lit(3)), sampling_rate=F.try_divide(F.lit(1.0), dt), x=x))


def columns_of(values: Column, per: int, kinds: dict[int, str], rate: Column, **given) -> Column:
    """Traces of the columns kinds of a table of per columns; kinds says which component each is."""

    def one(v, k, kind):
        return trace(channel=channel(rate, F.lit(kind)), sampling_rate=rate, x=F.filter(v, lambda _, i: i % per == k), **given)

    return let(values, lambda v: F.array(*(one(v, k, kind) for k, kind in kinds.items())))


def nsmn(text: Column, lines: Column) -> Column:
    """18 header lines, then columns of north, east and up in cm/s^2: three traces a file."""
    value = lambda k: F.trim(F.regexp_extract(at(lines, k), r"^[^:]*:(.*)$", 1))
    spot = F.regexp_extract_all(F.regexp_replace(value(7), "-", ""), F.lit(NUMBER), F.lit(0))
    when = F.try_to_timestamp(F.regexp_extract(value(11), r"\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}\.\d+", 0), F.lit("dd/MM/yyyy HH:mm:ss.SSSSSS"))
    return columns_of(numbers(after(lines, 18)), 3, {0: "1", 1: "2", 2: "Z"}, F.try_divide(F.lit(1.0), first_double(value(13))), format=F.lit("nsmn"), network=F.lit("TK"), station=value(6), start=when,
        lat=F.get(spot, F.lit(0)), lon=F.get(spot, F.lit(1)), elevation=F.coalesce(first_double(value(8)), F.lit(0.0)))


def cwb(text: Column, lines: Column) -> Column:
    """22 header lines of #Key: value, then columns of time, up, north and east in cm/s^2; times are eight hours ahead."""
    value = lambda key: F.trim(F.regexp_extract(text, f"(?m)^#{key}[^:\\n]*:(.*)$", 1))
    when = F.try_to_timestamp(F.substring(F.regexp_replace(value("StartTime"), r"[-T ]", "/"), 1, 19), F.lit("yyyy/MM/dd/HH:mm:ss")) - F.expr("INTERVAL '8' HOUR")
    return columns_of(numbers(after(lines, 22)), 4, {1: "Z", 2: "1", 3: "2"}, first_double(value("SampleRate")), format=F.lit("cwb"), network=F.lit("TW"), station=value("StationCode"), start=when,
        lat=first_double(value("StationLatitude")), lon=first_double(value("StationLongitude")), elevation=F.lit(0.0))


#: What kind of structure an SMC file's header means.
SMC_STRUCTURES = {1: "building", 2: "bridge", 3: "dam"}


def smc(text: Column, lines: Column) -> Column:
    """11 text lines, 6 of eight integers, 10 of five reals, comments, then eight samples of ten characters a line, in cm/s^2.

    Files with the problem flag set have no trace. Positive longitudes are west. Milliseconds of the start count.
    """

    def with_headers(h):
        whole = lambda k: F.get(h["i"], F.lit(k))
        real = lambda k: F.get(h["f"], F.lit(k))
        code = F.trim(F.regexp_replace(F.substring(F.trim(at(lines, 2)), 1, 4), "\u0000", ""))
        station = F.when((F.length(F.trim(at(lines, 2))) >= 4) & (code != ""), code).otherwise(whole(29).cast("long").cast("string"))
        year = F.when(whole(1) == 0, word(at(lines, 3), 0).try_cast("double")).otherwise(whole(1))
        day = F.date_add(F.make_date(year.cast("int"), F.lit(1), F.lit(1)), (whole(2) - 1).cast("int"))
        second = F.coalesce(whole(5), F.lit(0.0)) + F.coalesce(whole(6), F.lit(0.0)) / 1000
        floor = whole(24).cast("long").cast("string")
        way, tilt, rate = whole(13), whole(12), real(1)
        kind = F.when(tilt.isin(0.0, 180.0), "Z").when(((way > 315) & (way <= 360)) | ((way > 0) & (way <= 45)) | ((way > 135) & (way <= 225)), "1").otherwise("2")
        what = whole(18).cast("int")
        structure = F.coalesce(*(F.when(what == k, v) for k, v in SMC_STRUCTURES.items()), F.when(what.isNull(), "").otherwise("other"))
        n = F.coalesce(whole(16).cast("int"), F.lit(0))
        x = F.slice(fixed(lines, 27 + F.coalesce(whole(15).cast("int"), F.lit(0)), F.ceil(n / 8).cast("int"), 10), F.lit(1), F.greatest(n, F.lit(0)))
        made = trace(format=F.lit("smc"), network=F.when(at(lines, 7).contains("USGS"), "US").otherwise("--"), station=station, location=F.coalesce(F.lpad(floor, F.greatest(F.length(floor), F.lit(2)), F.lit("0")), F.lit("--")), channel=channel(rate, kind),
            start=moment(F.year(day), F.month(day), F.day(day), whole(3), whole(4), second), sampling_rate=rate, lat=real(10), lon=-F.abs(real(11)), elevation=F.coalesce(real(12), F.lit(0.0)), structure=structure, x=x)
        return F.when(F.coalesce(whole(17) == 1, F.lit(False)), F.slice(F.array(made), 1, 0)).otherwise(F.array(made))

    told = lambda header: let(header, lambda h: without(h, F.get(h, F.lit(0))))
    return let(F.struct(told(fixed(lines, 11, 6, 10)).alias("i"), told(fixed(lines, 17, 10, 15)).alias("f")), with_headers)


def parts(text: Column, mark: str) -> Column:
    """The lines of each part of a file; a part begins with a line that matches mark."""
    return F.transform(F.filter(F.split(text, f"(?m)^(?=[^\\n]*{mark})"), lambda p: F.trim(F.split(p, "\n", 2)[0]).rlike(mark)), lambda p: F.split(p, "\n"))


def geonet(text: Column, lines: Column) -> Column:
    """Three components a file, each of 16 text lines, 10 lines of ten numbers and rows of ten samples in mm/s^2; of corrected files the acceleration.

    Where neighbours have one direction, the later one takes the other. The band is always H. Milliseconds of the start count.
    """

    def component(p):
        way = word(at(p, 12), 1)
        angle = F.regexp_extract(way, r"\d+", 0).try_cast("double")
        first, last = F.upper(F.substring(way, 1, 1)), F.upper(F.substring(way, -1, 1))
        turned = F.when(first == "N", F.when(last == "E", angle).otherwise(360 - angle)).otherwise(F.when(last == "E", 180 - angle).otherwise(180 + angle))
        alone = F.when(way == "N", 0).when(way == "E", 90).when(way == "S", 180).when(way == "W", 270)
        return F.when(F.lower(way).isin("up", "down"), "Z").otherwise(north_or_east(F.coalesce(alone, turned)))

    def kinds(all_parts):
        """Of the three components, each after the first differs from the one before it, as the file gives that."""
        own = F.transform(all_parts, component)
        flip = lambda c: F.translate(c, "12", "21")
        return let(own, lambda c: F.transform(c, lambda k, i: F.when((i > 0) & (k == F.get(c, i - 1)), flip(k)).otherwise(k)))

    def one(p, kind):
        def with_header(h):
            v = lambda r, c: F.get(h, F.lit(10 * r + c))
            rate = F.try_divide(F.lit(1.0), v(6, 5))
            n = F.when(F.lower(at(p, 0)).contains("uncorrected"), v(3, 0)).otherwise(v(3, 3)).cast("int")
            x = F.transform(F.slice(fixed(p, 26, F.ceil(n / 10).cast("int"), 8), F.lit(1), F.greatest(n, F.lit(0))), lambda a: a / 10)
            degrees = lambda c: v(2, c) + v(2, c + 1) / 60 + v(2, c + 2) / 3600
            return trace(format=F.lit("geonet"), network=F.lit("NZ"), station=word(at(p, 1), 1), channel=F.concat(F.lit("HN"), kind), start=moment(v(0, 8), v(0, 9), v(1, 8), v(1, 9), v(3, 8), v(3, 9) / 1000), sampling_rate=rate,
                lat=-degrees(0), lon=degrees(3), elevation=F.lit(0.0), x=x)

        return let(numbers(F.array_join(F.slice(p, 17, 10), " ")), with_header)

    return let(F.slice(parts(text, "GNS Science"), 1, 3), lambda a: F.zip_with(a, kinds(a), one))


#: Network codes by the number in a COSMOS header (199 is unspecified).
COSMOS_NETWORKS = {
    1: "C_", 2: "NP", 3: "RE", 4: "A_", 5: "CE", 6: "CI", 7: "BK", 8: "NC", 9: "SB", 10: "AZ", 14: "NN", 15: "UW", 16: "TO", 17: "AA", 20: "WR", 21: "PG", 30: "US", 31: "GS", 32: "IU", 33: "CU", 34: "NQ", 35: "US",
    36: "AG", 37: "AK", 38: "AO", 39: "AV", 40: "ET", 46: "LD", 47: "LL", 48: "MB", 49: "NE", 50: "NM", 51: "UW", 52: "UU", 53: "WY", 54: "PR", 55: "CO", 56: "HV", 57: "IC", 58: "II", 59: "IW", 60: "NA", 61: "TA",
    62: "TR", 63: "C", 64: "SN", 100: "TW", 107: "BG", 110: "BO", 111: "UO", 199: "--", 200: "KD",
}
#: Components by orientation codes beyond azimuths.
COSMOS_KINDS = {400: "Z", 401: "Z", 402: "Z", 500: "1", 501: "2", 600: "1", 601: "2", 700: "1", 701: "2"}
#: Units by their number, with the factor to the unit beside it.
COSMOS_UNITS = {2: ("cm/s^2", G), 4: ("cm/s^2", 1.0), 5: ("cm/s", 1.0), 6: ("cm", 1.0), 7: ("cm/s^2", 2.54), 8: ("cm/s", 2.54), 9: ("cm", 2.54), 10: ("cm/s^2", 1.0), 11: ("cm/s^2", G / 1000), 50: ("counts", 1.0)}
#: Station types.
COSMOS_STATIONS = {
    1: "Small fiberglass shelter", 2: "Small prefabricated metal bldg", 3: "Sensors buried/set in ground", 4: "Reference station", 5: "Base of building", 6: "Freefield, Unspecified", 7: "Ocean-bottom sensors",
    8: "Sensors in small near-surface vault (1-2m deep)", 9: "Sensors in underground observatory or large vault (~3 m^3 or larger)", 10: "Building", 11: "Bridge", 12: "Dam", 13: "Wharf", 14: "Tunnel or mine adit (3m or more from surface)",
    15: "Other lifeline structure", 20: "Other structure", 50: "Geotechnical array", 51: "Other array", 999: "Unspecified",
}


def looked_up(key: Column, of: dict) -> Column:
    return F.element_at(F.create_map(*(F.lit(v) for pair in of.items() for v in pair)), key.cast("int"))


def cosmos(text: Column, lines: Column) -> Column:
    """Any number of channels a file, each of 14 text lines, integers, reals, comments and samples whose counts and widths stand in a line before each.

    Acceleration comes in cm/s^2, raw counts as counts; samples in units that no factor is known for are null. A comment with
    <SCNL> names station, network and location. The two-letter code before the station's is taken where the network's number is unknown.
    """

    def section(p, row):
        """n, width, first row and the row behind a block whose own line is at row."""
        line = at(p, row)
        per = F.regexp_extract(line, r"(?i)format\s*=\s*\(\s*(\d+)", 1).try_cast("int")
        n = F.regexp_extract(line, r"(\d+)", 1).try_cast("int")
        return F.struct((row + 1).alias("first"), F.ceil(F.try_divide(n, per)).cast("int").alias("rows"), F.regexp_extract(line, r"(?i)format\s*=\s*\(\s*\d+[a-z](\d+)", 1).try_cast("int").alias("width"))

    def with_section(p, row, body):
        return let(section(p, row), lambda s: body(fixed(p, s["first"], s["rows"], s["width"]), s["first"] + s["rows"]))

    def one(p):
        def unknown(first, n):
            return F.coalesce(F.trim(F.substring(at(p, 12), first, n)).try_cast("double"), F.lit(-999.0))

        def with_comments(ints, reals, row):
            count = F.regexp_extract(at(p, row), r"(\d+)", 1).try_cast("int")
            said = F.array_join(F.slice(p, row + 2, F.greatest(count, F.lit(0))), ", ")
            return with_section(p, row + 1 + count, lambda x, _: let(F.struct(without(ints, unknown(65, 7)).alias("i"), without(reals, unknown(73, 8)).alias("f"), F.filter(x, lambda v: v.isNotNull()).alias("x"), said.alias("said")), with_all))

        def with_all(h):
            whole = lambda k: F.get(h["i"], F.lit(k))
            real = lambda k: F.get(h["f"], F.lit(k))
            scnl = F.split(F.regexp_extract(h["said"], r"<SCNL>(.*?)\s", 1), r"\.")
            named = F.size(scnl) == 4
            letters = F.upper(F.substring(at(p, 4), 26, 2))
            network = F.when(whole(10).isNull(), "--").otherwise(F.coalesce(looked_up(whole(10), COSMOS_NETWORKS), F.when(letters.rlike("^[A-Z0-9]{2}$"), letters), F.lit("--")))
            known = lambda a: a.between(1, 360) | a.isin(*COSMOS_KINDS)
            turned = whole(54) + F.coalesce(whole(19), whole(20))
            angle = F.when(known(whole(53)), whole(53)).when(known(whole(54)), F.when(turned > 360, turned - 360).otherwise(turned))
            kind = let(angle, lambda a: F.coalesce(looked_up(a, COSMOS_KINDS), F.when(a.between(0, 360), north_or_east(a))))
            rate = F.try_divide(F.lit(1000.0), real(61))
            spot = whole(55).cast("int").cast("string")
            unit = whole(2)
            return trace(format=F.lit("cosmos"), network=F.when(named, F.get(scnl, F.lit(2))).otherwise(network), station=F.when(named, F.get(scnl, F.lit(0))).otherwise(F.trim(F.substring(at(p, 4), 29, 6))),
                location=F.when(named, F.get(scnl, F.lit(3))).otherwise(F.coalesce(F.lpad(spot, F.greatest(F.length(spot), F.lit(2)), F.lit("0")), F.lit("--"))), channel=channel(rate, kind),
                start=moment(whole(39), whole(41), whole(42), whole(43), whole(44), F.coalesce(real(29), F.lit(0.0))), sampling_rate=rate, lat=real(0), lon=real(1), elevation=F.coalesce(real(2), F.lit(0.0)),
                units=looked_up(unit, {k: v for k, (v, _) in COSMOS_UNITS.items()}), structure=F.coalesce(looked_up(whole(18), COSMOS_STATIONS), F.lit("")), lowcut=real(53), highcut=real(56),
                x=let(looked_up(unit, {k: v for k, (_, v) in COSMOS_UNITS.items()}), lambda f: F.when(f.isNotNull(), F.transform(h["x"], lambda v: v * f))))

        return with_section(p, F.lit(13), lambda ints, row: let(F.struct(ints.alias("i"), row.alias("row")), lambda a: with_section(p, a["row"], lambda reals, row: let(F.struct(reals.alias("f"), row.alias("row")), lambda b: with_comments(a["i"], b["f"], b["row"])))))

    return F.transform(parts(text, r"\((?i:format v)"), one)


#: Factors to cm/s^2 by what a DMG file's units look like; the first that matches holds.
DMG_UNITS = {"g/10": G / 10, r"10\*?g|g\*?10": G, "gal": 1.0, "(?<![a-z])g(?![a-z/])": G, r"cm/s(ec)?/s(ec)?|cm/s(ec)?\^?2": 1.0, "in/s(ec)?/s(ec)?": 2.54}


def dmg(text: Column, lines: Column) -> Column:
    """Corrected files: channels of 25 text lines, 7 of integers, 13 of reals, a line of units and format, and acceleration; velocity and displacement behind it are left.

    Times are Pacific where the event's line says PDT or PST. The network is read from the line on processing and must be one of the table's.
    Samples in units that no factor is known for are null.
    """

    def one(p):
        def with_headers(h):
            whole = lambda k: F.get(h["i"], F.lit(k))
            real = lambda k: F.get(h["f"], F.lit(k))
            code = F.upper(F.substring(F.element_at(F.split(F.trim(F.substr(at(p, 1), F.greatest(F.coalesce(whole(29), F.lit(0)).cast("int"), F.lit(0)) + 1)), r"\s+"), -1), 1, 2))
            day = F.regexp_extract(at(p, 4), r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}", 0)
            piece = lambda k: F.get(F.split(day, "[/-]"), F.lit(k)).try_cast("int")
            year = piece(2) + F.when(piece(2) >= 100, 0).when(piece(2) < 69, 2000).otherwise(1900)
            clock = F.split(F.regexp_extract(at(p, 4), r"\d{2}:\d{2}:[ \d]\d\.\d", 0), ":")
            when = moment(year, piece(0), piece(1), F.get(clock, F.lit(0)).try_cast("int"), F.get(clock, F.lit(1)).try_cast("int"), F.trim(F.get(clock, F.lit(2))).try_cast("double"))
            when = F.when(at(p, 3).rlike("P[DS]T"), F.to_utc_timestamp(when, "America/Los_Angeles")).otherwise(when)
            way, rate = whole(26), F.try_divide(F.lit(1.0), real(60))
            kind = F.when(way.isin(500.0, 600.0), "Z").when(way.between(0, 360), F.when((way >= 315) | (way < 45) | ((way >= 135) & (way < 225)), "1").otherwise("2"))
            spot = lambda first, n, back: let(F.trim(F.substring(at(p, 5), first, n)), lambda c: F.regexp_replace(c, "[A-Za-z]$", "").try_cast("double") * F.when(F.upper(c).endswith(back), -1.0).otherwise(1.0))
            form = F.lower(at(p, 45))
            units = F.regexp_extract(form, r"units(.*)", 1)
            factor = F.coalesce(*(F.when(units.rlike(m), F.lit(f)) for m, f in DMG_UNITS.items()))
            per = F.coalesce(F.regexp_extract(form, r"\((\d+)f\d+", 1).try_cast("int"), F.lit(8))
            width = F.coalesce(F.regexp_extract(form, r"\(\d+f(\d+)", 1).try_cast("int"), F.lit(10))
            n = F.greatest(F.coalesce(whole(52).cast("int"), F.lit(0)), F.lit(0))
            x = let(F.struct(factor.alias("k"), fixed(p, 46, F.ceil(n / per).cast("int"), width).alias("v")), lambda d: F.when(d["k"].isNotNull(), F.transform(F.slice(d["v"], F.lit(1), n), lambda v: v * d["k"])))
            return trace(format=F.lit("dmg"), network=F.when(code.isin(*COSMOS_NETWORKS.values()), code).otherwise("--"), station=F.trim(F.substring(at(p, 5), 13, 5)), channel=channel(rate, kind), start=when, sampling_rate=rate,
                lat=spot(21, 7, "S"), lon=spot(30, 8, "W"), elevation=F.lit(0.0), structure=F.trim(F.substring(at(p, 7), 47, 34)), lowcut=real(61), highcut=real(72), x=x)

        return let(F.struct(fixed(p, 25, 7, 5).alias("i"), fixed(p, 32, 13, 10).alias("f")), with_headers)

    return F.transform(parts(text, "(?<!(?i:un))(?i:corrected accelerogram)"), one)


#: What the start of a file of each format matches, and its reader.
MARKS = {
    "knet": r"^Origin Time\s+\S+",
    "esm": r"^EVENT_NAME:",
    "at2": r"(?s)^[^\n]*\n[^\n]*\n[^\n]*\n\s*NPTS\s*=\s*\d+\s*,\s*DT\s*=",
    "cwb": r"^#Earthquake Information",
    "nsmn": r"^STRONG GROUND MOTION RECORDS OF TURKIYE",
    "smc": r"^\s*(1 UNCORRECTED ACCELEROGRAM|2 CORRECTED ACCELEROGRAM)\s*(\n|$)",
    "geonet": r"^(?=[^\n]*GNS Science)[^\n]*(Corrected|Uncorrected) accelerogram",
    "dmg": r"(?i)^(?![^\n]*uncorrected)(?=[^\n]*corrected accelerogram)[^\n]*\n[^\n]*uncorrected accelerogram data(?!(?:[^\n]*\n){3}(?:[^\n]{72}(?: \d|\d)[^\n]*\n){10})",
    "cosmos": r"(?i)^(?=[^\n]*\(format v)[^\n]*(corrected acceleration|raw acceleration counts)",
}
READERS = {"knet": knet, "esm": esm, "at2": at2, "nsmn": nsmn, "cwb": cwb, "smc": smc, "geonet": geonet, "cosmos": cosmos, "dmg": dmg}
