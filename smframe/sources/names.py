"""Names and units: path and tag names, channel orientation, numbers within metric names, unit factors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nslc(network: Column, station: Column, location: Column, channel: Column) -> Column:
    return F.concat_ws(".", network, station, location, channel)


def nslct(network: Column, station: Column, location: Column, channel: Column, tag: Column) -> Column:
    return F.concat_ws("_", nslc(network, station, location, channel), tag)


def nslit(network: Column, station: Column, location: Column, channel: Column, tag: Column) -> Column:
    """With the instrument, the channel's first two letters, in place of the channel."""
    return nslct(network, station, location, F.substring(channel, 1, 2), tag)


def stream_path(network: Column, station: Column, location: Column, channel: Column, tag: Column) -> Column:
    return F.concat_ws("/", F.concat_ws(".", network, station), nslit(network, station, location, channel, tag))


def is_north(azimuth: Column) -> Column:
    """Whether an azimuth of 0 to 360 degrees is nearer to north or south than to east or west."""
    return (azimuth > 315) | (azimuth < 45) | ((azimuth > 135) & (azimuth < 225))


def orientation_class(channel: Column) -> Column:
    last = F.substring(channel, 3, 1)
    return F.when(last.isin("1", "N"), "N").when(last.isin("2", "E"), "E").otherwise("Z")


def number_in(name: Column) -> Column:
    """The digits of a name, joined by points: 1.0 of SA(1.0), 50 of ROTD50; null without any."""
    found = F.regexp_extract_all(name, F.lit(r"\d+"), F.lit(0))
    return F.when(F.size(found) > 0, F.array_join(found, "."))


def interval_in(name: Column) -> Column:
    """first and last of duration5-95; null where there are none."""
    at = lambda k: F.regexp_extract(name, r"^duration(\d+)-(\d+)$", k).try_cast("int")
    return F.struct(at(1).alias("first"), at(2).alias("last"))


# Centimetres (and seconds) in a unit, and what it measures.
CENTIMETRES = {"gal": 1.0, "cm/s/s": 1.0, "cm/s^2": 1.0, "cm/s**2": 1.0, "in/s/s": 2.54, "cm/s": 1.0, "in/s": 2.54, "cm": 1.0, "in": 2.54, "g": 980.665, "g/10": 98.0665, "g*10": 980.665, "mg": 0.00980665}
MEASURES = {"cm/s^2": "acc", "cm/s**2": "acc", "cm/s/s": "acc", "cm/s": "vel", "cm": "disp"}


def _lookup(of: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in of.items() for x in kv)), key)


def to_cm(unit: Column) -> Column:
    return _lookup(CENTIMETRES, unit)


def units_type(unit: Column) -> Column:
    return _lookup(MEASURES, unit)
