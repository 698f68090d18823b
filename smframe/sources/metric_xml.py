"""Metrics of waveforms and stations as XML, one document a record, and back; numbers keep the digits that the format gives them.

Documents are built by expressions from long tables, in one grouping on the record's key, and parsed in Arrow batches, as their tags are data.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Decimals of numbers that aren't values of metrics, by attribute or tag; values have eight significant digits.
DECIMALS = {"period": 3, "damping": 2, "smoothing_parameter": 2, "back_azimuth": 2, "vs30": 2, "distance": 2}


def escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def significant(v: Column) -> Column:
    """v as text of eight significant digits, without idle zeros."""
    return F.when(F.isnan(v) | v.isNull(), F.lit("nan")).otherwise(F.format_string("%.7e", v).cast("double").cast("string"))


def attribute(name: str, value: Column) -> Column:
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(f' {name}="'), value, F.lit('"')))


def fixed(name: str) -> Column:
    return F.when(F.col(name).isNotNull(), F.format_string(f"%.{DECIMALS[name]}f", F.col(name).cast("double")))


def waveform_documents(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and document: of each record all its metrics, by type and attributes, and in each its components.

    metrics: keys, type, units, period, damping (null where a type has none), component (a name as H1, RotD, GreaterOfTwoHorizontals),
    original_channel and percentile (null but for channels and RotD), value. Names of types and components are letters and digits.
    """
    word = lambda c: F.regexp_replace(F.col(c), "[^A-Za-z0-9_]", "")
    tag = word("component")
    component = F.concat(F.lit("<"), tag, attribute("original_channel", escaped(F.col("original_channel"))), attribute("percentile", F.col("percentile").cast("double").cast("string")), F.lit(">"), significant(F.col("value")), F.lit("</"), tag, F.lit(">"))
    kind = F.lower(word("type"))
    head = F.concat(F.lit("<"), kind, attribute("units", escaped(F.coalesce("units", F.lit("")))), attribute("period", fixed("period")), attribute("damping", fixed("damping")), F.lit(">"))
    each = metrics.select(*keys, kind.alias("_kind"), head.alias("_head"), component.alias("_c"))
    by = each.groupBy(*keys, "_kind", "_head").agg(F.array_join(F.sort_array(F.collect_list("_c")), "").alias("_c"))
    whole = F.concat("_head", "_c", F.lit("</"), "_kind", F.lit(">"))
    return by.groupBy(*keys).agg(F.concat(F.lit("<waveform_metrics>"), F.array_join(F.sort_array(F.collect_list(whole)), ""), F.lit("</waveform_metrics>")).alias("document"))


def station_documents(stations: DataFrame, keys: Sequence[str], distances: Sequence[str], others: Sequence[str] = ("back_azimuth",)) -> DataFrame:
    """keys and document: distances (km) and others of each row, with two decimals; unknown ones are left out."""
    one = lambda c, units: F.when(F.col(c).isNull(), F.lit("")).otherwise(F.concat(F.lit(f"<{c}{units}>"), F.format_string(f"%.{DECIMALS['distance']}f", F.col(c).cast("double")), F.lit(f"</{c}>")))
    text = F.concat(F.lit("<station_metrics><distances>"), *(one(c, ' units="km"') for c in distances), F.lit("</distances>"), *(one(c, "") for c in others), F.lit("</station_metrics>"))
    return stations.select(*keys, text.alias("document"))


def parsed(documents: DataFrame, keys: Sequence[str], schema: str, rows) -> DataFrame:
    """keys and the columns of schema (and problem) that rows(root) gives of each document."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"string": pa.string(), "double": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, out = [], []
            for i, text in enumerate(b.column("document").to_pylist()):
                try:
                    got = [(*r, None) for r in rows(ET.fromstring(text or ""))]
                except (ET.ParseError, ValueError) as e:
                    got = [(*[None] * len(names), str(e))]
                at += [i] * len(got)
                out += got
            cols = [pa.array([r[k] for r in out], kinds[c.split()[1]]) for k, c in enumerate(f"{schema}, problem string".split(", "))]
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(at, pa.int64())) for k in keys), *cols], [*keys, *names, "problem"])

    given = ", ".join(f"`{k}` {documents.schema[k].dataType.simpleString()}" for k in keys)
    return documents.select(*keys, "document").mapInArrow(run, f"{given}, {schema}, problem string")


def number(text: str | None) -> float | None:
    return None if text is None else float(text)


def waveform_metrics(documents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The long table that waveform_documents() takes, and problem where a document can't be parsed."""

    def rows(root: ET.Element):
        if root.tag != "waveform_metrics":
            raise ValueError(f"a document of {root.tag}")
        for m in root:
            for c in m:
                yield m.tag, m.get("units"), number(m.get("period")), number(m.get("damping")), c.tag, c.get("original_channel"), number(c.get("percentile")), number(c.text)

    return parsed(documents, keys, "type string, units string, period double, damping double, component string, original_channel string, percentile double, value double", rows)


def station_metrics(documents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, name, units, value of every distance and other measure, and problem."""

    def rows(root: ET.Element):
        if root.tag != "station_metrics":
            raise ValueError(f"a document of {root.tag}")
        for e in root:
            for x in e if e.tag == "distances" else [e]:
                yield x.tag, x.get("units"), number(x.text)

    return parsed(documents, keys, "name string, units string, value double", rows)


def inserted(store: DataFrame, new: DataFrame, keys: Sequence[str], overwrite: bool = False) -> DataFrame:
    """store with the documents of new; of keys that both have, those of store stay unless overwrite. A null key is a key."""
    a, b = (store, new) if overwrite else (new, store)
    on = None
    other = b.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    for k in keys:
        one = a[k].eqNullSafe(other[f"_{k}"])
        on = one if on is None else on & one
    return a.join(other, on, "left_anti").unionByName(b)
