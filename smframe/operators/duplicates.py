"""Duplicate traces by true distance, decided in order of arrival.

Two traces are duplicates if they are of one station code, instrument and orientation class, and either agree in network and location
too or lie less than a tolerance apart. Each trace that arrives is held against those kept so far: the first duplicate among them, in
the order in which they were kept, and the newcomer are compared, and one of them goes. As that relation isn't transitive, the order matters.

Rows are dealt by station, instrument and class, sorted by arrival (on disk where need be) and streamed; a task holds the traces kept of
one group, found through cells of the tolerance's size in space (which has no poles and no date line), so each newcomer meets its neighbours alone.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from smframe.functions.physics import EARTH_KM
from smframe.sources.names import orientation_class

#: What decides, in order, and the order of process levels and formats.
ORDER = ("process_level", "source_format", "start", "npts", "sampling_rate", "location")
LEVELS, FORMATS = ("V1", "V0", "V2"), ("cosmos", "dmg")
NEEDED = ("network", "location", "lat", "lon", "process_level", "source_format", "start", "npts", "sampling_rate")


def haversine_m(a: tuple[float, float], b: tuple[float, float]) -> float:
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2000 * EARTH_KM * math.asin(math.sqrt(min(h, 1.0)))


def preferred(new: dict, old: dict, order=ORDER, levels=LEVELS, formats=FORMATS) -> bool:
    """Whether new is to be kept rather than old: by the first criterion in which they differ; new if there is none.

    Formats count if both are listed. Known starts come before unknown ones, more samples, higher rates and lesser locations (-- last) before others;
    an unlisted level comes last.
    """
    rank = {
        "process_level": lambda t: levels.index(t["process_level"]) if t["process_level"] in levels else len(levels),
        "source_format": lambda t: formats.index(t["source_format"]),
        "start": lambda t: t["start"] is None or t["start"] == 0,
        "npts": lambda t: -(t["npts"] or 0),
        "sampling_rate": lambda t: -(t["sampling_rate"] or 0.0),
        "location": lambda t: (t["location"] in (None, "--"), t["location"] or ""),
    }
    for c in order:
        if c == "source_format" and not {new[c], old[c]} <= {*formats}:
            continue
        a, b = rank[c](new), rank[c](old)
        if a != b:
            return a < b
    return True


class Kept:
    """The traces kept of one group, in the order in which they were kept."""

    def __init__(self, tolerance_m: float):
        self.tolerance, self.number = tolerance_m, 0
        self.by_name: dict[tuple, dict[int, dict]] = defaultdict(dict)
        self.by_cell: dict[tuple, dict[int, dict]] = defaultdict(dict)

    def _cell(self, t: dict) -> tuple[int, int, int] | None:
        if t["lat"] is None or t["lon"] is None:
            return None
        p, q, r = math.radians(t["lat"]), math.radians(t["lon"]), 1000 * EARTH_KM / max(self.tolerance, 1e-3)
        return (math.floor(r * math.cos(p) * math.cos(q)), math.floor(r * math.cos(p) * math.sin(q)), math.floor(r * math.sin(p)))

    def first_duplicate(self, t: dict) -> tuple[int, dict] | None:
        found = [*self.by_name.get((t["network"], t["location"]), {}).items()][:1]
        c = self._cell(t)
        if c is not None:
            for i in (-1, 0, 1):
                for j in (-1, 0, 1):
                    for k in (-1, 0, 1):
                        for n, o in self.by_cell.get((c[0] + i, c[1] + j, c[2] + k), {}).items():
                            if haversine_m((t["lat"], t["lon"]), (o["lat"], o["lon"])) < self.tolerance:
                                found.append((n, o))
        return min(found, key=lambda x: x[0], default=None)

    def add(self, t: dict) -> None:
        self.number += 1
        self.by_name[t["network"], t["location"]][self.number] = t
        if (c := self._cell(t)) is not None:
            self.by_cell[c][self.number] = t

    def drop(self, n: int, t: dict) -> None:
        del self.by_name[t["network"], t["location"]][n]
        if (c := self._cell(t)) is not None:
            del self.by_cell[c][n]


def removed(traces: DataFrame, keys: list[str], arrival: str, tolerance_m: float = 500.0, order=ORDER, levels=LEVELS, formats=FORMATS) -> DataFrame:
    """arrival and removed_by (the arrival of the trace preferred to it) of the duplicates that go.

    traces: keys (those within which duplicates are sought, as the event), arrival (a number of its own for each trace), station, channel and NEEDED.
    Places that are unknown are near nothing; start may be null.
    """
    d = traces.select(*keys, F.col("station").alias("_station"), F.substring("channel", 1, 2).alias("_instrument"), orientation_class(F.col("channel")).alias("_class"), F.col(arrival).cast("long").alias("_at"), *NEEDED)
    d = d.withColumn("start", F.unix_micros("start") if dict(d.dtypes)["start"] == "timestamp" else F.col("start").cast("long"))
    group = [*keys, "_station", "_instrument", "_class"]
    d = d.repartition(*group).sortWithinPartitions(*group, "_at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, kept = object(), Kept(tolerance_m)
        for b in batches:
            gone = []
            names = b.schema.names
            for row in zip(*(c.to_pylist() for c in b.columns)):
                t = dict(zip(names, row))
                g = tuple(t[c] for c in group)
                if g != own:
                    own, kept = g, Kept(tolerance_m)
                hit = kept.first_duplicate(t)
                if hit is None:
                    kept.add(t)
                elif preferred(t, hit[1], order, levels, formats):
                    kept.drop(*hit)
                    kept.add(t)
                    gone.append((hit[1]["_at"], t["_at"]))
                else:
                    gone.append((t["_at"], hit[1]["_at"]))
            if gone:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(v)) for v in zip(*gone)], ["arrival", "removed_by"])

    return d.mapInArrow(run, "arrival long, removed_by long")


def without_duplicates(traces: DataFrame, keys: list[str], arrival: str, tolerance_m: float = 500.0, **preferences) -> DataFrame:
    """traces without those that removed() names."""
    gone = removed(traces, keys, arrival, tolerance_m, **preferences).select(F.col("arrival").alias("_gone"))
    return traces.join(gone, traces[arrival] == gone["_gone"], "left_anti")
