"""Distances from stations to finite ruptures: the least to the rupture (Rrup), and to its projection on the surface (Rjb).

A rupture is one or more quadrilaterals, each two triangles in Cartesian coordinates about the Earth's centre (a sphere); the
distance to a triangle is a closed expression of dot products, so all of it is compiled JVM code. Stations meet the ruptures that can be near
them through cells of one degree, which each rupture's box, widened by the greatest distance asked for, covers.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from smframe.functions.arrays import let
from smframe.functions.physics import EARTH_KM

DEGREE_KM = math.pi * EARTH_KM / 180
#: Fixed value: corners of a quadrilateral in order around it; each triangle begins at the first.
TRIANGLES = ((0, 1, 2), (0, 2, 3))


def cartesian(lat: Column, lon: Column, depth: Column) -> Column:
    """The place below (lat, lon) as x, y, z in km."""
    r, p, q = EARTH_KM - depth, F.radians(lat), F.radians(lon)
    return F.struct((r * F.cos(p) * F.cos(q)).alias("x"), (r * F.cos(p) * F.sin(q)).alias("y"), (r * F.sin(p)).alias("z"))


def known(x: Column) -> Column:
    """x, NaN for null: compiled arithmetic then needs no test at each step."""
    return F.coalesce(x, F.lit(float("nan")))


def prepared(quads: DataFrame) -> DataFrame:
    """event, corners, and of each quadrilateral (u) and its projection (s) the first corner and the ways from there to the other three, as columns of their own."""
    places = lambda surface: F.transform("corners", lambda c: cartesian(c["lat"], c["lon"], F.lit(0.0) if surface else c["depth"]))
    d = quads.select("event", "corners", places(False).alias("_u"), places(True).alias("_s"))
    at = lambda kind, k: F.get(F.col(f"_{kind}"), F.lit(k))
    way = lambda kind, k, a: known(at(kind, k)[a] - at(kind, 0)[a] if k else at(kind, 0)[a])
    return d.select("event", "corners", *(way(kind, k, a).alias(f"_{kind}{k}{a}") for kind in "us" for k in range(4) for a in "xyz"))


def placed(stations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, lat, lon, and the place as columns _x, _y, _z."""
    d = stations.select(*keys, "lat", "lon", cartesian(F.col("lat"), F.col("lon"), F.lit(0.0)).alias("_p"))
    return d.select(*keys, "lat", "lon", *(known(F.col("_p")[a]).alias(f"_{a}") for a in "xyz"))


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def with_distance(d: DataFrame, name: str, kind: str) -> DataFrame:
    """d, of pairs of placed stations and prepared quadrilaterals, with the distance; null where either is not known.

    Both triangles begin at the first corner, so four products with the way from there to the place, and five between the
    sides, say all; a triangle may be a segment or a point. Each step is columns, which the next reads: an expression that is
    read several times is evaluated once, and all of it is compiled.
    """
    own, col = d.columns, lambda k: known(F.col(f"_{k}"))
    side = [[col(f"{kind}{k}{a}") for a in "xyz"] for k in range(4)]
    d = d.withColumns({f"_p{a}": col(a) - side[0][i] for i, a in enumerate("xyz")})
    p = [col(f"p{a}") for a in "xyz"]
    d = d.withColumns({"_pp": dot(p, p)} | {f"_p{k}": dot(p, side[k]) for k in (1, 2, 3)} | {f"_b{j}{k}": dot(side[j], side[k]) for j, k in ((1, 1), (1, 2), (2, 2), (2, 3), (3, 3))})
    pp = col("pp")
    far = {(j, k): (col(f"b{j}{j}") - 2 * col(f"b{j}{k}") + col(f"b{k}{k}"), col(f"p{k}") - col(f"p{j}") - col(f"b{j}{k}") + col(f"b{j}{j}"), pp - 2 * col(f"p{j}") + col(f"b{j}{j}")) for j, k in ((1, 2), (2, 3))}
    # a side's square, its product with the way to the place from its start, and that way's square
    sides = {f"{k}": (col(f"b{k}{k}"), col(f"p{k}"), pp) for k in (1, 2, 3)} | {f"{j}{k}": v for (j, k), v in far.items()}
    d = d.withColumns({f"_{x}{n}": v for n, of in sides.items() for x, v in zip(("square", "along", "start"), of)} | {f"_den{j}": col(f"b{j}{j}") * col(f"b{k}{k}") - col(f"b{j}{k}") * col(f"b{j}{k}") for j, k in far})
    nearest = {f"_t{n}": F.coalesce(F.when(col(f"square{n}") > 0, F.least(F.greatest(col(f"along{n}") / col(f"square{n}"), F.lit(0.0)), F.lit(1.0))), F.lit(0.0)) for n in sides}
    for j, k in far:
        wide = col(f"den{j}") > 1e-9 * col(f"b{j}{j}") * col(f"b{k}{k}")
        nearest[f"_v{j}"] = F.coalesce(F.when(wide, (col(f"b{k}{k}") * col(f"p{j}") - col(f"b{j}{k}") * col(f"p{k}")) / col(f"den{j}")), F.lit(-1.0))
        nearest[f"_w{j}"] = F.coalesce(F.when(wide, (col(f"b{j}{j}") * col(f"p{k}") - col(f"b{j}{k}") * col(f"p{j}")) / col(f"den{j}")), F.lit(-1.0))
    d = d.withColumns(nearest)
    edges = [col(f"start{n}") - 2 * col(f"t{n}") * col(f"along{n}") + col(f"t{n}") * col(f"t{n}") * col(f"square{n}") for n in sides]

    def plane(j: int, k: int) -> Column:
        v, w = col(f"v{j}"), col(f"w{j}")
        to = pp - 2 * v * col(f"p{j}") - 2 * w * col(f"p{k}") + v * v * col(f"b{j}{j}") + 2 * v * w * col(f"b{j}{k}") + w * w * col(f"b{k}{k}")
        return F.when((v >= 0) & (w >= 0) & (v + w <= 1), to).otherwise(edges[0])

    d = d.select(*own, F.sqrt(F.greatest(F.least(*edges, *(plane(j, k) for j, k in far)), F.lit(0.0))).alias("_d"))
    # an explode holds conditions on the distance back, which else would be written out below the steps, each value many times
    return d.select(*own, F.explode(F.array(F.when(~F.isnan("_d"), F.col("_d")))).alias(name))


def distances(records: DataFrame, quads: DataFrame, keys: Sequence[str] = ("station",)) -> DataFrame:
    """event, keys, rrup_km and rjb_km of each record: the least over its event's quadrilaterals; null where the event has none.

    records: event, keys, lat, lon. quads: event, corners (array of four lat, lon, depth). One join on event, one partial aggregation.
    """
    d = placed(records, ["event", *keys]).join(prepared(quads), "event", "left")
    each = with_distance(with_distance(d, "rrup", "u"), "rjb", "s")
    return each.groupBy("event", *keys).agg(F.min("rrup").alias("rrup_km"), F.min("rjb").alias("rjb_km"))


def cells(corners: Column, km: float) -> Column:
    """The cells (lat, lon) of one degree that a quadrilateral's box, widened by km, touches; across poles and the antimeridian too.

    Corners are given so that neighbours are less than half a turn apart; the box is measured from the first corner.
    """
    wide = km / DEGREE_KM

    def box(b: Column) -> Column:
        lows, highs = F.floor(F.greatest(b["south"], F.lit(-90.0))), F.floor(F.least(b["north"], F.lit(89.999999999)))
        # how wide km can be in longitude at the box's highest latitude; near a pole, all around
        high = F.greatest(F.abs(b["south"]), F.abs(b["north"]))
        sine = F.sin(F.lit(math.radians(wide))) / F.cos(F.radians(F.least(high - wide, F.lit(90.0))))
        around = (high >= 90) | (sine >= 1)
        span = F.degrees(F.asin(F.least(sine, F.lit(1.0))))
        west, east = F.floor(b["west"] - span), F.floor(b["east"] + span)
        all_ = around | (east - west >= 359)
        lons = F.when(all_, F.sequence(F.lit(0).cast("long"), F.lit(359).cast("long"))).otherwise(F.transform(F.sequence(west, east), lambda k: F.pmod(k, F.lit(360).cast("long"))))
        return F.flatten(F.transform(F.sequence(lows, highs), lambda i: F.transform(lons, lambda j: F.struct(i.alias("i"), j.alias("j")))))

    lat, first = F.transform(corners, lambda c: c["lat"]), F.get(corners, F.lit(0))["lon"]
    lon = F.transform(corners, lambda c: first + F.pmod(c["lon"] - first + 180, F.lit(360.0)) - 180)
    b = F.struct((F.array_min(lat) - wide).alias("south"), (F.array_max(lat) + wide).alias("north"), F.array_min(lon).alias("west"), F.array_max(lon).alias("east"))
    return let(b, box)


def within(stations: DataFrame, quads: DataFrame, km: float, keys: Sequence[str] = ("station",)) -> DataFrame:
    """event, keys, rrup_km and rjb_km of all stations and ruptures whose Rjb is km at most.

    An equi-join on the cells of each event; a station has one cell, so it meets an event's quadrilaterals once. Of the
    pairs most fall to a ball that holds the event's projections, widened by km; the rest are met by closed expressions.
    """
    corner = lambda g, k, a: g[f"_s0{a}"] + g[f"_s{k}{a}"] if k else g["_s0" + a]
    q = prepared(quads)
    geometry = [c for c in q.columns if c not in ("event", "corners")]
    row = {c: F.col(c) for c in geometry}
    middle = {f"_m{a}": F.avg((corner(row, 0, a) + corner(row, 1, a) + corner(row, 2, a) + corner(row, 3, a)) / 4) for a in "xyz"}
    q = q.groupBy("event").agg(F.collect_list(F.struct("corners", *geometry)).alias("_q"), *(known(v).alias(k) for k, v in middle.items()))  # few to an event

    def outer(g: Column) -> Column:
        ways = [[corner(g, k, a) - F.col(f"_m{a}") for a in "xyz"] for k in range(4)]
        return F.greatest(*(F.sqrt(dot(w, w)) for w in ways))

    q = q.withColumn("_reach", known(F.array_max(F.transform("_q", outer)) + km + 1e-6))
    q = q.withColumn("_c", F.explode(F.array_distinct(F.flatten(F.transform("_q", lambda g: cells(g["corners"], km))))))
    q = q.select("event", "_c", "_reach", *middle, F.size("_q").alias("_n"), F.explode("_q").alias("_g")).select("event", "_c", "_reach", "_n", *middle, *(F.col("_g")[c].alias(c) for c in geometry))
    s = placed(stations, keys).withColumn("_c", F.struct(F.floor(F.least(F.col("lat"), F.lit(89.999999999))).alias("i"), F.pmod(F.floor("lon"), F.lit(360).cast("long")).alias("j")))
    way = [F.col(f"_{a}") - F.col(f"_m{a}") for a in "xyz"]
    d = with_distance(s.join(q, "_c").where(dot(way, way) <= F.col("_reach") * F.col("_reach")), "_rjb", "s")
    d = with_distance(d.where((F.col("_n") > 1) | (F.col("_rjb") <= km)), "_rrup", "u")
    return d.groupBy("event", *keys).agg(F.min("_rrup").alias("rrup_km"), F.min("_rjb").alias("rjb_km")).where(F.col("rjb_km") <= km)
