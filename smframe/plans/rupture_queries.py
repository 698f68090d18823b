"""Queries by true distance: stations near finite ruptures, and duplicate traces."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from smframe.operators import duplicates, rupture
from smframe.plans.relational_queries import r6
from smframe.sources import names
from smframe.sources.adapters import SQL, quakes, stations, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

KM, NEAR = 111.19, 300.0


def quads(spark, sf):
    """event, corners: a rectangle whose top's middle is the hypocentre; length and width grow with magnitude."""
    q = quakes(spark, sf).withColumn("z", F.greatest("depth", F.lit(0.0)))
    length, width, strike, dip = F.pow(F.lit(10.0), 0.59 * F.col("magnitude") - 2.44), F.pow(F.lit(10.0), 0.32 * F.col("magnitude") - 1.01), F.radians(F.pmod(F.col("event") * 37, F.lit(360)).cast("double")), F.radians(20.0 * (1 + F.pmod("event", F.lit(4))))
    q = q.select("event", "lat", "lon", "z", (length / 2).alias("l"), (width * F.cos(dip)).alias("w"), (width * F.sin(dip)).alias("d"), F.sin(strike).alias("sn"), F.cos(strike).alias("cs"))

    def corner(along: int, down: int):
        north, east = along * F.col("l") * F.col("cs") - down * F.col("w") * F.col("sn"), along * F.col("l") * F.col("sn") + down * F.col("w") * F.col("cs")
        return F.struct((F.col("lat") + north / KM).alias("lat"), (F.col("lon") + east / (KM * F.cos(F.radians("lat")))).alias("lon"), (F.col("z") + down * F.col("d")).alias("depth"))

    return q.select("event", F.array(corner(-1, 0), corner(1, 0), corner(1, 1), corner(-1, 1)).alias("corners"))


def rupture_distances(spark, sf):
    d = rupture.within(stations(spark, sf), quads(spark, sf), NEAR)
    return d.select("event", "station", r6("rrup_km", 4).alias("rrup_km"), r6("rjb_km", 4).alias("rjb_km"))


def _xyz(lat, lon, z, n):
    r, p, q = f"({rupture.EARTH_KM} - ({z}))", f"radians({lat})", f"radians({lon})"
    return f"{r} * cos({p}) * cos({q}) AS {n}x, {r} * cos({p}) * sin({q}) AS {n}y, {r} * sin({p}) AS {n}z"


def _dot(a, b):
    return "+".join(f"({a[1]}_{k} - {a[0]}_{k}) * ({b[1]}_{k} - {b[0]}_{k})" for k in "xyz")


_SEGMENT = lambda square, along, start: f"({start}) - 2 * CASE WHEN {square} > 0 THEN least(greatest(({along}) / ({square}), 0.0), 1.0) ELSE 0 END * ({along}) + pow(CASE WHEN {square} > 0 THEN least(greatest(({along}) / ({square}), 0.0), 1.0) ELSE 0 END, 2) * ({square})"

QUERIES["rupture_distances"] = rupture_distances
# every station with every rupture, without cells
ORACLE["rupture_distances"] = "WITH " + SQL + f""",
  a AS (SELECT event, lat, lon, greatest(depth, 0) AS z, pow(10.0::DOUBLE, 0.59::DOUBLE * magnitude - 2.44) / 2 AS l, pow(10.0::DOUBLE, 0.32::DOUBLE * magnitude - 1.01) AS wd, radians((event * 37 % 360)::DOUBLE) AS st, radians(20.0::DOUBLE * (1 + event % 4)) AS dip FROM qk),
  k AS (SELECT *, al, dn, al * l * cos(st) - dn * wd * cos(dip) * sin(st) AS north, al * l * sin(st) + dn * wd * cos(dip) * cos(st) AS east, z + dn * wd * sin(dip) AS depth FROM a, (VALUES (-1, 0, 0), (1, 0, 1), (1, 1, 2), (-1, 1, 3)) c(al, dn, ix)),
  c AS (SELECT event, ix, lat + north / {KM} AS la, lon + east / ({KM} * cos(radians(lat))) AS lo, depth FROM k),
  v AS (SELECT event, ix, 0 AS flat, {_xyz('la', 'lo', 'depth', 'p')} FROM c UNION ALL SELECT event, ix, 1, {_xyz('la', 'lo', '0', 'p')} FROM c),
  t AS (SELECT a.event, a.flat, a.px AS a_x, a.py AS a_y, a.pz AS a_z, b.px AS b_x, b.py AS b_y, b.pz AS b_z, c.px AS c_x, c.py AS c_y, c.pz AS c_z FROM v a JOIN v b USING (event, flat) JOIN v c USING (event, flat) WHERE a.ix = 0 AND c.ix = b.ix + 1 AND b.ix > 0),
  s AS (SELECT station, {_xyz('lat', 'lon', '0', 's_')} FROM st),
  d AS (SELECT event, station, flat, {_dot('ab', 'ab')} AS bb, {_dot('ab', 'ac')} AS bc, {_dot('ac', 'ac')} AS cc, {_dot('as', 'ab')} AS pb, {_dot('as', 'ac')} AS pc, {_dot('as', 'as')} AS pp FROM s, t),
  e AS (SELECT *, least({_SEGMENT('bb', 'pb', 'pp')}, {_SEGMENT('cc', 'pc', 'pp')}, {_SEGMENT('(bb - 2 * bc + cc)', 'pc - pb - bc + bb', 'pp - 2 * pb + bb')}) AS edge, bb * cc - bc * bc AS den, cc * pb - bc * pc AS v, bb * pc - bc * pb AS w FROM d),
  f AS (SELECT event, station, flat, CASE WHEN den > 1e-9 * bb * cc AND v >= 0 AND w >= 0 AND v + w <= den THEN least(edge, pp - 2 * v / den * pb - 2 * w / den * pc + v / den * v / den * bb + 2 * v / den * w / den * bc + w / den * w / den * cc) ELSE edge END AS sq FROM e),
  g AS (SELECT event, station, sqrt(greatest(min(sq) FILTER (flat = 0), 0)) AS rrup, sqrt(greatest(min(sq) FILTER (flat = 1), 0)) AS rjb FROM f GROUP BY event, station)
  SELECT event, station, round(rrup, 4) AS rrup_km, round(rjb, 4) AS rjb_km FROM g WHERE rjb <= {NEAR}"""


def duplicate_traces(spark, sf):
    """Parts as traces that arrive in order of their keys: of each site, at places up to 400 m apart across cells, the one kept and how many went."""
    p = F.col("p_partkey")
    d = table(spark, sf, "part").select(
        p.alias("n"), F.lit(1).alias("event"), (F.col("p_size") % 10).cast("string").alias("station"), F.concat(F.lit("L"), p.cast("string")).alias("location"), F.lit("NC").alias("network"),
        F.get(F.array(*map(F.lit, ("HN1", "HN2", "HNN", "HNE", "HNZ", "HHZ"))), (p % 6).cast("int")).alias("channel"), (34 + (p % 50) * 0.1 + (p % 4) * 0.001).alias("lat"), (179.999 + (p % 3) * 0.001).alias("east"),
        F.lit("V1").alias("process_level"), F.lit("knet").alias("source_format"), F.lit(1).alias("start"), (p * 7 % 11).cast("int").alias("npts"), (100.0 + p % 2).alias("sampling_rate"), (p % 50).alias("site"),
    )
    d = d.withColumn("lon", F.when(F.col("east") > 180, F.col("east") - 360).otherwise(F.col("east"))).drop("east")
    left = duplicates.without_duplicates(d, ["event"], "n")
    keys = ["station", "site", F.substring("channel", 1, 2).alias("inst"), names.orientation_class(F.col("channel")).alias("way")]
    return left.groupBy(*keys).agg(F.count(F.lit(1)).alias("kept"), F.min("n").alias("n")).join(d.groupBy(*keys).agg(F.count(F.lit(1)).alias("total")), ["station", "site", "inst", "way"])


QUERIES["duplicate_traces"] = duplicate_traces
# sites are far apart, their traces near, so the rule leaves one of each: most samples, highest rate, least location, the last that arrived
ORACLE["duplicate_traces"] = """WITH t AS (SELECT p_partkey AS n, (p_size % 10)::VARCHAR AS station, p_partkey % 50 AS site, ['HN1','HN2','HNN','HNE','HNZ','HHZ'][(p_partkey % 6 + 1)::INT] AS channel, p_partkey * 7 % 11 AS npts, p_partkey % 2 AS rate, 'L' || p_partkey AS location FROM part),
  k AS (SELECT *, substr(channel, 1, 2) AS inst, CASE WHEN channel[3] IN ('1', 'N') THEN 'N' WHEN channel[3] IN ('2', 'E') THEN 'E' ELSE 'Z' END AS way FROM t)
  SELECT station, site, inst, way, 1::BIGINT AS kept, first(n ORDER BY npts DESC, rate DESC, location) AS n, count(*) AS total FROM k GROUP BY ALL"""
