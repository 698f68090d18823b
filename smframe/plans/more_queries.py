"""Further queries: rotated response, resampling, travel times, checks, names and tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from smframe.functions import arrays, physics
from smframe.operators import relational as r
from smframe.operators import waveform as w
from smframe.plans.relational_queries import colocated, r6
from smframe.plans.waveform_queries import PAIRS
from smframe.sources.adapters import DT, SQL, quakes, samples, stations, table, traces

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
WITH = "WITH RECURSIVE " + SQL


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = WITH + sql
        return f

    return add


_C = [repr(v) + "::DOUBLE" for v in w.oscillator_step(0.2, 0.05, DT)]


@query(PAIRS + f""", t AS (SELECT unnest(range(0, 181)) AS t), rx AS (SELECT record_id, t, list_transform(range(1, 65), lambda i: x1[i] * cos(t * pi() / 180) + x2[i] * sin(t * pi() / 180)) AS x FROM hp, t),
  os AS (SELECT record_id, list_reduce(list_prepend(struct_pack(d := 0.0::DOUBLE, v := 0.0::DOUBLE, m := 0.0::DOUBLE, a := 0.0::DOUBLE, b := 0.0::DOUBLE), list_transform(range(1, 64), lambda i: struct_pack(d := 0.0::DOUBLE, v := 0.0::DOUBLE, m := 0.0::DOUBLE, a := x[i], b := x[i + 1]))),
    lambda s, q: struct_pack(d := {_C[0]} * s.d + {_C[1]} * s.v + {_C[4]} * q.a + {_C[5]} * q.b, v := {_C[2]} * s.d + {_C[3]} * s.v + {_C[6]} * q.a + {_C[7]} * q.b, m := greatest(s.m, abs({_C[0]} * s.d + {_C[1]} * s.v + {_C[4]} * q.a + {_C[5]} * q.b)), a := 0.0::DOUBLE, b := 0.0::DOUBLE)).m AS m FROM rx)
  SELECT record_id, 0.2::DOUBLE AS period, round(quantile_cont(m, 0.5) * 1e6, 4) AS sd FROM os GROUP BY record_id""")
def rotd_sd(spark, sf):
    d = w.rotd_response(w.horizontal_pairs(traces(spark, sf), ["record_id"]), ["record_id"], [0.2], 0.05, DT)
    return d.select("record_id", "period", r6(F.col("sd") * 1e6, 4).alias("sd"))


@query(""", g AS (SELECT unnest(range(0, 85)) AS k), u AS (SELECT trace_id, k, v, k * 0.75::DOUBLE - i AS u FROM sm, g)
  SELECT trace_id, k::INT AS i, round(sum(CASE WHEN abs(u) >= 8 THEN 0 WHEN u = 0 THEN v ELSE v * sin(pi() * u) / (pi() * u) * sin(pi() * u / 8) / (pi() * u / 8) END), 6) + 0.0 AS y FROM u WHERE k * 0.75 <= 63 GROUP BY trace_id, k""")
def resample_lanczos(spark, sf):
    d = w.resampled(traces(spark, sf).select("trace_id", "x"), DT, 0.0075, 8).select("trace_id", F.posexplode("resampled").alias("i", "v"))
    return d.select("trace_id", "i", r6(F.col("v")).alias("y"))


DEG = math.pi * 6371.0 / 180


@query(f""", p AS (SELECT s.station, 2 * degrees(asin(sqrt(least(1.0, pow(sin(radians(q.lat - s.lat) / 2), 2) + cos(radians(s.lat)) * cos(radians(q.lat)) * pow(sin(radians(q.lon - s.lon) / 2), 2))))) AS degrees, greatest(q.depth, 0) AS z FROM st s JOIN qk q ON q.event = s.station % 50 + 1),
  c AS (SELECT *, floor(degrees / 5) AS i, floor(z / 10) AS j FROM p), e AS (SELECT *, degrees / 5 - i AS u, z / 10 - j AS v FROM c)
  SELECT station, round(degrees, 6) AS degrees, CASE WHEN i < 30 AND j < 10 THEN round((20 * i + sqrt(i) * 3 - j) * (1 - u) * (1 - v) + (20 * (i + 1) + sqrt(i + 1) * 3 - j) * u * (1 - v) + (20 * i + sqrt(i) * 3 - (j + 1)) * (1 - u) * v + (20 * (i + 1) + sqrt(i + 1) * 3 - (j + 1)) * u * v, 6) END AS seconds FROM e""")
def travel_time_table(spark, sf):
    q = quakes(spark, sf).select("event", F.col("lat").alias("qlat"), F.col("lon").alias("qlon"), F.col("depth").alias("depth_km"))
    d = stations(spark, sf).withColumn("event", F.col("station") % 50 + 1).join(q, "event")
    d = d.select("station", (physics.haversine_km(F.col("lat"), F.col("lon"), F.col("qlat"), F.col("qlon")) / DEG).alias("degrees"), "depth_km")
    grid = spark.range(31).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(10).cast("long"))).alias("j")).withColumn("t", 20.0 * F.col("i") + F.sqrt("i") * 3 - F.col("j"))
    return r.travel_times(d, grid, 5.0, 10.0).select("station", r6(F.col("degrees")).alias("degrees"), r6(F.col("seconds")).alias("seconds"))


@query(""", s AS (SELECT trace_id, record_id, label * 0.01::DOUBLE AS start, x FROM tr), b AS (SELECT *, max(start) OVER w AS a, min(start + 63 * 0.01::DOUBLE) OVER w AS e FROM s WINDOW w AS (PARTITION BY record_id)),
  c AS (SELECT trace_id, a, x[(round((a - start) / 0.01) + 1)::INT:(round((e - start) / 0.01) + 1)::INT] AS y FROM b) SELECT trace_id, round(a, 6) AS start, len(y)::INT AS n, round(list_sum(y), 6) + 0.0 AS total FROM c""")
def align_traces(spark, sf):
    d = r.align(traces(spark, sf).withColumn("start", F.col("label") * 0.01), ["record_id"], DT)
    return d.select("trace_id", r6(F.col("start")).alias("start"), F.size("x").alias("n"), r6(arrays.total(F.col("x"))).alias("total"))


@query(""", s AS (SELECT user_id AS station, (event_id % 60)::DOUBLE / 2 AS freq, avg(value) / 20 AS snr FROM events GROUP BY ALL), f AS (SELECT station, least(greatest(4.906e6 * 3.7 * pow(100.0 / pow(10, 1.5 * magnitude + 16.05), 1.0::DOUBLE / 3), 0.1), 2.0) AS f0 FROM st)
  SELECT s.station, round(coalesce(min(snr) FILTER (freq >= f0 AND freq <= 5), 0), 6) AS least, coalesce(min(snr) FILTER (freq >= f0 AND freq <= 5), 0) < 1.5 AS failed FROM s JOIN f ON s.station = f.station GROUP BY s.station""")
def snr_check(spark, sf):
    s = samples(spark, sf).groupBy("station", ((F.col("event_id") % 60).cast("double") / 2).alias("freq")).agg((F.avg("x") / 20).alias("snr"))
    f0 = F.least(F.greatest(physics.brune_f0(physics.moment(F.col("magnitude")), 100.0), F.lit(0.1)), F.lit(2.0))
    d = r.snr_check(s.join(stations(spark, sf).select("station", f0.alias("f0")), "station"), ["station"], 1.5, F.col("f0"), 5.0)
    return d.select("station", r6(F.col("least")).alias("least"), "failed")


@query(""", n AS (SELECT DISTINCT CASE p_size % 3 WHEN 0 THEN 'SA(' || p_size || ')' WHEN 1 THEN 'FAS(f=' || p_size || '.5)' ELSE 'PGA' END AS name FROM part), k AS (SELECT name, regexp_extract(name, '^([^0-9]*)', 1) AS a, TRY_CAST(regexp_extract(name, '([0-9]+(\\.[0-9]+)?)', 1) AS DOUBLE) AS b FROM n)
  SELECT name, row_number() OVER (ORDER BY a, b NULLS FIRST, name)::INT AS rank FROM k""")
def natural_sort(spark, sf):
    k, s = F.col("p_size") % 3, F.col("p_size").cast("string")
    name = F.when(k == 0, F.concat(F.lit("SA("), s, F.lit(")"))).when(k == 1, F.concat(F.lit("FAS(f="), s, F.lit(".5)"))).otherwise("PGA")
    return r.natural_rank(table(spark, sf, "part").select(name.alias("name")).distinct(), "name")


@query(""" SELECT p_partkey AS metric, printf('SA(T=%.4f, D=%.3f)', p_size / 10.0::DOUBLE, 5.0::DOUBLE) AS id, (p_size / 10.0::DOUBLE) AS period FROM part""")
def metric_identifiers(spark, sf):
    d = table(spark, sf, "part").withColumn("t", F.col("p_size") / 10.0)
    d = d.select(F.col("p_partkey").alias("metric"), physics.spectral_id("SA", F.col("t"), F.lit(0.05)).alias("id"))
    return d.withColumn("period", physics.period_of(F.col("id")))


@query(""" SELECT station, round(CASE WHEN magnitude < 5.744 THEN pow(10, 0.7497 + 0.43 * (magnitude - 5.744)) WHEN magnitude < 7.744 THEN pow(10, 0.7497 + 0.43 * (magnitude - 5.744) - 0.04875 * pow(magnitude - 5.744, 2)) ELSE pow(10, 1.4147 + 0.235 * (magnitude - 7.744)) END, 6) AS h FROM st""")
def finite_fault(spark, sf):
    return stations(spark, sf).select("station", r6(physics.finite_fault_km(F.col("magnitude"))).alias("h"))


@query(""", s AS (SELECT user_id AS station, (event_id % 60)::DOUBLE / 2 AS freq, avg(value) AS v FROM events GROUP BY ALL), n AS (SELECT station, freq, v, lead(freq) OVER w AS f1, lead(v) OVER w AS v1 FROM s WHERE freq BETWEEN 2 AND 20 WINDOW w AS (PARTITION BY station ORDER BY freq))
  SELECT station, round(sum((v + v1) / 2 * (f1 - freq)) / sum(f1 - freq), 6) AS mean FROM n WHERE f1 IS NOT NULL GROUP BY station""")
def band_average(spark, sf):
    s = samples(spark, sf).groupBy("station", ((F.col("event_id") % 60).cast("double") / 2).alias("freq")).agg(F.avg("x").alias("value"))
    return r.band_average(s, ["station"], 2.0, 20.0).select("station", r6(F.col("mean")).alias("mean"))


@query(""" SELECT DISTINCT s_suppkey AS event, printf('%.2f', s_acctbal) AS balance, s_name AS name FROM supplier""")
def event_table(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("event"), F.format_string("%.2f", "s_acctbal").alias("balance"), F.col("s_name").alias("name")).distinct()


@query(""" SELECT 'HN' AS instrument, count(*)::BIGINT AS n FROM st WHERE instrument = 'HN' UNION ALL SELECT instrument, count(*) FROM st WHERE instrument LIKE 'B%' GROUP BY instrument""")
def metric_select(spark, sf):
    d = stations(spark, sf)
    return d.where("instrument = 'HN'").unionByName(d.where("instrument like 'B%'")).groupBy("instrument").agg(F.count(F.lit(1)).alias("n"))


@query(""" SELECT station, instrument FROM st WHERE network IN (1, 2, 3) AND station IN (SELECT station FROM st WHERE station < 500) AND instrument IN ('HN', 'BH')""")
def workspace_filter(spark, sf):
    return stations(spark, sf).where(F.col("network").isin(1, 2, 3) & (F.col("station") < 500) & F.col("instrument").isin("HN", "BH")).select("station", "instrument")


@query(""", o AS (SELECT s_suppkey AS event, row_number() OVER (ORDER BY s_suppkey) AS k FROM supplier) SELECT event FROM o WHERE k >= (SELECT min(k) FROM o WHERE event >= 40)""")
def resume_events(spark, sf):
    return table(spark, sf, "supplier").where("s_suppkey >= 40").select(F.col("s_suppkey").alias("event"))


@query(""" SELECT network, count(DISTINCT station)::BIGINT AS stations, count(DISTINCT instrument)::BIGINT AS instruments, round(min(lat), 6) AS south, round(max(lat), 6) AS north FROM st GROUP BY network""")
def inventory(spark, sf):
    return stations(spark, sf).groupBy("network").agg(F.count_distinct("station").alias("stations"), F.count_distinct("instrument").alias("instruments"), r6(F.min("lat")).alias("south"), r6(F.max("lat")).alias("north"))


@query("")
def ground_motion_packet(spark, sf):
    """One nested JSON document a record: its traces with their metrics. JSON text differs between engines, so rows only."""
    d = traces(spark, sf).select("record_id", "station", "label", F.struct("channel", r6(arrays.max_abs(F.col("x"))).alias("pga"), F.round(w.cav(F.col("x"), DT) * 1e6, 4).alias("cav")).alias("trace"))
    d = d.groupBy("record_id", "station").agg(F.sort_array(F.collect_list("trace")).alias("traces"))
    return d.select("record_id", F.to_json(F.struct("station", "traces")).alias("packet"))


@query(""", x AS (SELECT r.network, count(*) AS n FROM (SELECT DISTINCT network, station // 3 AS sta, instrument FROM st) r GROUP BY r.network) SELECT network, n::BIGINT AS n FROM x""")
def label_counts(spark, sf):
    return colocated(spark, sf).groupBy("network").agg(F.count(F.lit(1)).alias("n"))
