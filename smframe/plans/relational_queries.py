"""Queries over stations, events and records, each with the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from smframe.functions import arrays, physics
from smframe.operators import relational as r
from smframe.operators import waveform as wf
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


def r6(c, k: int = 6):
    return F.round(c, k) + F.lit(0.0)


@query(""", c AS (SELECT *, count(*) OVER (PARTITION BY record_id) AS n, count(*) FILTER (component <> 'Z') OVER (PARTITION BY record_id) AS h FROM (SELECT trace_id, component, CASE WHEN trace_id % 11 = 3 THEN -1 - record_id ELSE record_id END AS record_id FROM tr) z)
  SELECT trace_id, record_id, CASE WHEN n > 3 THEN 'more traces than allowed' WHEN n < 2 THEN 'fewer traces than required' WHEN h < 2 THEN 'not two horizontal traces' END AS reason FROM c""")
def check_instrument(spark, sf):
    # every eleventh trace stands in a record of its own, which leaves others incomplete
    d = r.check_instrument(traces(spark, sf).withColumn("record_id", F.expr("CASE WHEN trace_id % 11 = 3 THEN -1 - record_id ELSE record_id END")), ["record_id"])
    return d.select("trace_id", "record_id", F.col("failure.reason").alias("reason"))


@query(""" SELECT trace_id, CASE WHEN channel LIKE '%Z' THEN 'Z' ELSE 'H' || row_number() OVER (PARTITION BY record_id, channel LIKE '%Z' ORDER BY channel) END AS component FROM tr""")
def component_names(spark, sf):
    return r.component_names(traces(spark, sf).drop("component"), ["record_id"]).select("trace_id", "component")


@query(""" SELECT CASE WHEN label = 3 THEN 'RE.' || station || '.' || location || '.HN' ELSE 'EM.' || station || '.HN' END AS record, count(*)::BIGINT AS n, min(trace_id) AS first FROM tr GROUP BY 1""")
def group_records(spark, sf):
    net = F.when(F.col("label") == 3, "RE").otherwise("EM")
    d = traces(spark, sf).withColumn("record", r.record_key(net, F.col("station"), F.col("location"), F.col("channel")))
    return d.groupBy("record").agg(F.count(F.lit(1)).alias("n"), F.min("trace_id").alias("first"))


@query(""" SELECT station, NOT regexp_matches(lower(structure), 'building|bridge|dam|borehole|hole|crest|toe|foundation|body|roof|floor') AS free FROM st""")
def free_field(spark, sf):
    return stations(spark, sf).select("station", physics.free_field(F.col("structure")).alias("free"))


@query(""" SELECT station, instrument, structure FROM st WHERE regexp_matches(instrument, '^h.$', 'i') AND regexp_matches(structure, '^.*u.*$', 'i')""")
def select_glob(spark, sf):
    d = stations(spark, sf)
    return d.where(F.col("instrument").rlike(r.physics.glob("h?")) & F.col("structure").rlike(r.physics.glob("*U*"))).select("station", "instrument", "structure")


@query(""" SELECT station FROM st WHERE NOT (regexp_matches(instrument, 'B') AND regexp_matches(structure, 'M'))""")
def exclude_patterns(spark, sf):
    return stations(spark, sf).where(~(F.col("instrument").rlike("B") & F.col("structure").rlike("M"))).select("station")


@query(""", k AS (SELECT *, row_number() OVER (PARTITION BY network, instrument ORDER BY quality DESC, station) AS k FROM st) SELECT network, instrument, station, round(quality, 2) AS quality FROM k WHERE k = 1""")
def dedup_preferred(spark, sf):
    d = r.dedup(stations(spark, sf), ["network", "instrument"], [F.col("quality").desc(), F.col("station")])
    return d.select("network", "instrument", "station", r6(F.col("quality"), 2).alias("quality"))


COL = """, rc AS (SELECT DISTINCT network, station // 3 AS sta, instrument FROM st), o AS (SELECT *, CASE instrument WHEN 'HN' THEN 0 WHEN 'BN' THEN 1 WHEN 'HH' THEN 2 WHEN 'BH' THEN 3 END AS o, count(*) OVER (PARTITION BY sta) AS n FROM rc),
  b AS (SELECT *, first_value(instrument) OVER (PARTITION BY sta ORDER BY o NULLS LAST, instrument) AS best, min(o) OVER (PARTITION BY sta) AS mo FROM o),
  cl AS (SELECT network, sta, instrument, CASE WHEN n > 1 AND mo IS NULL THEN 'no preferred instrument' WHEN n > 1 AND instrument <> best THEN 'colocated with ' || best END AS reason FROM b)"""


def colocated(spark, sf):
    d = stations(spark, sf).select("network", F.floor(F.col("station") / 3).alias("sta"), "instrument").distinct()
    return r.select_colocated(d, ["sta"], ["HN?", "BN?", "HH?", "BH?"]).withColumnRenamed("sta", "station")


@query(COL + " SELECT network, sta AS station, instrument, reason FROM cl")
def colocated_preferred(spark, sf):
    return colocated(spark, sf).select("network", "station", "instrument", "reason")


@query(COL + " SELECT reason, count(*)::BIGINT AS n FROM cl WHERE reason IS NOT NULL GROUP BY reason")
def status_short(spark, sf):
    return r.status(colocated(spark, sf), "short")


@query(COL + " SELECT network, count(*) FILTER (reason IS NULL)::BIGINT AS passed, count(reason)::BIGINT AS failed FROM cl GROUP BY network")
def status_net(spark, sf):
    return r.status(colocated(spark, sf), "net")


@query(COL + " SELECT network, sta AS station, instrument, coalesce(reason, '') AS reason FROM cl")
def status_long(spark, sf):
    return r.status(colocated(spark, sf), "long")


@query(COL + """, e AS (SELECT network % 5 AS network, reason, sta % 2 AS event FROM cl) SELECT network, sum(p)::BIGINT AS passed, sum(f)::BIGINT AS failed FROM
  (SELECT event, network, count(*) FILTER (reason IS NULL) AS p, count(reason) AS f FROM e GROUP BY event, network) GROUP BY network""")
def failure_rollup(spark, sf):
    d = colocated(spark, sf).withColumn("network", F.col("network") % 5)
    one, two = (r.status(d.where(F.col("station") % 2 == k), "net") for k in (0, 1))
    return one.unionByName(two).groupBy("network").agg(F.sum("passed").alias("passed"), F.sum("failed").alias("failed"))


@query(""", ep AS (SELECT c_custkey AS k, unnest(range(0, 4)) AS e FROM customer), x AS (SELECT o_orderkey, o_custkey, o_orderdate FROM orders)
  SELECT o_orderkey, e::INT AS epoch FROM x LEFT JOIN ep ON k = o_custkey AND o_orderdate >= TIMESTAMP '1992-01-01' + to_days((e * 800 + k % 100)::INT) AND o_orderdate < TIMESTAMP '1992-01-01' + to_days((e * 800 + k % 100 + 700)::INT)""")
def epoch_join(spark, sf):
    start = lambda add: F.timestamp_add("DAY", (F.col("e") * 800 + F.col("c_custkey") % 100 + add).cast("int"), F.lit("1992-01-01").cast("timestamp"))
    ep = table(spark, sf, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("e"))
    ep = ep.select(F.col("c_custkey").alias("epoch_key"), F.col("e").alias("epoch"), start(0).alias("epoch_start"), start(700).alias("epoch_end"))
    return r.epoch_join(table(spark, sf, "orders"), ep, "o_custkey", "o_orderdate").select("o_orderkey", "epoch")


def hav(a: str, b: str) -> str:
    return f"2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"


@query(f""", p AS (SELECT s.station, q.event, {hav('s', 'q')} AS km, (s.station * 3000.0::DOUBLE - q.time_s) / 3e5 AS dt, (10.0 - q.depth) / 50 AS dz, (s.magnitude - q.magnitude) / 1.0 AS dm FROM st s, qk q),
  z AS (SELECT station, event, km, sqrt(km / 1000 * km / 1000 + dt * dt + dz * dz + dm * dm) AS z FROM p WHERE km <= 1000), k AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY z, event) AS k FROM z)
  SELECT station, event, round(z, 6) AS z, round(km, 4) AS km FROM k WHERE k = 1""")
def nearest_event(spark, sf):
    t = stations(spark, sf).select("station", "lat", "lon", (F.col("station") * 3000.0).alias("time_s"), F.lit(10.0).alias("depth"), "magnitude")
    d = r.nearest_event(t, quakes(spark, sf), "station", 1000.0, 3e5, 50.0, 1.0, 10.0)
    return d.select("station", "event", r6(F.col("z")).alias("z"), r6(F.col("km"), 4).alias("km"))


BOXES = [("west_coast", -130.0, -110.0, 30.0, 50.0), ("pacific", 160.0, -150.0, -40.0, 40.0), ("europe", -10.0, 40.0, 35.0, 60.0)]


@query(""", b(provider, west, east, south, north) AS (VALUES ('west_coast', -130.0, -110.0, 30.0, 50.0), ('pacific', 160.0, -150.0, -40.0, 40.0), ('europe', -10.0, 40.0, 35.0, 60.0))
  SELECT station, provider FROM st, b WHERE lat BETWEEN south AND north AND CASE WHEN west <= east THEN lon BETWEEN west AND east ELSE lon >= west OR lon <= east END""")
def provider_bounds(spark, sf):
    b = F.broadcast(spark.createDataFrame(BOXES, "provider string, west double, east double, south double, north double"))  # a fixed list
    return r.within_bounds(stations(spark, sf), b).select("station", "provider")


@query(""", e AS (SELECT user_id, event_type, epoch_us(ts) / 1e6 AS t, value AS x FROM events), n AS (SELECT user_id, event_type, t, x, min(t) OVER (PARTITION BY user_id, event_type) AS t0, lead(t) OVER w AS t1, lead(x) OVER w AS x1 FROM e WINDOW w AS (PARTITION BY user_id, event_type ORDER BY t, x)),
  g AS (SELECT *, unnest(range(ceil((t - t0) / 3600)::BIGINT, ceil((t1 - t0) / 3600)::BIGINT)) AS k FROM n WHERE t1 > t)
  SELECT user_id AS station, event_type AS channel, k, round(x + (x1 - x) * (t0 + k * 3600 - t) / (t1 - t), 6) AS y FROM g""")
def uneven_resample(spark, sf):
    d = r.resample_even(samples(spark, sf), ["station", "channel"], 3600.0)
    return d.select("station", "channel", "k", r6(F.col("y")).alias("y"))


@query(""", e AS (SELECT user_id AS station, event_id, value * value AS s FROM events), n AS (SELECT station, row_number() OVER w AS n, avg(s) OVER (w ROWS 2 PRECEDING) AS a, avg(s) OVER (w ROWS 9 PRECEDING) AS l FROM e WINDOW w AS (PARTITION BY station ORDER BY event_id))
  SELECT station, round(max(CASE WHEN n >= 10 AND l > 0 THEN a / l END), 6) AS ratio, count(*)::BIGINT AS n FROM n GROUP BY station""")
def sta_lta_max(spark, sf):
    return r.sta_lta(samples(spark, sf), ["station"], "event_id", 3, 10).select("station", r6(F.col("ratio")).alias("ratio"), "n")


@query(""", e AS (SELECT user_id AS station, floor(epoch(ts))::BIGINT AS a, floor(epoch(ts))::BIGINT + 200000 AS b FROM events), t AS (SELECT *, max(b) OVER (PARTITION BY station ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM e),
  i AS (SELECT *, sum((m IS NULL OR a > m)::INT) OVER (PARTITION BY station ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM t) SELECT station, min(a) AS start, max(b) AS "end", count(*)::BIGINT AS n FROM i GROUP BY station, k""")
def merge_intervals(spark, sf):
    t = F.floor(F.unix_micros("ts") / 1000000)
    return r.merge_intervals(samples(spark, sf).select("station", t.alias("start"), (t + 200000).alias("end")), ["station"], "start", "end")


@query(""", k AS (SELECT trace_id, i, v, lag(v) OVER w AS a, lead(v) OVER w AS b FROM sm WINDOW w AS (PARTITION BY trace_id ORDER BY i)), p AS (SELECT trace_id, i, v, row_number() OVER (PARTITION BY trace_id ORDER BY v DESC, i) AS k FROM k WHERE v > a AND v > b)
  SELECT trace_id, k::INT AS k, i::INT AS i, round(v, 6) AS v FROM p WHERE k <= 5""")
def top_peaks(spark, sf):
    d = traces(spark, sf).select("trace_id", F.posexplode("x").alias("i", "v"))
    w = Window.partitionBy("trace_id").orderBy("i")
    d = d.withColumn("a", F.lag("v").over(w)).withColumn("b", F.lead("v").over(w)).where("v > a and v > b")
    return d.withColumn("k", F.row_number().over(Window.partitionBy("trace_id").orderBy(F.desc("v"), "i"))).where("k <= 5").select("trace_id", "k", "i", r6(F.col("v")).alias("v"))


@query(""", k AS (SELECT trace_id, i, stddev_pop(v) OVER (PARTITION BY trace_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS s, count(*) OVER (PARTITION BY trace_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS n FROM sm)
  SELECT trace_id, round(min(s), 6) AS least, round(max(s), 6) AS most FROM k WHERE n = 12 GROUP BY trace_id""")
def rolling_std(spark, sf):
    d = traces(spark, sf).select("trace_id", F.posexplode("x").alias("i", "v"))
    w = Window.partitionBy("trace_id").orderBy("i").rowsBetween(0, 11)
    d = d.withColumn("s", F.stddev_pop("v").over(w)).withColumn("n", F.count("v").over(w)).where("n = 12")
    return d.groupBy("trace_id").agg(r6(F.min("s")).alias("least"), r6(F.max("s")).alias("most"))


@query(""", p AS (SELECT user_id AS station, event_type AS picker, avg(CASE WHEN user_id % 3 < 2 OR event_type < 'm' THEN value END) AS pick, max(value) AS snr FROM events GROUP BY ALL)
  SELECT station, round(median(pick), 6) AS pick, count(pick)::BIGINT AS n, round(avg(pick), 6) AS mean, round(arg_max(pick, snr), 6) AS best FROM p GROUP BY station""")
def pick_combine(spark, sf):
    x = F.when((F.col("station") % 3 < 2) | (F.col("channel") < "m"), F.col("x"))  # other pickers find nothing
    p = r.added_in_order(samples(spark, sf), ["station", "channel"], ["event_id", "x"], pick=F.avg(x), snr=F.max("x"))
    d = r.pick_combine(p, ["station"], ("median", "mean", "max_snr"))
    return d.select("station", r6(F.col("median")).alias("pick"), "n", r6(F.col("mean")).alias("mean"), r6(F.col("max_snr")).alias("best"))


@query(""" SELECT station, CASE WHEN magnitude > 5.5 THEN 0.1 WHEN magnitude > 3.5 THEN 0.3 ELSE 0.5 END AS highpass, least(CASE WHEN magnitude > 5.5 THEN 40.0 WHEN magnitude > 3.5 THEN 35.0 ELSE 25.0 END, 0.75 * 50, 40.0) AS lowpass FROM st""")
def magnitude_corners(spark, sf):
    c = r.corners_by_magnitude(F.col("magnitude"))
    return stations(spark, sf).select("station", c["highpass"].alias("highpass"), F.least(c["lowpass"], F.lit(0.75 * 50), F.lit(40.0)).alias("lowpass"))


@query(""", s AS (SELECT user_id AS station, (event_id % 60)::DOUBLE / 2 AS freq, avg(value) / 20 AS snr FROM events GROUP BY ALL), u AS (SELECT *, snr > 1.5 AS up FROM s),
  n AS (SELECT *, CASE WHEN up AND NOT coalesce(lag(up) OVER (PARTITION BY station ORDER BY freq), false) THEN 1 ELSE 0 END AS nw FROM u), b AS (SELECT *, sum(nw) OVER (PARTITION BY station ORDER BY freq) AS band FROM n),
  g AS (SELECT station, band, min(freq) AS hp, max(freq) AS lp FROM b WHERE up GROUP BY ALL HAVING min(freq) <= 20 AND max(freq) > 21)
  SELECT station, arg_max(hp, band) AS highpass, arg_max(lp, band) AS lowpass FROM g GROUP BY station""")
def snr_corners(spark, sf):
    s = samples(spark, sf).groupBy("station", ((F.col("event_id") % 60).cast("double") / 2).alias("freq")).agg((F.avg("x") / 20).alias("snr"))
    return r.corners_by_snr(s, ["station"], 1.5, 20.0, 21.0)


@query(""", m AS (SELECT *, pow(10, 1.5 * magnitude + 16.05) AS m0 FROM st), f AS (SELECT *, 4.906e6 * 3.7 * pow(10.0 / m0, 1.0::DOUBLE / 3) AS f0 FROM m)
  SELECT station, greatest(120.0, dist_km) AS velocity, round(30 * magnitude - 30, 6) AS magnitude, round(5.0 + 1 / f0 + 0.15 * dist_km, 6) AS source_path FROM f""")
def signal_end(spark, sf):
    d = stations(spark, sf).withColumn("split", F.lit(5.0))
    return d.select("station", *(r6(r.signal_end(d, m)).alias(m) for m in ("velocity", "magnitude", "source_path")))


SPEC = """, m AS (SELECT station, dist_km, pow(10, 1.5 * magnitude + 16.05) AS m0, unnest([0.5, 1.0, 5.0, 20.0]::DOUBLE[]) AS f FROM st), s AS (SELECT *, 4.906e6 * 3.7 * pow(150.0 / m0, 1.0::DOUBLE / 3) AS f0 FROM m),
  p AS (SELECT *, 0.55 * 0.7071068 * 2.0 / (4 * pi() * 2.8 * pow(3.7, 3)) * 1e-20 * m0 / (1 + pow(f / f0, 2)) * pow(2 * pi() * f, 2) AS src, CASE WHEN dist_km <= 40 THEN 1 / dist_km ELSE 1 / sqrt(dist_km * 40) END * exp(-pi() * f * dist_km / (180 * pow(f, 0.45)) / 3.5) AS pth,
    exp(CASE f WHEN 0.5 THEN ln(1.39::DOUBLE) + 0.13 / 0.31 * (ln(1.58::DOUBLE) - ln(1.39::DOUBLE)) WHEN 1.0 THEN ln(1.58::DOUBLE) + 0.32 / 0.43 * (ln(1.77::DOUBLE) - ln(1.58::DOUBLE)) WHEN 5.0 THEN ln(2.24::DOUBLE) + 2.64 / 2.89 * (ln(2.75::DOUBLE) - ln(2.24::DOUBLE)) ELSE ln(2.75::DOUBLE) + 14.75 / 55.05 * (ln(4.49::DOUBLE) - ln(2.75::DOUBLE)) END) * exp(-pi() * 0.035 * f) AS ste FROM s)"""


@query(SPEC + " SELECT station, f AS freq, round(ln(src), 6) AS source, round(ln(pth), 6) AS path, round(ln(ste), 6) AS site, round(ln(src * pth * ste), 6) AS model FROM p")
def source_spectrum(spark, sf):
    d = stations(spark, sf).select("station", "dist_km", physics.moment(F.col("magnitude")).alias("m0"), F.explode(F.array(*map(F.lit, (0.5, 1.0, 5.0, 20.0)))).alias("f"))
    s, p, t = physics.brune(F.col("f"), F.col("m0")), physics.spreading(F.col("dist_km")) * physics.anelastic(F.col("f"), F.col("dist_km")), physics.site(F.col("f"))
    return d.select("station", F.col("f").alias("freq"), r6(F.ln(s)).alias("source"), r6(F.ln(p)).alias("path"), r6(F.ln(t)).alias("site"), r6(F.ln(s * p * t)).alias("model"))


@query(f""", p AS (SELECT s.station, {hav('s', 'q')} AS km, s.lat AS a, s.lon AS b, q.lat AS c, q.lon AS d, q.depth FROM st s JOIN qk q ON q.event = s.station % 50 + 1), z AS (SELECT *, degrees(atan2(sin(radians(d - b)) * cos(radians(c)), cos(radians(a)) * sin(radians(c)) - sin(radians(a)) * cos(radians(c)) * cos(radians(d - b)))) AS az FROM p)
  SELECT station, round(km, 4) AS repi, round(sqrt(km * km + greatest(depth, 0) * greatest(depth, 0)), 4) AS rhyp, round(CASE WHEN az < 0 THEN az + 360 ELSE az END, 4) AS back_azimuth FROM z""")
def station_metrics(spark, sf):
    q = quakes(spark, sf).select("event", F.col("lat").alias("qlat"), F.col("lon").alias("qlon"), F.greatest("depth", F.lit(0.0)).alias("z"))
    d = stations(spark, sf).withColumn("event", F.col("station") % 50 + 1).join(q, "event")
    km = physics.haversine_km(F.col("lat"), F.col("lon"), F.col("qlat"), F.col("qlon"))
    return d.select("station", r6(km, 4).alias("repi"), r6(F.sqrt(km * km + F.col("z") * F.col("z")), 4).alias("rhyp"), r6(physics.back_azimuth(F.col("lat"), F.col("lon"), F.col("qlat"), F.col("qlon")), 4).alias("back_azimuth"))


@query(""" SELECT user_id AS station, count(*)::BIGINT AS n, sum((props->>'$.k')::INT)::BIGINT AS total, count(DISTINCT props->>'$.k')::BIGINT AS kinds FROM events GROUP BY user_id""")
def json_params(spark, sf):
    k = F.get_json_object("props", "$.k")
    return samples(spark, sf).groupBy("station").agg(F.count(F.lit(1)).alias("n"), F.sum(k.cast("int")).alias("total"), F.count_distinct(k).alias("kinds"))


@query(""", s AS (SELECT trace_id, 'step' || unnest(['detrend', 'taper', 'filter']) AS step, unnest([1, 2, 3]) AS k, label FROM tr), a AS (SELECT trace_id, k, step, unnest(['index', 'label']) AS attribute, unnest([k, label]) AS value FROM s)
  SELECT trace_id, k::INT AS k, step, attribute, value::INT AS value FROM a""")
def provenance_explode(spark, sf):
    steps = F.array(*(F.struct(F.lit(f"step{n}").alias("step"), F.map_from_arrays(F.array(F.lit("index"), F.lit("label")), F.array(F.lit(k), F.col("label"))).alias("attrs")) for k, n in enumerate(("detrend", "taper", "filter"), 1)))
    d = traces(spark, sf).select("trace_id", "label").withColumn("provenance", steps)
    d = d.select("trace_id", F.posexplode("provenance").alias("k", "p"))
    return d.select("trace_id", (F.col("k") + 1).alias("k"), "p.step", F.explode("p.attrs").alias("attribute", "value"))


@query(""", m AS (SELECT record_id, component, unnest(['pga', 'cav']) AS imt, unnest([list_max(list_transform(x, lambda v: abs(v))), list_sum(list_transform(x, lambda v: abs(v))) / 64]) AS value FROM tr)
  SELECT record_id, component, round(max(value) FILTER (imt = 'cav'), 6) AS cav, round(max(value) FILTER (imt = 'pga'), 6) AS pga FROM m GROUP BY record_id, component""")
def flatfile_pivot(spark, sf):
    x = F.col("x")
    pairs = F.array(F.struct(F.lit("pga").alias("imt"), arrays.max_abs(x).alias("value")), F.struct(F.lit("cav").alias("imt"), arrays.mean(F.transform(x, lambda v: F.abs(v))).alias("value")))
    long = traces(spark, sf).select("record_id", "component", F.explode(pairs).alias("m")).select("record_id", "component", "m.*")
    return long.groupBy("record_id", "component").pivot("imt", ["cav", "pga"]).agg(r6(F.max("value")))


@query(""", k AS (SELECT unnest(range(1, 33)) AS k), f AS (SELECT trace_id, k / 0.64 AS f, sqrt(pow(sum(v * cos(2 * pi() * k * i / 64)), 2) + pow(sum(v * sin(2 * pi() * k * i / 64)), 2)) AS s FROM sm, k GROUP BY trace_id, k),
  n AS (SELECT *, lead(f) OVER w AS f1, lead(s) OVER w AS s1 FROM f WINDOW w AS (PARTITION BY trace_id ORDER BY f)), q AS (SELECT unnest([2.0, 5.0, 10.0, 40.0]::DOUBLE[]) AS q)
  SELECT trace_id, q AS freq, round(s + (s1 - s) * (q - f) / (f1 - f), 6) AS value FROM n, q WHERE q >= f AND q < f1""")
def snr_table(spark, sf):
    spec = wf.spectra(traces(spark, sf).select("trace_id", "x"), DT).select("trace_id", F.posexplode("spec").alias("k", "s")).where("k > 0").withColumn("f", F.col("k") / 0.64).withColumn("s", F.col("s") / DT)
    w = Window.partitionBy("trace_id").orderBy("f")
    d = spec.withColumn("f1", F.lead("f").over(w)).withColumn("s1", F.lead("s").over(w)).withColumn("freq", F.explode(F.filter(F.array(*map(F.lit, (2.0, 5.0, 10.0, 40.0))), lambda q: (q >= F.col("f")) & (q < F.col("f1")))))
    return d.select("trace_id", "freq", r6(F.col("s") + (F.col("s1") - F.col("s")) * (F.col("freq") - F.col("f")) / (F.col("f1") - F.col("f"))).alias("value"))


@query(""", l AS (SELECT l_partkey AS record, l_quantity AS hp, l_extendedprice AS lp FROM lineitem) SELECT record, max(hp) AS highpass, min(lp) AS lowpass FROM l GROUP BY record""")
def effective_corners(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("record"), F.create_map(F.lit("hp"), F.col("l_quantity"), F.lit("lp"), F.col("l_extendedprice")).alias("corners"))
    d = d.select("record", F.explode("corners"))
    return d.groupBy("record").agg(F.max(F.when(F.col("key") == "hp", F.col("value"))).alias("highpass"), F.min(F.when(F.col("key") == "lp", F.col("value"))).alias("lowpass"))


@query(""" SELECT o_orderpriority AS label, count(*)::BIGINT AS n, arg_max(o_orderstatus, o_orderkey) AS last_status, max(o_orderdate) AS latest FROM orders GROUP BY 1""")
def label_summary(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.max_by("o_orderstatus", "o_orderkey").alias("last_status"), F.max("o_orderdate").alias("latest"))


@query(""" SELECT c_custkey AS station FROM customer SEMI JOIN orders ON c_custkey = o_custkey""")
def requested_present(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select(F.col("c_custkey").alias("station"))


@query(""" SELECT c_custkey AS station FROM customer ANTI JOIN orders ON c_custkey = o_custkey""")
def not_readable(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.col("c_custkey").alias("station"))


@query(""", rv AS (SELECT station, CASE WHEN station % 7 = 0 THEN true WHEN station % 7 = 1 THEN false END AS accepted FROM st WHERE station % 7 < 2), a AS (SELECT s.station, s.quality, accepted FROM st s LEFT JOIN rv ON s.station = rv.station)
  SELECT station, CASE WHEN accepted = false THEN 'Manual review' WHEN accepted THEN NULL WHEN quality < 0 THEN 'low quality' END AS reason FROM a""")
def review_override(spark, sf):
    d = stations(spark, sf)
    rev = d.where("station % 7 < 2").select("station", (F.col("station") % 7 == 0).alias("accepted"))
    d = d.join(rev, "station", "left")
    d = r.failed(d, "review", "Manual review", ~F.col("accepted"))
    d = r.failed(d, "quality", "low quality", (F.col("quality") < 0) & ~F.coalesce("accepted", F.lit(False)))
    return d.select("station", F.col("failure.reason").alias("reason"))


@query(""" SELECT s.station, coalesce(n_name, '--') AS name, coalesce(r_name, '--') AS region FROM st s LEFT JOIN nation ON n_nationkey = s.network + 3 LEFT JOIN region ON r_regionkey = n_regionkey""")
def code_table(spark, sf):
    n, g = table(spark, sf, "nation"), table(spark, sf, "region")
    d = stations(spark, sf).join(n, F.col("n_nationkey") == F.col("network") + 3, "left").join(g, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return d.select("station", F.coalesce("n_name", F.lit("--")).alias("name"), F.coalesce("r_name", F.lit("--")).alias("region"))


@query(f""", p AS (SELECT s.station, q.event, {hav('s', 'q')} AS km FROM st s JOIN qk q ON s.station % 25 = q.event % 25), c AS (SELECT *, count(*) OVER (PARTITION BY station) AS n FROM p WHERE km < 4000)
  SELECT s.station, CASE WHEN c.n = 1 THEN c.event END AS record FROM st s LEFT JOIN (SELECT DISTINCT ON (station) * FROM c WHERE n = 1) c ON s.station = c.station""")
def unique_match(spark, sf):
    q = quakes(spark, sf).select((F.col("event") % 25).alias("k"), "event", F.col("lat").alias("qlat"), F.col("lon").alias("qlon"))
    s = stations(spark, sf)
    near = s.withColumn("k", F.col("station") % 25).join(q, "k").where(physics.haversine_km(F.col("lat"), F.col("lon"), F.col("qlat"), F.col("qlon")) < 4000)
    one = near.groupBy("station").agg(F.count(F.lit(1)).alias("n"), F.max("event").alias("record")).where("n = 1").select("station", "record")
    return s.select("station").join(one, "station", "left")


@query(""", a AS (SELECT o_custkey AS record, count(*) AS n, sum(o_totalprice) AS v FROM orders GROUP BY 1) SELECT a.record, a.n::BIGINT AS n, round(a.v, 2) AS value, st.instrument, round(st.dist_km, 4) AS dist_km FROM a JOIN st ON a.record = st.station""")
def metrics_join_stations(spark, sf):
    a = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("record")).agg(F.count(F.lit(1)).alias("n"), r6(F.sum("o_totalprice"), 2).alias("value"))
    return a.join(stations(spark, sf), F.col("record") == F.col("station")).select("record", "n", "value", "instrument", r6(F.col("dist_km"), 4).alias("dist_km"))


@query(""" SELECT trace_id, CASE WHEN label > 7 THEN 'max_amp' WHEN list_max(list_transform(x, lambda v: abs(v))) > 0.35 THEN 'amplitude' WHEN trace_id % 5 = 0 THEN 'sample_rate' END AS reason FROM tr""")
def qa_gates(spark, sf):
    d = traces(spark, sf)
    d = r.failed(d, "label", "max_amp", F.col("label") > 7)
    d = r.failed(d, "amplitude", "amplitude", arrays.max_abs(F.col("x")) > 0.35)
    d = r.failed(d, "rate", "sample_rate", F.col("trace_id") % 5 == 0)
    return d.select("trace_id", F.col("failure.reason").alias("reason"))


@query(""", g AS (SELECT record_id, count(*) AS n, count(*) FILTER (label % 4 <> 0) AS p FROM tr GROUP BY record_id) SELECT record_id, n::BIGINT AS n, p::BIGINT AS passed, CASE WHEN record_id % 2 = 0 THEN p >= 3 ELSE p >= 1 END AS kept FROM g""")
def record_kept(spark, sf):
    g = traces(spark, sf).groupBy("record_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") % 4 != 0).alias("passed"))
    return g.withColumn("kept", F.when(F.col("record_id") % 2 == 0, F.col("passed") >= 3).otherwise(F.col("passed") >= 1))


@query(""" SELECT record_id, count(DISTINCT label) > 1 AS mixed_label, count(DISTINCT npts) > 1 AS mixed_npts, count(DISTINCT channel) < count(*) AS repeated_channel FROM tr GROUP BY record_id""")
def record_checks(spark, sf):
    return traces(spark, sf).groupBy("record_id").agg((F.count_distinct("label") > 1).alias("mixed_label"), (F.count_distinct("npts") > 1).alias("mixed_npts"), (F.count_distinct("channel") < F.count(F.lit(1))).alias("repeated_channel"))


@query(""" SELECT station, printf('%s.%05d.%s.%s', network::VARCHAR, station, '--', instrument) AS id, CASE WHEN 10 <= station % 120 AND station % 120 < 80 THEN 'B' ELSE 'H' END || 'N' AS channel, printf('%.2f', dist_km) AS dist FROM st""")
def station_ids(spark, sf):
    d = stations(spark, sf)
    return d.select("station", F.concat_ws(".", F.col("network").cast("string"), F.format_string("%05d", "station"), F.lit("--"), F.col("instrument")).alias("id"), F.concat(physics.band_code(F.col("station") % 120), F.lit("N")).alias("channel"), F.format_string("%.2f", "dist_km").alias("dist"))
