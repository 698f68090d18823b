"""Queries over whole records: windows, noise, corners, steps, metrics, names and catalogs, each with the SQL it must equal where SQL can say it."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from smframe.functions import arrays
from smframe.operators import clipping, corners, filters, metrics, windows
from smframe.operators import relational as r
from smframe.operators import waveform as w
from smframe.plans import process
from smframe.plans.waveform_queries import PAIRS, PI, exploded, r6
from smframe.sources import catalogs, names
from smframe.sources.adapters import DT, SQL, quakes, stations, table, traces

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
WITH = "WITH RECURSIVE " + SQL


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = WITH + sql
        return f

    return add


def records(spark, sf):
    """traces with a sampling rate, windows and a magnitude, and no failure yet."""
    d = traces(spark, sf).withColumns({"sampling_rate": F.lit(1 / DT), "magnitude": 3.0 + F.col("label") / 4.0, "dist_km": 20.0 + F.col("record_id") % 90, "arrival": F.col("label") * 0.04, "origin": F.lit(-1.0)})
    return d.withColumn("failure", F.lit(None).cast(process.FAILURE))


#: The same in SQL.
REC = """, rec AS (SELECT *, 100.0::DOUBLE AS rate, 3.0::DOUBLE + label / 4.0::DOUBLE AS magnitude, 20.0::DOUBLE + record_id % 90 AS dist_km, label * 0.04::DOUBLE AS arrival, -1.0::DOUBLE AS origin FROM tr)"""


@query(REC + """, p AS (SELECT trace_id, greatest(min(arrival) OVER (PARTITION BY record_id) - 0.03, 0) AS split FROM rec)
  SELECT trace_id, round(split, 6) + 0.0 AS split, CASE WHEN 0.63 - split < 0.5 THEN 'Failed signal window duration check.' WHEN split < 0.05 THEN 'Failed noise window duration check.' END AS reason FROM p""")
def signal_split(spark, sf):
    d = windows.window_checks(windows.signal_split(records(spark, sf), ["record_id"], shift=-0.03), 0.05, 0.5)
    return d.select("trace_id", r6(F.col("split")).alias("split"), F.col("failure.reason").alias("reason"))


@query(REC + """, p AS (SELECT *, greatest(min(arrival) OVER (PARTITION BY record_id) - 0.03, 0) AS split FROM rec),
  f AS (SELECT *, 1 / (4.906e6 * 3.7 * pow(10.0 / pow(10, 1.5 * magnitude + 16.05), 1.0::DOUBLE / 3)) AS source FROM p)
  SELECT trace_id, round(least(-1 + greatest(0.3, dist_km / 60), 0.63), 6) + 0.0 AS velocity, round(least(split + source + 0.05 + 0.001 * dist_km, 0.63), 6) + 0.0 AS source_path, round(least(-1 + 30 * magnitude - 30, 0.63), 6) + 0.0 AS magnitude, 0.63::DOUBLE AS none FROM f""")
def signal_end_of_records(spark, sf):
    d = windows.signal_split(records(spark, sf), ["record_id"], shift=-0.03)
    ends = {"velocity": {"vmin": 60.0, "floor": 0.3}, "source_path": {"dur0": 0.05, "dur1": 0.001}, "magnitude": {}, "none": {}}
    for k, o in ends.items():
        d = windows.signal_end(d, k, **o).withColumnRenamed("signal_end", f"end_{k}")
    return d.select("trace_id", *(r6(F.col(f"end_{k}")).alias(k) for k in ends))


@query(REC + """, p AS (SELECT *, greatest(min(arrival) OVER (PARTITION BY record_id) - 0.03, 0) AS split FROM rec), c AS (SELECT *, greatest(round((split - 0.05) * 100), 0)::INT AS a FROM p)
  SELECT trace_id, len(x) - a AS n, round(split - a / 100.0::DOUBLE, 6) + 0.0 AS split, round(list_sum(x[a + 1:]), 6) + 0.0 AS total FROM c""")
def cut_window(spark, sf):
    d = windows.signal_end(windows.signal_split(records(spark, sf), ["record_id"], shift=-0.03), "none")
    d = windows.cut(d, 0.05)
    return d.select("trace_id", F.size("x").cast("long").alias("n"), r6(F.col("split")).alias("split"), r6(arrays.total(F.col("x"))).alias("total"))


@query(REC + f""", n AS (SELECT trace_id, x[1:13] AS y FROM tr UNION ALL SELECT trace_id, x[13:64] FROM tr), k AS (SELECT trace_id, len(y) AS m, list_transform(y, lambda v: v - list_avg(y)) AS y FROM n), t AS (SELECT trace_id, m, floor(m * 0.05)::INT AS k, y FROM k),
  s AS (SELECT trace_id, m, generate_subscripts(y, 1) - 1 AS i, unnest(list_transform(range(1, m + 1), lambda i: y[i] * CASE WHEN i <= k THEN 0.5 * (1 - cos({PI} * (i - 1) / k)) WHEN i > m - k THEN 0.5 * (1 - cos({PI} * (m - i) / k)) ELSE 1 END)) AS v FROM t),
  fq AS (SELECT unnest(range(1, 33)) AS q), sp AS (SELECT trace_id, m, q, 0.01 * sqrt(pow(sum(v * cos(2 * {PI} * q * i / 64)), 2) + pow(sum(v * sin(2 * {PI} * q * i / 64)), 2)) AS a FROM s, fq GROUP BY trace_id, m, q),
  ct AS (SELECT unnest(range(0, 63)) AS c), c2 AS (SELECT c, pow(10, log10(100.0 / 64) + c / 62.0 * (log10(50.0) - log10(100.0 / 64))) AS fc FROM ct),
  wt AS (SELECT trace_id, m, fc, a, 20 * log10(q * 100.0 / 64 / fc) AS u FROM sp, c2), sm2 AS (SELECT trace_id, m, fc, sum(a * CASE WHEN abs(u) < 1e-9 THEN 1 WHEN abs(u) > 3 THEN 0 ELSE pow(sin(u) / u, 4) END) / sum(CASE WHEN abs(u) < 1e-9 THEN 1 WHEN abs(u) > 3 THEN 0 ELSE pow(sin(u) / u, 4) END) AS y FROM wt GROUP BY ALL),
  ne AS (SELECT a.trace_id, a.fc, a.y AS noise, b.y AS event FROM sm2 a JOIN sm2 b ON a.trace_id = b.trace_id AND a.fc = b.fc AND a.m = 13 AND b.m = 52)
  SELECT trace_id, count(*)::BIGINT AS n, round(avg((event - noise * sqrt(0.51 / 0.12)) / sqrt(0.51) / (noise * sqrt(0.51 / 0.12) / sqrt(0.12))), 5) + 0.0 AS mean_snr FROM ne GROUP BY trace_id""")
def compute_snr(spark, sf):
    d = windows.compute_snr(records(spark, sf).withColumn("split", F.lit(0.12)))
    return d.select("trace_id", F.size("snr").cast("long").alias("n"), (F.round(arrays.mean(F.col("snr")), 5) + F.lit(0.0)).alias("mean_snr"))


@query(""", s AS (SELECT user_id AS station, event_type AS channel, (event_id % 24)::INT AS k, avg(value) / 20 AS snr FROM events GROUP BY ALL), f AS (SELECT station, channel, k, 0.1 * pow(1.3, k) AS f, snr, lead(snr) OVER o AS nx, lead(0.1 * pow(1.3, k)) OVER o AS fn, row_number() OVER o AS rn, max(0.1 * pow(1.3, k)) OVER (PARTITION BY station, channel) AS top FROM s WINDOW o AS (PARTITION BY station, channel ORDER BY k)),
  up AS (SELECT station, channel, row_number() OVER (PARTITION BY station, channel ORDER BY f) AS j, f FROM (SELECT station, channel, f FROM f WHERE rn = 1 AND snr > 1 UNION ALL SELECT station, channel, fn FROM f WHERE sign(nx - 1) > sign(snr - 1)) z),
  dn AS (SELECT station, channel, row_number() OVER (PARTITION BY station, channel ORDER BY f) AS j, f FROM f WHERE sign(nx - 1) < sign(snr - 1)), tp AS (SELECT DISTINCT station, channel, top FROM f),
  pr AS (SELECT up.station, up.channel, up.j, up.f AS lo, coalesce(dn.f, top) AS hi FROM up JOIN tp ON up.station = tp.station AND up.channel = tp.channel LEFT JOIN dn ON up.station = dn.station AND up.channel = dn.channel AND up.j = dn.j)
  SELECT station, channel, round(max_by(lo, j) FILTER (lo <= 1 AND hi > 3), 6) AS low, round(max_by(hi, j) FILTER (lo <= 1 AND hi > 3), 6) AS high FROM tp LEFT JOIN pr USING (station, channel) GROUP BY station, channel""")
def snr_corners_of_records(spark, sf):
    from smframe.plans.relational_queries import samples

    # a ratio may lie at the threshold, so sums are added in a fixed order
    s = samples(spark, sf).withColumn("k", (F.col("event_id") % 24).cast("int"))
    s = r.added_in_order(s, ["station", "channel", "k"], ["event_id", "x"], s=F.avg("x")).withColumn("s", F.col("s") / 20)
    s = s.groupBy("station", "channel").agg(F.sort_array(F.collect_list(F.struct("k", "s"))).alias("z"))  # 24 frequencies at most
    freq, snr = F.transform("z", lambda z: 0.1 * F.pow(F.lit(1.3), z["k"])), F.transform("z", lambda z: z["s"])
    d = s.select("station", "channel", freq.alias("snr_freq"), snr.alias("snr"), F.lit(1.0).alias("snr_threshold"), F.lit(1.0).alias("snr_min_freq"), F.lit(3.0).alias("snr_max_freq"), F.lit(1e9).alias("split"), F.lit(1.0).alias("sampling_rate"), F.lit(1e9).alias("signal_end"))
    d = windows.corners_from_snr(d, same_horizontals=False)
    return d.select("station", "channel", F.round("highpass", 6).alias("low"), F.round("lowpass", 6).alias("high"))


@query(""" SELECT station, CASE WHEN magnitude > 5.5 THEN 0.1 WHEN magnitude > 3.5 THEN 0.3 ELSE 0.5 END::DOUBLE AS highpass, least(CASE WHEN magnitude > 5.5 THEN 40 WHEN magnitude > 3.5 THEN 35 ELSE 25 END, 0.75 * 0.5 * (40 + station % 100), 40)::DOUBLE AS lowpass FROM st""")
def capped_corners(spark, sf):
    d = windows.magnitude_corners(stations(spark, sf)).withColumn("sampling_rate", 40.0 + F.col("station") % 100)
    return process.lowpass_max_frequency(d).select("station", "highpass", "lowpass")


@query(""" SELECT trace_id, round(list_max(list_transform(x, lambda v: abs(v * 100 / (50.0 + record_id % 7)))), 6) AS pga, CASE WHEN record_id % 5 = 0 THEN 'Sample rate is not consistent between data and metadata' END AS reason FROM tr""")
def remove_sensitivity(spark, sf):
    d = records(spark, sf).withColumn("sensitivity", 50.0 + F.col("record_id") % 7).withColumn("response_rate", F.when(F.col("record_id") % 5 == 0, 50.0).otherwise(100.0))
    d = process.remove_response(d, pre_filt=False)
    scaled = F.when(F.col("failure").isNull(), F.lit(1.0)).otherwise(100 / F.col("sensitivity"))
    return d.select("trace_id", r6(arrays.max_abs(F.col("x")) * scaled).alias("pga"), F.col("failure.reason").alias("reason"))


@query(""", c AS (SELECT trace_id, i, sum(v * v) OVER (o ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) / 4 AS s, sum(v * v) OVER (o ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) / 16 AS l FROM sm WINDOW o AS (PARTITION BY trace_id ORDER BY i))
  SELECT trace_id, max(s / l) FILTER (i >= 15) < 2 AS failed FROM c GROUP BY trace_id""")
def check_sta_lta(spark, sf):
    d = process.check_sta_lta(records(spark, sf), 4 * DT, 16 * DT, 2.0)
    return d.select("trace_id", F.col("failure").isNotNull().alias("failed"))


@query(""", a AS (SELECT trace_id, i, coalesce(sum((v + p) * 0.005) OVER (PARTITION BY trace_id ORDER BY i), 0) AS vel FROM (SELECT *, lag(v) OVER (PARTITION BY trace_id ORDER BY i) AS p FROM sm) z),
  b AS (SELECT trace_id, i, vel, coalesce(sum((vel + p) * 0.005) OVER (PARTITION BY trace_id ORDER BY i), 0) AS dis FROM (SELECT *, lag(vel) OVER (PARTITION BY trace_id ORDER BY i) AS p FROM a) z)
  SELECT trace_id, round(max(abs(vel)) FILTER (i >= 53) / max(abs(vel)), 6) AS vel_ratio, round(max(abs(dis)) FILTER (i >= 53) / max(abs(dis)), 6) AS dis_ratio, max(abs(vel)) FILTER (i >= 53) > 0.8 * max(abs(vel)) OR max(abs(dis)) FILTER (i >= 53) > 0.99 * max(abs(dis)) AS failed FROM b GROUP BY trace_id""")
def check_tail(spark, sf):
    d = windows.tail_ratios(traces(spark, sf).select("trace_id", "x"), 10 * DT, DT, frequency=False)
    return d.select("trace_id", r6(F.col("vel_ratio")).alias("vel_ratio"), r6(F.col("dis_ratio")).alias("dis_ratio"), ((F.col("vel_ratio") > 0.8) | (F.col("dis_ratio") > 0.99)).alias("failed"))


@query(""", g AS (SELECT trace_id, x, list_reduce(list_prepend([0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE], list_transform(range(1, 65), lambda i: [i::DOUBLE, x[i], 0.0::DOUBLE, 0.0::DOUBLE])),
    lambda s, t: [0.2 * t[2] + 0.8 * s[1], 0.0::DOUBLE, s[3] + pow(0.8, t[1] - 1) * (t[2] - s[1]), s[4] + pow(0.64, t[1] - 1)]) AS e FROM tr)
  SELECT trace_id, round(e[3] / e[4], 6) + 0.0 AS first_level, round(e[1] + pow(0.8, 64) * e[3] / e[4], 6) + 0.0 AS next_level FROM g""")
def exponential_smoothing(spark, sf):
    d = w.measured(traces(spark, sf).select("trace_id", "x"), DT, a=lambda x, t: clipping.exponential_smoothing(x, 0.2)[0], b=lambda x, t: 0.2 * x[-1] + 0.8 * clipping.exponential_smoothing(x, 0.2)[-1])
    return d.select("trace_id", r6(F.col("a")).alias("first_level"), r6(F.col("b")).alias("next_level"))


@query()
def histogram_clipping(spark, sf):
    """Bumps of the amplitude histogram; an iterative search, so rows only. See the tests."""
    return clipping.detectors(traces(spark, sf), ["trace_id"], DT).select("trace_id", "n_hist", "clip_hist")


_NET = {"w1": [[0.3, -0.2], [0.01, 0.02], [1.0, 0.5], [0.4, -0.7], [0.2, 0.9]], "b1": [0.1, -0.3], "w2": [1.2, -0.8], "b2": -0.4, "scale": [0.4, 0.004, 2.0, 2.0, 2.0]}


@query(REC + """, pk AS (SELECT trace_id, record_id, list_max(list_transform(x, lambda v: abs(v))) AS m, x FROM tr), qt AS (SELECT trace_id, list_filter(range(1, 65), lambda i: abs(x[i]) < 0.05 * m) AS q FROM pk), ct AS (SELECT trace_id, list_max(list_filter(list_transform(range(2, len(q) + 1), lambda j: CASE WHEN q[j] - q[j - 1] > 1 THEN q[j] END), lambda v: v IS NOT NULL)) AS e FROM qt),
  y AS (SELECT pk.trace_id, record_id, x[1:coalesce(e - 1, 64)] AS y FROM pk LEFT JOIN ct ON pk.trace_id = ct.trace_id), h AS (SELECT record_id, max((list_max(list_transform(y, lambda v: abs(v - list_avg(y)))) > 6e6)::INT) AS a, max((coalesce(list_max(list_transform(range(2, len(y) + 1), lambda i: abs(y[i] - y[i - 1]))), 0) > 0.57 * (abs(list_max(y)) - list_min(y)))::INT) AS p FROM y GROUP BY record_id),
  e AS (SELECT h.record_id, a, p, least(greatest(any_value(magnitude), 4), 8.8) AS mg, least(greatest(any_value(dist_km), 0), 445) AS ds FROM h JOIN rec ON h.record_id = rec.record_id AND rec.component = 'H1' GROUP BY h.record_id, a, p),
  o AS (SELECT record_id, greatest(0.3 * 0.4 * mg + 0.01 * 0.004 * ds + 1.0 * 2 * a + 0.2 * 2 * p + 0.1, 0) AS h1, greatest(-0.2 * 0.4 * mg + 0.02 * 0.004 * ds + 0.5 * 2 * a + 0.9 * 2 * p - 0.3, 0) AS h2 FROM e)
  SELECT record_id, round(1 / (1 + exp(-(1.2 * h1 - 0.8 * h2 - 0.4))), 6) AS probability FROM o""")
def clipping_network(spark, sf):
    """The record's network, over detectors without the histogram's (whose search SQL can't say)."""
    d = records(spark, sf)
    found = clipping.detectors(d, ["record_id", "sampling_rate"]).withColumn("clip_hist", F.lit(False))
    p = clipping.record_probability(found, d.where("component = 'H1'"), "record_id", _NET)
    return p.select("record_id", r6(F.col("probability")).alias("probability"))


@query()
def bandpass_time_domain(spark, sf):
    """A causal recursive filter; tested against its transfer function."""
    return exploded(filters.filtered_td(traces(spark, sf).select("trace_id", "x"), DT, 5.0, 20.0, 4), "filtered", "y")


@query()
def highpass_corners(spark, sf):
    """Corner searches by root finding on fitted displacement; tested on signals whose answer is known."""
    d = corners.adjusted_corners(traces(spark, sf).select("trace_id", "x"), DT, 0.5, 40.0)
    return d.select("trace_id", r6(F.col("raised")).alias("raised"), r6(F.col("ridder")).alias("ridder"), F.col("onset").cast("int").alias("onset"))


@query()
def baseline_sixth_order(spark, sf):
    d = corners.corrected(traces(spark, sf).select("trace_id", "x"), DT, frequency=False)
    return d.select("trace_id", r6(arrays.max_abs(F.col("baseline"))).alias("peak"))


@query()
def process_waveforms(spark, sf):
    """A list of steps run by the interpreter: one row a trace with its state; the steps have their own queries and tests."""
    plan = [{"check_instrument": None}, {"min_sample_rate": None}, {"signal_split": {"shift": -0.03}}, {"signal_end": {"method": "none"}}, {"window_checks": {"min_noise_duration": 0.0, "min_signal_duration": 0.2}}, {"detrend": None}, {"taper": None}, {"get_corner_frequencies": {"method": "constant", "constant": {"highpass": 2.0, "lowpass": 30.0}}}, {"zero_pad": {"length": 0.1}}, {"bandpass_filter": None}, {"strip_zero_pad": None}, {"integrate": None}]
    d = process.run(records(spark, sf), plan)
    return d.select("trace_id", F.col("failure.module").alias("module"), F.size("provenance").alias("steps"), "process_level", r6(arrays.max_abs(F.col("x")), 1e3).alias("pgv"))


def exploded_steps(d):
    return d.select("trace_id", F.posexplode("provenance").alias("position", "s")).select("trace_id", "position", F.col("s.step").alias("step"), F.col("s.options").alias("options"))


@query(""", p AS (SELECT trace_id, record_id, component, count(*) OVER (PARTITION BY record_id) AS n, count(*) FILTER (component <> 'Z') OVER (PARTITION BY record_id) AS h FROM tr), s AS (SELECT unnest([0, 1, 2]) AS position, unnest(['check_instrument', 'detrend', 'taper']) AS step, unnest(['{}', '{"method": "demean"}', '{"width": 0.1}']) AS options)
  SELECT trace_id, position::INT AS position, step, options FROM p, s WHERE position = 0 OR (n BETWEEN 2 AND 3 AND h >= 2)""")
def provenance_steps(spark, sf):
    """Each trace's own steps: failed ones took no further."""
    return exploded_steps(process.run(records(spark, sf), [{"check_instrument": None}, {"detrend": {"method": "demean"}}, {"taper": {"width": 0.1}}]))


# ---- metrics ---------------------------------------------------------------------------------------------------


def acc(spark, sf):
    return traces(spark, sf).withColumn("sampling_rate", F.lit(1 / DT))


@query(PAIRS + f""", p AS (SELECT record_id, component, list_max(list_transform(x, lambda v: abs(v))) / 9.80665 AS pga, list_reduce(list_prepend(0.0::DOUBLE, list_transform(range(1, 64), lambda i: (abs(x[i]) + abs(x[i + 1])) * 0.005 * 0.01 / 9.80665)), lambda a, b: a + b) AS cav FROM tr),
  c AS (SELECT record_id, 'Channels(component=' || component || ')' AS imc, 'PGA' AS imt, pga AS v FROM p UNION ALL SELECT record_id, 'Channels(component=' || component || ')', 'CAV', cav FROM p UNION ALL SELECT record_id, 'GeometricMean()', 'PGA', exp(avg(ln(pga))) FROM p GROUP BY record_id UNION ALL SELECT record_id, 'ArithmeticMean()', 'CAV', avg(cav) FROM p GROUP BY record_id),
  t AS (SELECT unnest(range(0, 181)) AS t), q AS (SELECT record_id, list_max(list_transform(range(1, 65), lambda i: abs(x1[i] * cos(t * {PI} / 180) + x2[i] * sin(t * {PI} / 180)))) / 9.80665 AS v FROM hp, t)
  SELECT record_id, imc, imt, round(v * 1e3, 5) AS result FROM c UNION ALL SELECT record_id, 'RotD(percentile=50.0)', 'PGA', round(quantile_cont(v, 0.5) * 1e3, 5) FROM q GROUP BY record_id UNION ALL SELECT record_id, 'RotD(percentile=100.0)', 'PGA', round(max(v) * 1e3, 5) FROM q GROUP BY record_id""")
def waveform_metrics(spark, sf):
    m = metrics.compute(acc(spark, sf), ["channels-pga", "channels-cav", "geometric_mean-pga", "arithmetic_mean-cav", "rotd-pga"], options=metrics.Options(percentiles=(50.0, 100.0)))
    return m.where("not (imc = 'GeometricMean()' and imt = 'CAV') and not (imc = 'ArithmeticMean()' and imt = 'PGA')").select("record_id", "imc", "imt", F.round(F.col("result") * 1e3, 5).alias("result"))


@query()
def rotd_metrics(spark, sf):
    """RotD of PGV and of all spectral measures at two percentiles; the oscillator and the rotation have queries with SQL of their own."""
    m = metrics.compute(acc(spark, sf), [f"rotd-{k}" for k in ("pgv", "sa", "psa", "sv", "psv", "sd")], options=metrics.Options(periods=(0.05, 0.2), percentiles=(50.0, 100.0)))
    return m.select("record_id", "imc", "imt", F.round(F.col("result") * 1e6, 3).alias("result"))


@query()
def quadratic_mean_fas(spark, sf):
    """The wide table of smoothed spectra, a column for each frequency."""
    o = metrics.Options(frequencies=(2.0, 5.0, 10.0, 20.0), bandwidth=20.0)
    m = metrics.compute(acc(spark, sf), ["quadratic_mean-fas"], options=o)
    return metrics.tables(m.withColumn("result", F.round(F.col("result") * 1e3, 6)), "record_id", "QuadraticMean()", [f"FAS(f={f:.6f})" for f in o.frequencies])


@query(""", m AS (SELECT p_partkey AS metric, CASE p_partkey % 3 WHEN 0 THEN printf('SA(T=%.4f, D=%.3f)', (p_size % 5) / 2.0::DOUBLE, 5.0::DOUBLE) WHEN 1 THEN 'PGA' ELSE printf('FAS(f=%.6f)', p_size / 4.0::DOUBLE) END AS imt FROM part) SELECT metric, imt FROM m WHERE imt = 'SA(T=1.0000, D=5.000)'""")
def select_metric(spark, sf):
    k = F.col("p_partkey") % 3
    imt = F.when(k == 0, F.format_string("SA(T=%.4f, D=%.3f)", (F.col("p_size") % 5) / 2.0, F.lit(5.0))).when(k == 1, "PGA").otherwise(F.format_string("FAS(f=%.6f)", F.col("p_size") / 4.0))
    return metrics.select(table(spark, sf, "part").select(F.col("p_partkey").alias("metric"), imt.alias("imt")), "SA", T="1.0000", D="5.000")


@query(""", m AS (SELECT p_partkey, p_size, CASE p_partkey % 4 WHEN 0 THEN 'SA(' || p_size || '.5)' WHEN 1 THEN 'ROTD' || p_size WHEN 2 THEN 'duration5-' || p_size ELSE 'PGA' END AS name FROM part)
  SELECT p_partkey AS metric, name, CASE p_partkey % 4 WHEN 0 THEN p_size || '.5' WHEN 1 THEN p_size::VARCHAR WHEN 2 THEN '5.' || p_size END AS number, CASE WHEN p_partkey % 4 = 2 THEN 5 END::INT AS first, CASE WHEN p_partkey % 4 = 2 THEN p_size END::INT AS last FROM m""")
def parse_names(spark, sf):
    k, s = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    name = F.when(k == 0, F.concat(F.lit("SA("), s, F.lit(".5)"))).when(k == 1, F.concat(F.lit("ROTD"), s)).when(k == 2, F.concat(F.lit("duration5-"), s)).otherwise("PGA")
    d = table(spark, sf, "part").select(F.col("p_partkey").alias("metric"), name.alias("name"))
    return d.select("metric", "name", names.number_in(F.col("name")).alias("number"), names.interval_in(F.col("name"))["first"].alias("first"), names.interval_in(F.col("name"))["last"].alias("last"))


# ---- names, units, catalogs, joins -----------------------------------------------------------------------------


@query(""" SELECT trace_id, network || '.' || station || '.' || location || '.' || channel || '_raw' AS nslct, network || '.' || station || '.' || location || '.' || substr(channel, 1, 2) || '_raw' AS nslit, network || '.' || station || '/' || network || '.' || station || '.' || location || '.' || substr(channel, 1, 2) || '_raw' AS path FROM tr""")
def trace_names(spark, sf):
    parts = [F.col(c) for c in ("network", "station", "location", "channel")]
    return traces(spark, sf).select("trace_id", names.nslct(*parts, F.lit("raw")).alias("nslct"), names.nslit(*parts, F.lit("raw")).alias("nslit"), names.stream_path(*parts, F.lit("raw")).alias("path"))


@query(""" SELECT station, (station * 7) % 360 AS azimuth, ((station * 7) % 360 > 315 OR (station * 7) % 360 < 45 OR ((station * 7) % 360 > 135 AND (station * 7) % 360 < 225)) AS north FROM st""")
def is_north(spark, sf):
    a = (F.col("station") * 7) % 360
    return stations(spark, sf).select("station", a.alias("azimuth"), names.is_north(a).alias("north"))


@query(""", u AS (SELECT station, ['gal', 'cm/s^2', 'in/s/s', 'g', 'g/10', 'mg', 'cm/s', 'furlong'][(station % 8 + 1)::INT] AS unit FROM st)
  SELECT station, unit, CASE unit WHEN 'gal' THEN 1 WHEN 'cm/s^2' THEN 1 WHEN 'in/s/s' THEN 2.54 WHEN 'g' THEN 980.665 WHEN 'g/10' THEN 98.0665 WHEN 'mg' THEN 0.00980665 WHEN 'cm/s' THEN 1 END::DOUBLE AS factor, CASE unit WHEN 'cm/s^2' THEN 'acc' WHEN 'cm/s' THEN 'vel' END AS kind FROM u""")
def unit_lookup(spark, sf):
    unit = F.get(F.array(*map(F.lit, ("gal", "cm/s^2", "in/s/s", "g", "g/10", "mg", "cm/s", "furlong"))), (F.col("station") % 8).cast("int"))
    return stations(spark, sf).select("station", unit.alias("unit")).select("station", "unit", names.to_cm(F.col("unit")).alias("factor"), names.units_type(F.col("unit")).alias("kind"))


@query(f""", g AS (SELECT unnest(range(0, 300)) AS k), d AS (SELECT k, 10 * pow(pow(40.0::DOUBLE, 1.0::DOUBLE / 299), k) AS r FROM g), a AS (SELECT event, max(r) FILTER (-3.5 + 0.9 * magnitude - 1.2 * ln(r + 10) - 0.002 * r >= {math.log(0.02)!r}::DOUBLE) AS km FROM qk, d GROUP BY event)
  SELECT qk.event, round(0 + 50 * magnitude, 6) AS search_s, round(coalesce(km, 10), 4) AS search_km FROM qk JOIN a ON qk.event = a.event""")
def search_parameters(spark, sf):
    d = catalogs.search_parameters(quakes(spark, sf), math.log(0.02), 400.0)
    return d.select("event", r6(F.col("search_s")).alias("search_s"), F.round("search_km", 4).alias("search_km"))


@query(""" SELECT event, greatest(depth, 0)::DOUBLE AS depth FROM qk""")
def shallow_catalog(spark, sf):
    return catalogs.shallow(quakes(spark, sf).withColumnRenamed("depth", "depth_km")).select("event", F.col("depth_km").alias("depth"))


@query(""", t AS (SELECT p_partkey AS trace, p_size % 10 AS station, ['HN1','HN2','HNN','HNE','HNZ','HHZ'][(p_partkey % 6 + 1)::INT] AS channel, 34 + (p_size % 7) * 0.003::DOUBLE AS lat, (p_partkey % 5) AS npts FROM part),
  k AS (SELECT *, substr(channel, 1, 2) AS inst, CASE substr(channel, 3, 1) WHEN '1' THEN 'N' WHEN 'N' THEN 'N' WHEN '2' THEN 'E' WHEN 'E' THEN 'E' ELSE 'Z' END AS way, floor((lat - 34) * 111.19492664455873 / 0.5)::BIGINT AS cell FROM t)
  SELECT station, inst, way, cell, count(*)::BIGINT AS n, min_by(trace, [-npts, trace]) AS kept FROM k GROUP BY ALL""")
def oriented_duplicates(spark, sf):
    """Duplicates by station, instrument and orientation class within cells of 500 m."""
    p = F.col("p_partkey")
    d = table(spark, sf, "part").select(p.alias("trace"), (F.col("p_size") % 10).alias("station"), F.get(F.array(*map(F.lit, ("HN1", "HN2", "HNN", "HNE", "HNZ", "HHZ"))), (p % 6).cast("int")).alias("channel"), (34 + (F.col("p_size") % 7) * 0.003).alias("lat"), (p % 5).alias("npts"))
    d = d.withColumn("inst", F.substring("channel", 1, 2)).withColumn("way", names.orientation_class(F.col("channel"))).withColumn("cell", F.floor((F.col("lat") - 34) * (math.pi * 6371.0 / 180) / 0.5))
    keys = ["station", "inst", "way", "cell"]
    n = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return r.dedup(d, keys, [F.desc("npts"), F.asc("trace")]).join(n, keys).select(*keys, "n", F.col("trace").alias("kept"))


@query(""", m AS (SELECT trace_id, record_id % 100 + 1 AS event, list_max(list_transform(x, lambda v: abs(v))) AS pga FROM tr) SELECT m.trace_id, m.event, round(magnitude, 6) AS magnitude, round(pga, 6) AS pga FROM m JOIN qk ON m.event = qk.event""")
def regression_rows(spark, sf):
    """Each metric row with its event's magnitude, as a regression needs them."""
    m = traces(spark, sf).select("trace_id", (F.col("record_id") % 100 + 1).alias("event"), r6(arrays.max_abs(F.col("x"))).alias("pga"))
    return m.join(quakes(spark, sf).select("event", r6(F.col("magnitude")).alias("magnitude")), "event").select("trace_id", "event", "magnitude", "pga")


@query(""", r AS (SELECT record_id, station, any_value(label) AS label, list(struct_pack(channel := channel, pga := round(list_max(list_transform(x, lambda v: abs(v))), 6)) ORDER BY channel) AS traces FROM tr GROUP BY record_id, station)
  SELECT record_id, station, len(traces)::INT AS n, list_aggregate(list_transform(traces, lambda t: t.channel), 'string_agg', ',') AS channels, list_max(list_transform(traces, lambda t: t.pga)) AS pga FROM r""")
def packet_contents(spark, sf):
    """The nested packet written as JSON and parsed with its schema again."""
    t = traces(spark, sf).select("record_id", "station", F.struct("channel", r6(arrays.max_abs(F.col("x"))).alias("pga")).alias("t"))
    d = t.groupBy("record_id", "station").agg(F.to_json(F.struct(F.sort_array(F.collect_list("t")).alias("traces"))).alias("packet"))
    p = d.withColumn("p", F.from_json("packet", "traces array<struct<channel:string,pga:double>>"))
    return p.select("record_id", "station", F.size("p.traces").alias("n"), F.array_join("p.traces.channel", ",").alias("channels"), F.array_max("p.traces.pga").alias("pga"))
