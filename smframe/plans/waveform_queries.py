"""Queries over traces, each with the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from smframe.functions import arrays
from smframe.operators import clipping as clip
from smframe.operators import waveform as w
from smframe.sources.adapters import DT, SQL, traces

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
WITH = "WITH RECURSIVE " + SQL
PI = "pi()"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = WITH + sql
        return f

    return add


def r6(c, scale: float = 1.0):
    return F.round(c * scale, 6) + F.lit(0.0)


def exploded(df, column: str, name: str, scale: float = 1.0):
    return df.select("trace_id", F.posexplode(column).alias("i", "_v")).select("trace_id", "i", r6(F.col("_v"), scale).alias(name))


@query(""" SELECT trace_id, channel, round(list_max(list_transform(x, lambda v: abs(v))), 6) AS pga,
  (list_position(list_transform(x, lambda v: abs(v)), list_max(list_transform(x, lambda v: abs(v)))) - 1)::INT AS at FROM tr""")
def pga_channels(spark, sf):
    return traces(spark, sf).select("trace_id", "channel", r6(arrays.max_abs(F.col("x"))).alias("pga"), arrays.argmax_abs(F.col("x")).alias("at"))


@query(""", z AS (SELECT trace_id, v * lead(v) OVER (PARTITION BY trace_id ORDER BY i) AS p FROM sm)
  SELECT trace_id, sum((p < 0)::INT)::INT AS crossings, round(sum((p < 0)::INT) / 0.64, 6) AS rate, sum((p < 0)::INT) / 0.64 <= 40.0 AS failed FROM z GROUP BY trace_id""")
def zero_crossing_rate(spark, sf):
    d = traces(spark, sf).select("trace_id", arrays.zero_crossings(F.col("x")).alias("crossings"), (F.col("npts") * F.lit(DT)).alias("s"))
    return d.select("trace_id", "crossings", r6(F.col("crossings") / F.col("s")).alias("rate"), (F.col("crossings") / F.col("s") <= 40.0).alias("failed"))


@query(" SELECT trace_id, i::INT AS i, round(v - avg(v) OVER (PARTITION BY trace_id), 6) + 0.0 AS y FROM sm")
def demean(spark, sf):
    return exploded(traces(spark, sf).withColumn("y", arrays.demean(F.col("x"))), "y", "y")


@query(""", c AS (SELECT trace_id, regr_slope(v, i) AS s, regr_intercept(v, i) AS a FROM sm GROUP BY trace_id)
  SELECT trace_id, i::INT AS i, round(v - a - s * i, 6) + 0.0 AS y FROM sm JOIN c USING (trace_id)""")
def detrend_linear(spark, sf):
    return exploded(traces(spark, sf).withColumn("y", arrays.detrend_linear(F.col("x"))), "y", "y")


@query(""", c AS (SELECT trace_id, arg_min(v, i) AS a, arg_max(v, i) AS b FROM sm GROUP BY trace_id)
  SELECT trace_id, i::INT AS i, round(v - a - (b - a) * i / 63.0::DOUBLE, 6) + 0.0 AS y FROM sm JOIN c USING (trace_id)""")
def detrend_simple(spark, sf):
    return exploded(traces(spark, sf).withColumn("y", arrays.detrend_simple(F.col("x"))), "y", "y")


@query(""", c AS (SELECT trace_id, avg(v) AS m FROM sm WHERE i <= 15 GROUP BY trace_id)
  SELECT trace_id, i::INT AS i, round(v - m, 6) + 0.0 AS y FROM sm JOIN c USING (trace_id)""")
def detrend_pre(spark, sf):
    return exploded(traces(spark, sf).withColumn("y", arrays.demean_before(F.col("x"), F.lit(15))), "y", "y")


@query(f""" SELECT trace_id, i::INT AS i, round(v * CASE WHEN i < 3 THEN 0.5 * (1 - cos({PI} * i / 3)) WHEN 63 - i < 3 THEN 0.5 * (1 - cos({PI} * (63 - i) / 3)) ELSE 1 END, 6) + 0.0 AS y FROM sm""")
def taper_hann(spark, sf):
    return exploded(traces(spark, sf).withColumn("y", arrays.taper_hann(F.col("x"))), "y", "y")


@query(""" SELECT trace_id, i::INT AS i, round(v, 6) + 0.0 AS y FROM sm WHERE i BETWEEN 10 AND 49""")
def cut(spark, sf):
    return exploded(traces(spark, sf).withColumn("y", F.slice("x", 11, 40)), "y", "_y").withColumn("i", F.col("i") + 10).withColumnRenamed("_y", "y")


@query(""", p AS (SELECT trace_id, list_concat(list_concat(list_transform(range(0, 8), lambda k: 0.0::DOUBLE), x), list_transform(range(0, 8), lambda k: 0.0::DOUBLE)) AS y, x FROM tr)
  SELECT trace_id, len(y)::INT AS padded, len(x)::INT AS stripped, round(list_sum(y[9:72]), 6) + 0.0 AS total FROM p""")
def zero_pad(spark, sf):
    d = traces(spark, sf).withColumn("y", arrays.zero_pad(F.col("x"), F.lit(8))).withColumn("z", arrays.strip_pad(F.col("y"), F.lit(8)))
    return d.select("trace_id", F.size("y").alias("padded"), F.size("z").alias("stripped"), r6(arrays.total(F.col("z"))).alias("total"))


@query(""", d AS (SELECT trace_id, i, (v + lag(v) OVER (PARTITION BY trace_id ORDER BY i)) * 0.005 AS a FROM sm)
  SELECT trace_id, i::INT AS i, round(1e3 * coalesce(sum(a) OVER (PARTITION BY trace_id ORDER BY i), 0), 6) + 0.0 AS y FROM d""")
def integrate_time(spark, sf):
    return exploded(w.integrated(traces(spark, sf).select("trace_id", "x"), DT, frequency=False), "velocity", "y", 1e3)


@query(""", g AS (SELECT trace_id, i, v, lag(v) OVER w AS a, lead(v) OVER w AS b FROM sm WINDOW w AS (PARTITION BY trace_id ORDER BY i))
  SELECT trace_id, i::INT AS i, round(CASE WHEN a IS NULL THEN (b - v) / 0.01 WHEN b IS NULL THEN (v - a) / 0.01 ELSE (b - a) / 0.02 END, 6) + 0.0 AS y FROM g""")
def differentiate_time(spark, sf):
    return exploded(traces(spark, sf).withColumn("y", arrays.gradient(F.col("x"), DT)), "y", "y")


DFT = f""", k AS (SELECT unnest(range(0, 33)) AS k), f AS (SELECT trace_id, k, sum(v * cos(2 * {PI} * k * i / 64)) AS re, -sum(v * sin(2 * {PI} * k * i / 64)) AS im FROM sm, k GROUP BY trace_id, k)"""


def inverse(re: str, im: str) -> str:
    """The inverse transform of a spectrum without mean, given its real and imaginary parts in SQL."""
    return f"""{DFT}, h AS (SELECT trace_id, k, {re} AS hr, {im} AS hi, CASE WHEN k = 32 THEN 1 ELSE 2 END AS m FROM f WHERE k > 0),
      o AS (SELECT unnest(range(0, 64)) AS i), y AS (SELECT trace_id, i, sum(m * (hr * cos(2 * {PI} * k * i / 64) - CASE WHEN k = 32 THEN 0 ELSE hi END * sin(2 * {PI} * k * i / 64))) / 64 AS y FROM h, o GROUP BY trace_id, i)"""


@query(inverse(f"im / (2 * {PI} * k / 0.64)", f"-re / (2 * {PI} * k / 0.64)") + """, z AS (SELECT trace_id, i, y - first_value(y) OVER (PARTITION BY trace_id ORDER BY i) AS y FROM y)
  SELECT trace_id, round(1e3 * max(abs(y)), 6) AS pgv FROM z GROUP BY trace_id""")
def pgv_fft(spark, sf):
    return w.integrated(traces(spark, sf).select("trace_id", "x"), DT).select("trace_id", r6(arrays.max_abs(F.col("velocity")), 1e3).alias("pgv"))


@query(inverse(f"-im * (2 * {PI} * k / 0.64)", f"re * (2 * {PI} * k / 0.64)") + " SELECT trace_id, i::INT AS i, round(y, 4) + 0.0 AS y FROM y")
def differentiate_fft(spark, sf):
    d = w.differentiated(traces(spark, sf).select("trace_id", "x"), DT).select("trace_id", F.posexplode("derivative").alias("i", "v"))
    return d.select("trace_id", "i", (F.round("v", 4) + F.lit(0.0)).alias("y"))


@query(inverse("re / (sqrt(1 + pow(5.0 / (k / 0.64), 10)) * sqrt(1 + pow((k / 0.64) / 20.0, 10)))", "im / (sqrt(1 + pow(5.0 / (k / 0.64), 10)) * sqrt(1 + pow((k / 0.64) / 20.0, 10)))") + " SELECT trace_id, i::INT AS i, round(y, 6) + 0.0 AS y FROM y")
def bandpass_butterworth(spark, sf):
    return exploded(w.filtered(traces(spark, sf).select("trace_id", "x"), DT, 5.0, 20.0), "filtered", "y")


@query(DFT + """, a AS (SELECT record_id, k, sqrt(avg((re * re + im * im) * 0.0001)) AS s, count(*) AS n FROM f JOIN tr USING (trace_id) GROUP BY record_id, k)
  SELECT record_id, k::INT AS k, n::BIGINT AS n, round(1e3 * s, 6) AS fas FROM a""")
def fas_quadratic_mean(spark, sf):
    s = w.spectra(traces(spark, sf).select("record_id", "x"), DT).select("record_id", F.posexplode("spec").alias("k", "s"))
    return s.groupBy("record_id", "k").agg(F.count(F.lit(1)).alias("n"), r6(F.sqrt(F.avg(F.col("s") * F.col("s"))), 1e3).alias("fas"))


CENTRES = [2.0, 5.0, 10.0, 20.0, 49.0]


@query(DFT + """, c AS (SELECT unnest([2.0, 5.0, 10.0, 20.0, 49.0]::DOUBLE[]) AS fc), s AS (SELECT trace_id, k / 0.64 AS f, sqrt(re * re + im * im) * 0.01 AS s FROM f WHERE k > 0),
  q AS (SELECT trace_id, fc, s, 20.0 * log10(f / fc) AS q FROM s, c), wt AS (SELECT trace_id, fc, s, CASE WHEN abs(q) < 1e-12 THEN 1 WHEN abs(q) > 3 THEN 0 ELSE pow(sin(q) / q, 4) END AS w FROM q)
  SELECT trace_id, fc, round(1e3 * sum(w * s) / sum(w), 6) AS smooth FROM wt GROUP BY trace_id, fc HAVING sum(w) > 0""")
def konno_ohmachi(spark, sf):
    s = w.smoothed(w.spectra(traces(spark, sf).select("trace_id", "x"), DT), DT, CENTRES, 20.0)
    fc = F.get(F.array(*map(F.lit, CENTRES)), F.col("_k"))
    return s.select("trace_id", F.posexplode("smooth").alias("_k", "_s")).where(~F.isnan("_s")).select("trace_id", fc.alias("fc"), r6(F.col("_s"), 1e3).alias("smooth"))


PERIODS = [0.1, 0.2, 0.5]


def _oscillator_sql() -> str:
    parts = []
    for p in PERIODS:
        a11, a12, a21, a22, b11, b12, b21, b22 = (repr(v) + "::DOUBLE" for v in w.oscillator_step(p, 0.05, DT))
        om = 2 * 3.141592653589793 / p
        parts.append(f"""SELECT trace_id, {p}::DOUBLE AS period, list_reduce(list_prepend(struct_pack(d := 0.0::DOUBLE, v := 0.0::DOUBLE, sd := 0.0::DOUBLE, sv := 0.0::DOUBLE, sa := 0.0::DOUBLE, a := 0.0::DOUBLE, b := 0.0::DOUBLE),
          list_transform(range(1, 64), lambda i: struct_pack(d := 0.0::DOUBLE, v := 0.0::DOUBLE, sd := 0.0::DOUBLE, sv := 0.0::DOUBLE, sa := 0.0::DOUBLE, a := x[i], b := x[i + 1]))),
          lambda s, t: struct_pack(d := {a11} * s.d + {a12} * s.v + {b11} * t.a + {b12} * t.b, v := {a21} * s.d + {a22} * s.v + {b21} * t.a + {b22} * t.b,
            sd := greatest(s.sd, abs({a11} * s.d + {a12} * s.v + {b11} * t.a + {b12} * t.b)), sv := greatest(s.sv, abs({a21} * s.d + {a22} * s.v + {b21} * t.a + {b22} * t.b)),
            sa := greatest(s.sa, abs({0.1 * om!r} * ({a21} * s.d + {a22} * s.v + {b21} * t.a + {b22} * t.b) + {om * om!r} * ({a11} * s.d + {a12} * s.v + {b11} * t.a + {b12} * t.b))), a := 0.0::DOUBLE, b := 0.0::DOUBLE)) AS r FROM tr""")
    return f""", osc AS ({" UNION ALL ".join(parts)})
      SELECT trace_id, period, round(1e6 * r.sd, 4) AS sd, round(1e3 * r.sv, 6) AS sv, round(r.sa / 9.80665, 6) AS sa, round(1e3 * 2 * {PI} / period * r.sd, 6) AS psv, round(pow(2 * {PI} / period, 2) * r.sd / 9.80665, 6) AS psa FROM osc"""


@query(_oscillator_sql())
def response_spectra(spark, sf):
    r = w.response_spectra(traces(spark, sf), PERIODS, 0.05, DT, ["trace_id"])
    return r.select("trace_id", "period", F.round(F.col("sd") * 1e6, 4).alias("sd"), r6(F.col("sv"), 1e3).alias("sv"), r6(F.col("sa")).alias("sa"), r6(F.col("psv"), 1e3).alias("psv"), r6(F.col("psa")).alias("psa"))


PAIRS = """, hp AS (SELECT a.record_id, a.x AS x1, b.x AS x2 FROM tr a JOIN tr b ON a.record_id = b.record_id AND a.component = 'H1' AND b.component = 'H2')"""


@query(PAIRS + f""", t AS (SELECT unnest(range(0, 181)) AS t), p AS (SELECT record_id, t, list_max(list_transform(range(1, 65), lambda i: abs(x1[i] * cos(t * {PI} / 180) + x2[i] * sin(t * {PI} / 180)))) AS p FROM hp, t)
  SELECT record_id, round(quantile_cont(p, 0.5), 6) AS rotd50, round(max(p), 6) AS rotd100, round(min(p), 6) AS rotd0 FROM p GROUP BY record_id""")
def rotd_pga(spark, sf):
    r = w.rotd(w.horizontal_pairs(traces(spark, sf), ["record_id"]), ["record_id"], [50.0, 100.0, 0.0], ["rotd50", "rotd100", "rotd0"])
    return r.select("record_id", *(r6(F.col(c)).alias(c) for c in ("rotd50", "rotd100", "rotd0")))


@query(""", p AS (SELECT record_id, component, list_max(list_transform(x, lambda v: abs(v))) AS pga FROM tr)
  SELECT record_id, count(*)::BIGINT AS n, round(avg(pga), 6) AS arithmetic, round(exp(avg(ln(pga))), 6) AS geometric, round(sqrt(avg(pga * pga)), 6) AS quadratic FROM p GROUP BY record_id""")
def component_means(spark, sf):
    p = traces(spark, sf).select("record_id", arrays.max_abs(F.col("x")).alias("p"))
    return p.groupBy("record_id").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("p")).alias("arithmetic"), r6(F.exp(F.avg(F.ln("p")))).alias("geometric"), r6(F.sqrt(F.avg(F.col("p") * F.col("p")))).alias("quadratic"))


RUN = """, sq AS (SELECT trace_id, i, v * v AS s, abs(v) AS a FROM sm), rn AS (SELECT trace_id, i, (s + lag(s) OVER w) * 0.005 AS ds, (a + lag(a) OVER w) * 0.005 AS da FROM sq WINDOW w AS (PARTITION BY trace_id ORDER BY i))"""


@query(RUN + f" SELECT trace_id, round(1e9 * sum(ds) * 0.0001 * {PI} / 9.80665 / 2, 4) AS arias, round(1e6 * sum(da) * 0.01 / 9.80665, 4) AS cav FROM rn GROUP BY trace_id")
def arias_cav(spark, sf):
    x = F.col("x")
    return traces(spark, sf).select("trace_id", F.round(w.arias(x, DT) * 1e9, 4).alias("arias"), F.round(w.cav(x, DT) * 1e6, 4).alias("cav"))


@query(RUN + """, cm AS (SELECT trace_id, i, coalesce(sum(ds) OVER (PARTITION BY trace_id ORDER BY i), 0) AS c FROM rn), nm AS (SELECT trace_id, i, c / max(c) OVER (PARTITION BY trace_id) AS h FROM cm),
  rk AS (SELECT trace_id, i, row_number() OVER (PARTITION BY trace_id ORDER BY abs(h - 0.05), i) AS a, row_number() OVER (PARTITION BY trace_id ORDER BY abs(h - 0.95), i) AS b, row_number() OVER (PARTITION BY trace_id ORDER BY abs(h - 0.75), i) AS c FROM nm)
  SELECT trace_id, round((max(i) FILTER (b = 1) - max(i) FILTER (a = 1)) * 0.01::DOUBLE, 6) AS d5_95, round((max(i) FILTER (c = 1) - max(i) FILTER (a = 1)) * 0.01::DOUBLE, 6) AS d5_75 FROM rk GROUP BY trace_id""")
def significant_duration(spark, sf):
    d = w.durations(traces(spark, sf).select("trace_id", "x"), [(0.05, 0.95), (0.05, 0.75)], ["d5_95", "d5_75"], DT)
    return d.select("trace_id", r6(F.col("d5_95")).alias("d5_95"), r6(F.col("d5_75")).alias("d5_75"))


@query(""", pk AS (SELECT trace_id, max(abs(v)) AS m FROM sm GROUP BY trace_id), qt AS (SELECT sm.trace_id, i FROM sm JOIN pk ON sm.trace_id = pk.trace_id AND abs(v) < 0.05 * m),
  gp AS (SELECT trace_id, i, i - lag(i) OVER (PARTITION BY trace_id ORDER BY i) AS g FROM qt), ct AS (SELECT trace_id, max(i) FILTER (g > 1) AS e FROM gp GROUP BY trace_id),
  y AS (SELECT sm.trace_id, i, v FROM sm LEFT JOIN ct USING (trace_id) WHERE i < coalesce(e, 64)),
  e0 AS (SELECT trace_id, max(v) AS hi, min(v) AS lo, avg(v) AS m, max(i) + 1 AS n FROM y GROUP BY trace_id), ex AS (SELECT *, greatest(hi - m, m - lo) AS pk FROM e0),
  wd AS (SELECT trace_id, i, v, v - lag(v) OVER o AS d, stddev_pop(v) OVER (o ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS s, lag(v) OVER o AS a, lead(v) OVER o AS b FROM y WINDOW o AS (PARTITION BY trace_id ORDER BY i)),
  g1 AS (SELECT trace_id, i, CASE WHEN a IS NULL THEN (b - v) / 0.01 WHEN b IS NULL THEN (v - a) / 0.01 ELSE (b - a) / 0.02 END AS g FROM wd),
  g2 AS (SELECT trace_id, i, g, lag(g) OVER o AS a, lead(g) OVER o AS b FROM g1 WINDOW o AS (PARTITION BY trace_id ORDER BY i)),
  jk AS (SELECT trace_id, abs(CASE WHEN a IS NULL THEN (b - g) / 0.01 WHEN b IS NULL THEN (g - a) / 0.01 ELSE (b - a) / 0.02 END) AS j FROM g2),
  jm AS (SELECT trace_id, median(j) AS m FROM jk GROUP BY trace_id), jn AS (SELECT jk.trace_id, sum((j >= 100 * m)::INT)::INT AS n_jerk FROM jk JOIN jm USING (trace_id) GROUP BY jk.trace_id),
  cn AS (SELECT wd.trace_id, sum((abs(v - m) > 6e6)::INT) > 0 AS clip_max, sum((abs(d) > 0.57 * (abs(hi) - lo))::INT)::INT AS n_ping,
    sum((((v - m) / pk >= 0.85 * (hi - m) / pk OR (v - m) / pk <= 0.85 * (lo - m) / pk) AND (i >= n - 12 OR s / pk < 0.001))::INT)::INT AS n_std FROM wd JOIN ex USING (trace_id) GROUP BY wd.trace_id)
  SELECT trace_id, clip_max, coalesce(n_ping, 0)::INT AS n_ping, coalesce(n_ping, 0) > 0 AS clip_ping, n_std, n_std > 5 AS clip_std, n_jerk, n_jerk > 400 AS clip_jerk FROM cn JOIN jn USING (trace_id)""")
def clipping(spark, sf):
    return clip.detectors(traces(spark, sf), ["trace_id"], DT).drop("n_hist", "clip_hist")


@query(""" SELECT trace_id, round(10 * log10((list_sum(list_transform(x, lambda v: v * v)) / 64) / (list_sum(list_transform(x[1:16], lambda v: v * v)) / 16)), 6) AS snr_db FROM tr""")
def pick_snr(spark, sf):
    x = F.col("x")
    return traces(spark, sf).select("trace_id", r6(arrays.decibels(x, F.slice(x, 1, 16))).alias("snr_db"))


@query(PAIRS + f""", pg AS (SELECT record_id, component, list_max(list_transform(x, lambda v: abs(v))) AS pga FROM tr),
  t AS (SELECT unnest(range(0, 181)) AS t), p AS (SELECT record_id, list_max(list_transform(range(1, 65), lambda i: abs(x1[i] * cos(t * {PI} / 180) + x2[i] * sin(t * {PI} / 180)))) AS p FROM hp, t),
  rd AS (SELECT record_id, quantile_cont(p, 0.5) AS rotd50 FROM p GROUP BY record_id)
  SELECT record_id, round(max(pga) FILTER (component = 'H1'), 6) AS h1, round(max(pga) FILTER (component = 'H2'), 6) AS h2, round(max(pga) FILTER (component = 'Z'), 6) AS z, round(exp(avg(ln(pga))), 6) AS geometric, round(any_value(rotd50), 6) AS rotd50
  FROM pg LEFT JOIN rd USING (record_id) GROUP BY record_id""")
def record_metrics_wide(spark, sf):
    t = traces(spark, sf)
    p = t.select("record_id", "component", arrays.max_abs(F.col("x")).alias("p"))
    wide = p.groupBy("record_id").agg(*(r6(F.max(F.when(F.col("component") == c.upper(), F.col("p")))).alias(c) for c in ("h1", "h2", "z")), r6(F.exp(F.avg(F.ln("p")))).alias("geometric"))
    rot = w.rotd(w.horizontal_pairs(t, ["record_id"]), ["record_id"], [50.0], ["rotd50"])
    return wide.join(rot.select("record_id", r6(F.col("rotd50")).alias("rotd50")), "record_id", "left")
