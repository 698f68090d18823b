"""Queries over source spectra and onsets."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from smframe.functions import physics as p
from smframe.operators import source, windows
from smframe.plans.relational_queries import r6
from smframe.sources.adapters import SQL, stations, traces

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

KAPPA = 0.035
_C = p.PARTITION * p.HORIZONTAL * p.SURFACE / (4 * math.pi * p.DENSITY * p.BETA**3) * 1e-20
_F0 = 4.906e6 * p.BETA
_CRUST = "exp(CASE " + f"WHEN f <= {p.CRUST_HZ[0]} THEN {math.log(p.CRUST_GAIN[0])!r} " + " ".join(
    f"WHEN f <= {b} THEN {math.log(g)!r} + (f - {a}) * {(math.log(h) - math.log(g)) / (b - a)!r}" for a, b, g, h in zip(p.CRUST_HZ, p.CRUST_HZ[1:], p.CRUST_GAIN, p.CRUST_GAIN[1:])) + f" ELSE {math.log(p.CRUST_GAIN[-1])!r} END)"


def spectra(spark, sf):
    """A spectrum of 25 frequencies about the corner for each station: the model at a stress drop of its own, times noise."""
    s = stations(spark, sf).withColumn("stress", 5.0 + F.pmod(F.col("station") * 23, F.lit(400)))
    s = s.withColumn("m0", p.moment(F.col("magnitude"))).withColumn("f0", p.brune_f0(F.col("m0"), 1.0) * F.pow("stress", F.lit(1 / 3)))
    s = s.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(24)))).withColumn("f", F.col("f0") * F.pow(F.lit(2.0), (F.col("k") - 12) / 4))
    level = F.lit(_C) * F.col("m0") * F.pow(2 * math.pi * F.col("f"), F.lit(2.0)) / (1 + F.pow(F.col("f") / F.col("f0"), F.lit(2.0)))
    spec = level * p.spreading(F.col("dist_km")) * p.anelastic(F.col("f"), F.col("dist_km")) * p.site(F.col("f"), KAPPA)
    return s.withColumn("spec", spec * F.exp(0.2 * F.sin(F.col("station") * 1.7 + F.col("k") * 2.3))).groupBy("station", "magnitude", "dist_km", "f0").agg(F.sort_array(F.collect_list(F.struct("f", "spec"))).alias("v"))


def fit_spectra(spark, sf):
    d = spectra(spark, sf).select("station", F.col("magnitude"), "dist_km", F.col("v.f").alias("snr_freq"), F.col("v.spec").alias("signal_spectrum"), (F.col("f0") / 6).alias("highpass"), (F.col("f0") * 7).alias("lowpass"))
    d = source.fit_spectra(d, KAPPA).select("station", "fit_spectra.*")
    return d.select("station", r6(F.log("moment")).alias("ln_moment"), r6(F.log("stress_drop")).alias("ln_stress"), r6("moment_lnsd").alias("moment_lnsd"), r6("stress_drop_lnsd").alias("stress_lnsd"), r6("magnitude").alias("magnitude"), r6(F.log("f0")).alias("ln_f0"), r6("R2").alias("r2"), "minimize_success")


QUERIES["fit_spectra"] = fit_spectra
# Gauss-Newton with steps of at most one, each round one aggregation over the frequencies that count
ORACLE["fit_spectra"] = "WITH RECURSIVE " + SQL + f""",
  a AS (SELECT station, magnitude, dist_km, 5.0::DOUBLE + station * 23 % 400 AS stress, pow(10.0::DOUBLE, 1.5 * magnitude + 16.05) AS m0 FROM st),
  b AS (SELECT *, {_F0!r}::DOUBLE * pow(1.0::DOUBLE / m0, 1.0::DOUBLE / 3) * pow(stress, 1.0::DOUBLE / 3) AS f0, unnest(range(25)) AS k FROM a),
  c AS (SELECT *, f0 * pow(2.0::DOUBLE, (k - 12) / 4.0::DOUBLE) AS f FROM b),
  g AS (SELECT *, CASE WHEN dist_km <= 40 THEN 1 / dist_km ELSE 1 / sqrt(dist_km * 40) END * exp(-pi() * f * dist_km / (180 * pow(f, 0.45::DOUBLE)) / 3.5::DOUBLE) * {_CRUST} * exp(-pi() * {KAPPA} * f) * {_C!r}::DOUBLE * pow(2 * pi() * f, 2) AS green FROM c),
  s AS (SELECT *, green * m0 / (1 + pow(f / f0, 2)) * exp(0.2::DOUBLE * sin(station * 1.7::DOUBLE + k * 2.3::DOUBLE)) AS spec FROM g),
  used AS (SELECT station, f, ln(spec / green) AS y FROM s WHERE f >= f0 / 6 AND f <= f0 * 7),
  w AS (SELECT station, 0 AS i, ln(m0) AS m, 0.5::DOUBLE * ln(0.1::DOUBLE * 10000) AS t FROM a
    UNION ALL SELECT station, i + 1, m + greatest(-1.0, least(1.0, (c * u - b * v) / (a * c - b * b))), t + greatest(-1.0, least(1.0, (a * v - b * u) / (a * c - b * b))) FROM (
      SELECT station, any_value(i) AS i, any_value(m) AS m, any_value(t) AS t, sum((1 - h) * (1 - h)) AS a, sum((1 - h) * h) AS b, sum(h * h) AS c, sum((1 - h) * r) AS u, sum(h * r) AS v FROM (
        SELECT station, i, m, t, y - m + ln(1 + q) AS r, 2 * q / (1 + q) / 3 AS h FROM (SELECT w.station, i, m, t, y, pow(f / ({_F0!r}::DOUBLE * exp((t - m) / 3)), 2) AS q FROM w JOIN used USING (station) WHERE i < 40)) GROUP BY station)),
  e AS (SELECT station, m, t, {_F0!r}::DOUBLE * exp((t - m) / 3) AS fc FROM w WHERE i = 40),
  n AS (SELECT station, sum((1 - h) * (1 - h)) AS a, sum((1 - h) * h) AS b, sum(h * h) AS c, sum(r * r) / (count(*) - 2) AS s2 FROM (
    SELECT station, y - m + ln(1 + pow(f / fc, 2)) AS r, 2 * pow(f / fc, 2) / (1 + pow(f / fc, 2)) / 3 AS h FROM e JOIN used USING (station)) GROUP BY station),
  o AS (SELECT station, 1 - sum(pow(spec - green * exp(m) / (1 + pow(f / fc, 2)), 2)) / (any_value(var) * count(*)) AS r2 FROM (SELECT *, var_pop(spec) OVER (PARTITION BY station) AS var FROM s) JOIN e USING (station) GROUP BY station)
  SELECT station, round(m, 6) AS ln_moment, round(t, 6) AS ln_stress, round(sqrt(s2 * c / (a * c - b * b)), 6) AS moment_lnsd, round(sqrt(s2 * a / (a * c - b * b)), 6) AS stress_lnsd,
    round(2.0::DOUBLE / 3 * (m / ln(10.0::DOUBLE) - 16.05::DOUBLE), 6) AS magnitude, round(ln(fc), 6) AS ln_f0, round(r2, 6) AS r2, true AS minimize_success
  FROM e JOIN n USING (station) JOIN o USING (station)"""


PLANTED = 25.6


def long_records(spark, sf):
    """Each trace's samples, 40 times over at a fiftieth of their size and then 40 times as they are: an onset after 25.6 s."""
    tiles = lambda share: F.flatten(F.array_repeat(F.transform("x", lambda v: v * share), 40))
    return traces(spark, sf).select("record_id", "channel", F.lit(100.0).alias("sampling_rate"), F.lit(None).cast("double").alias("arrival"), F.concat(tiles(0.02), tiles(1.0)).alias("x"))


def onset_picks(spark, sf):
    """Of each record, whether each picker is within a quarter of a second of the planted onset; ar needs all three channels."""
    out = None
    for method in ("ar", "baer", "power"):
        d = windows.signal_split(long_records(spark, sf), ["record_id"], [method]).groupBy("record_id").agg(F.min("split").alias(method))
        out = d if out is None else out.join(d, "record_id")
    near = lambda c: (F.abs(F.col(c) - PLANTED) <= 0.25).alias(c)
    return out.select("record_id", *map(near, ("ar", "baer", "power")))


QUERIES["onset_picks"] = onset_picks
ORACLE["onset_picks"] = "WITH " + SQL + "SELECT record_id, count(*) = 3 AS ar, true AS baer, true AS power FROM tr GROUP BY record_id"
