"""Records, stations and samples as DataFrames, from the tables at hand.

traces: one row a channel (network, station, location, channel, dt, samples). samples: one row a sample.
stations, events: a dimension with deterministic coordinates and magnitudes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHANNELS = ("HN1", "HN2", "HNZ")
DT = 0.01


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trace_id, record_id, network, station, location, channel, component, label, npts, x: three channels a record."""
    e = table(spark, sf_dir, "embeddings")
    k = F.pmod("vec_id", F.lit(3)).cast("int")
    record = F.floor(F.col("vec_id") / 3).cast("long")
    return e.select(
        F.col("vec_id").alias("trace_id"), record.alias("record_id"), F.lit("EM").alias("network"), F.format_string("S%05d", record).alias("station"), F.lit("--").alias("location"),
        F.get(F.array(*map(F.lit, CHANNELS)), k).alias("channel"), F.get(F.array(F.lit("H1"), F.lit("H2"), F.lit("Z")), k).alias("component"), "label",
        F.size("embedding").alias("npts"), F.transform("embedding", lambda v: v.cast("double")).alias("x"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """station, channel, event_id, ts, t (seconds), x: unevenly sampled series by user and event type."""
    e, ts = table(spark, sf_dir, "events"), F.col("ts").cast("timestamp")
    return e.select(F.col("user_id").alias("station"), F.col("event_type").alias("channel"), "event_id", ts.alias("ts"), (F.unix_micros(ts) / 1e6).alias("t"), F.col("value").alias("x"), "props")


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """station, lat, lon, magnitude, dist_km and instrument of each customer."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    return c.select(
        k.alias("station"), F.col("c_nationkey").alias("network"), (F.pmod(k * 37, F.lit(12000)) / 100.0 - 60).alias("lat"), (F.pmod(k * 91, F.lit(36000)) / 100.0 - 180).alias("lon"),
        (F.lit(3.0) + F.pmod(k * 13, F.lit(500)) / 100.0).alias("magnitude"), (F.lit(5.0) + F.pmod(k * 17, F.lit(2000)) / 10.0).alias("dist_km"),
        F.get(F.array(*map(F.lit, ("HN", "BN", "HH", "BH", "HL"))), F.pmod(k * 7, F.lit(5)).cast("int")).alias("instrument"), F.col("c_mktsegment").alias("structure"), F.col("c_acctbal").alias("quality"),
    )


def quakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event, time_s, lat, lon, depth, magnitude of each supplier: a catalog."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    return s.select(
        k.alias("event"), (k * 3600.0).alias("time_s"), (F.pmod(k * 113, F.lit(12000)) / 100.0 - 60).alias("lat"), (F.pmod(k * 211, F.lit(36000)) / 100.0 - 180).alias("lon"),
        (F.pmod(k * 29, F.lit(700)) / 10.0 - 1).alias("depth"), (F.lit(3.0) + F.pmod(k * 31, F.lit(500)) / 100.0).alias("magnitude"),
    )


#: The same adapters for the oracle.
SQL = """
tr AS (SELECT vec_id AS trace_id, vec_id // 3 AS record_id, 'EM' AS network, printf('S%05d', vec_id // 3) AS station, '--' AS location,
  ['HN1','HN2','HNZ'][(vec_id % 3 + 1)::INT] AS channel, ['H1','H2','Z'][(vec_id % 3 + 1)::INT] AS component, label, len(embedding) AS npts, embedding::DOUBLE[] AS x FROM embeddings),
sm AS (SELECT trace_id, record_id, station, channel, component, label, npts, generate_subscripts(x, 1) - 1 AS i, unnest(x) AS v FROM tr),
st AS (SELECT c_custkey AS station, c_nationkey AS network, (c_custkey * 37 % 12000) / 100.0::DOUBLE - 60 AS lat, (c_custkey * 91 % 36000) / 100.0::DOUBLE - 180 AS lon,
  3.0::DOUBLE + (c_custkey * 13 % 500) / 100.0::DOUBLE AS magnitude, 5.0::DOUBLE + (c_custkey * 17 % 2000) / 10.0::DOUBLE AS dist_km,
  ['HN','BN','HH','BH','HL'][(c_custkey * 7 % 5 + 1)::INT] AS instrument, c_mktsegment AS structure, c_acctbal AS quality FROM customer),
qk AS (SELECT s_suppkey AS event, s_suppkey * 3600.0::DOUBLE AS time_s, (s_suppkey * 113 % 12000) / 100.0::DOUBLE - 60 AS lat, (s_suppkey * 211 % 36000) / 100.0::DOUBLE - 180 AS lon,
  (s_suppkey * 29 % 700) / 10.0::DOUBLE - 1 AS depth, 3.0::DOUBLE + (s_suppkey * 31 % 500) / 100.0::DOUBLE AS magnitude FROM supplier)
"""
