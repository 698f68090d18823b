"""Event catalogs as DataFrames: JSON and GeoJSON files, event text files, CSV catalogs; and how far and long to search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "id string, time timestamp, latitude double, longitude double, depth_km double, magnitude double, magnitude_type string"


def event_files(spark: SparkSession, path: str) -> DataFrame:
    """The events of JSON files, a document each: plain ones, or GeoJSON features with times in milliseconds."""
    doc = F.col("value")
    get = lambda *paths: F.coalesce(*(F.get_json_object(doc, p) for p in paths))
    time = F.coalesce(F.timestamp_millis(F.get_json_object(doc, "$.properties.time").try_cast("long")), F.get_json_object(doc, "$.time").try_cast("timestamp"))
    return spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(
        F.get_json_object(doc, "$.id").alias("id"), time.alias("time"), get("$.latitude", "$.geometry.coordinates[1]").try_cast("double").alias("latitude"), get("$.longitude", "$.geometry.coordinates[0]").try_cast("double").alias("longitude"),
        get("$.depth_km", "$.geometry.coordinates[2]").try_cast("double").alias("depth_km"), get("$.magnitude", "$.properties.mag").try_cast("double").alias("magnitude"), get("$.magnitude_type", "$.properties.magType").alias("magnitude_type"),
    )


def event_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines of id, time, latitude, longitude, depth, magnitude, magnitude type; or of ids alone, whose other columns are null.

    Times are ISO, or day/month/year with hours and minutes. `bad` holds lines of another number of fields.
    """
    f = F.split("value", r"\s*,\s*")
    at = lambda i: F.trim(F.get(f, F.lit(i)))
    n = F.size(f)
    iso = at(1).try_cast("timestamp")
    local = F.try_to_timestamp(at(1), F.lit("d/M/yy H:mm"))
    full = n >= 6
    number = lambda i: F.when(full, at(i).try_cast("double"))
    d = spark.read.text(path).where(F.trim("value") != "")
    return d.select(at(0).alias("id"), F.when(full, F.coalesce(iso, local)).alias("time"), number(2).alias("latitude"), number(3).alias("longitude"), number(4).alias("depth_km"), number(5).alias("magnitude"), F.when(n == 7, at(6)).alias("magnitude_type"), F.when(~n.isin(1, 6, 7), F.col("value")).alias("bad"))


def csv_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A catalog with a header (time, latitude, longitude, depth, mag, magType, id); depths above the ground count as 0."""
    d = spark.read.option("header", "true").csv(path)
    return shallow(d.select("id", F.col("time").try_cast("timestamp").alias("time"), F.col("latitude").cast("double"), F.col("longitude").cast("double"), F.col("depth").cast("double").alias("depth_km"), F.col("mag").cast("double").alias("magnitude"), F.col("magType").alias("magnitude_type")))


def shallow(catalog: DataFrame) -> DataFrame:
    return catalog.withColumn("depth_km", F.greatest(F.col("depth_km"), F.lit(0.0)))


#: Ground-motion models by name: (magnitude, distance in km) to the natural log of peak acceleration in g. Users add their own.
MODELS: dict[str, Callable[[Column, Column], Column]] = {}


def model(name: str):
    """Registers a ground-motion model."""

    def add(f: Callable[[Column, Column], Column]):
        if name in MODELS:
            raise ValueError(f"model {name} exists already")
        MODELS[name] = f
        return f

    return add


@model("plain_decay")
def plain_decay(magnitude: Column, km: Column) -> Column:
    """A plain form for tests and as a conservative default: ln a = -3.5 + 0.9 M - 1.2 ln(r + 10) - 0.002 r."""
    return -3.5 + 0.9 * magnitude - 1.2 * F.ln(km + 10) - 0.002 * km


def search_parameters(events: DataFrame, threshold: float, most_km: float, name: str = "plain_decay", c0: float = 0.0, c1: float = 50.0, regions: dict[str, tuple[float, float]] | None = None, points: int = 300) -> DataFrame:
    """events with search_s = c0 + c1 M (other coefficients for the given regions, by column region) and search_km.

    search_km: the largest of `points` distances, evenly spaced in the logarithm from 10 km to most_km, at which the model
    reaches threshold (ln g); 10 km if none does. The grid is an array within the row: no join.
    """
    m, step = F.col("magnitude"), (most_km / 10.0) ** (1 / (points - 1))
    duration = F.lit(float(c0)) + c1 * m
    for k, (a, b) in (regions or {}).items():
        duration = F.when(F.col("region") == k, F.lit(float(a)) + b * m).otherwise(duration)
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: 10.0 * F.pow(F.lit(step), k))
    reached = F.array_max(F.filter(grid, lambda r: MODELS[name](m, r) >= threshold))
    return events.withColumn("search_s", duration).withColumn("search_km", F.coalesce(reached, F.lit(10.0)))
