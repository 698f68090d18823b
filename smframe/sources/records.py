"""Text record files read as DataFrames, whatever their format (smframe.sources.formats).

A file is one row (Spark's whole-text source); which format it has is a column, and header fields and samples are
taken by JVM expressions in one scan, whatever the number of formats. Files of no or of several formats have no trace and
are reported by unreadable(). Every format gives the columns of TRACE, after path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from smframe.sources.formats import MARKS, READERS, TRACE


def sniffed(texts: DataFrame) -> DataFrame:
    """path, text, lines and formats (the formats that match) of rows of path and text; a null text has no format."""
    d = texts.select("path", F.regexp_replace("text", "\r\n?", "\n").alias("text"))
    hit = F.array(*(F.when(F.col("text").rlike(m), F.lit(k)) for k, m in MARKS.items()))
    return d.withColumn("lines", F.split("text", "\n")).withColumn("formats", F.filter(hit, lambda k: k.isNotNull()))


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, text, lines and formats of each file under path."""
    return sniffed(spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def unreadable(found: DataFrame) -> DataFrame:
    """path and reason of the files that no reader, or more than one, takes."""
    n = F.size("formats")
    return found.where(n != 1).select("path", F.when(n == 0, "no format matches").otherwise("several formats match").alias("reason"))


def parse(found: DataFrame, formats: list[str] | None = None) -> DataFrame:
    """The traces of rows of sniffed() that have one format, or of those among them whose format is in formats."""
    kinds = formats or list(READERS)
    own = F.get("formats", F.lit(0))
    traces = F.coalesce(*(F.when(own == k, READERS[k](F.col("text"), F.col("lines"))) for k in kinds))
    return found.where((F.size("formats") == 1) & own.isin(kinds)).select("path", F.inline(traces)).select("path", *TRACE)


def read(spark: SparkSession, path: str, formats: list[str] | None = None) -> DataFrame:
    """The traces of all files under path whose format is known (and among formats)."""
    return parse(files(spark, path), formats)


def write(traces: DataFrame, path: str, by: list[str]) -> None:
    """Parquet partitioned by event or label; partitions that traces don't hold stay as they are."""
    traces.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*by).parquet(path)
