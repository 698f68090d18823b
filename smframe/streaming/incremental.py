"""The same gates and metrics over files that keep arriving: Structured Streaming over Parquet traces.

Each micro-batch measures its traces; station counts within event-time windows are kept with a watermark, so state
is bounded by the windows still open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from smframe.functions import arrays


def peaks(spark: SparkSession, path: str, schema, per_trigger: int = 100) -> DataFrame:
    """A stream of traces with their peaks, from Parquet files under path; needs columns x and ts."""
    d = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
    return d.withColumn("pga", arrays.max_abs(F.col("x"))).drop("x")


def triggers(peaks: DataFrame, threshold: float, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Stations and largest peak above threshold in each window, once the watermark closes it."""
    d = peaks.withWatermark("ts", late).where(F.col("pga") >= threshold)
    return d.groupBy(F.window("ts", window), "network").agg(F.approx_count_distinct("station").alias("stations"), F.max("pga").alias("pga"))


def append(df: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes the stream as Parquet, exactly once; once: what there is now, then stops."""
    writer = df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
