"""Session defaults and the one way this library cuts lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build(app: str = "smframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, AQE and Arrow set; everything else is left to the cluster."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    fixed = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (fixed | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder named by spark.checkpoint.dir; where that is unset, in a temporary one if all runs on this machine, as in tests."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(where or tempfile.mkdtemp(prefix="smframe-checkpoint-"))
    return df.checkpoint(eager=True)
