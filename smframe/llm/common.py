"""What several operators share: scratch tables, labelled tables, and distributed union-find."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset, a temporary one if all runs on this machine, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="smframe-"))
    return sc.getCheckpointDir()


def packed(df: DataFrame) -> Column:
    """A whole row of df as one value: no name that an operator gives meets a caller's."""
    return F.struct(*(F.col(quoted(c)) for c in df.columns))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def stored(df: DataFrame) -> DataFrame:
    """df written once as Parquet in the shared folder and read again: lineage is cut, and later scans prune its columns."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more: all that was made of them has been stored in turn."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored_in_turns(parts: list[DataFrame]) -> DataFrame:
    """The union of parts as one stored table; the shuffle files of one are gone before the next is made."""
    spark = parts[0].sparkSession
    path = f"{scratch_dir(spark)}/stored-{uuid.uuid4().hex}"
    for part in parts:
        part.write.mode("append").parquet(path)
        swept(spark)
    out = spark.read.schema(parts[0].schema).parquet(path)
    out.stored_at = path
    return out


def swept(spark: SparkSession) -> None:
    """Has the driver's JVM look for what nothing refers to: Spark then deletes the shuffle files of jobs that are done, which else stay until the driver's heap fills."""
    spark._jvm.System.gc()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every id of edges (a, b): component is the smallest id that links reach.

    Randomised contraction: each round maps every vertex to the neighbour (or itself) of least seeded hash (at first
    of least id, which folds stars at once), takes that step twice, and replaces both ends of each edge, which removes
    a constant share of the vertices in expectation. Nothing but "are edges left" reaches the driver. Each map is written
    once, so a hot vertex meets its map in a join that Spark can split.
    """
    maps, first = [], stored(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct())
    e = first
    for turn in range(max_rounds):
        if e.isEmpty():
            break
        both = e.union(e.select("b", "a"))
        ranked = lambda c: F.struct((F.col(c) if turn == 0 else F.xxhash64(F.lit(turn), c)).alias("k"), F.col(c).alias("v"))
        step = stored(both.groupBy("a").agg(F.min(ranked("b")).alias("n")).select("a", F.least(ranked("a"), F.col("n"))["v"].alias("to")))
        m = stored(step.join(step.select(F.col("a").alias("to"), F.col("to").alias("_next")), "to").select("a", F.col("_next").alias("to")))
        discard(step)
        maps.append(m)
        used, e = e, stored(
            e.join(m.withColumnRenamed("to", "x"), "a").select("x", "b")
            .join(m.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
            .where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        )
        if used is not first:
            discard(used)
    else:
        raise RuntimeError("contraction did not end")
    at = first.select(F.col("a").alias("id")).union(first.select("b")).distinct().select("id", F.col("id").alias("root"))
    for m in maps:
        at = at.join(m.select(F.col("a").alias("root"), "to"), "root", "left").select("id", F.coalesce("to", "root").alias("root"))
    at = stored(at)
    least = stored(at.groupBy("root").agg(F.min("id").alias("component")))
    out = stored(at.join(least, "root").select("id", "component"))
    discard(*({first, e}), at, least, *maps)
    return out
