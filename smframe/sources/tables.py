"""Flat tables as files: number formats by column name, CSV with appending, and the README tables beside them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Formats of columns whose name begins with a match, whatever its case; the format of other numbers; missing values.
FORMATS = {
    "samplingrate": "%.0f",
    ".*magnitude$|.*vs30": "%.1f",
    ".*depth|.*elevation|.*dist|GC2.*|backazimuth": "%.2f",
    ".*latitude|.*longitude|.*highpass|.*lowpass|fmin|fmax|f0": "%.5f",
}
OTHER, MISSING = "%.8E", "nan"


def format_of(column: str) -> str:
    """The last of the formats whose pattern matches the start of the name."""
    return next((f for p, f in reversed(FORMATS.items()) if re.match(p, column, re.IGNORECASE)), OTHER)


def formatted(df: DataFrame) -> DataFrame:
    """df with floating-point columns as text in their format; null and NaN as `nan`."""

    def one(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            return F.when(c.isNull() | F.isnan(c), MISSING).otherwise(F.format_string(format_of(name), c.cast("double"))).alias(name)
        return F.coalesce(c.cast("string"), F.lit(MISSING)).alias(name)

    return df.select(*(one(n, k) for n, k in df.dtypes))


def natural_order(names: list[str], first: list[str]) -> list[str]:
    """first, then the other names by the numbers within them: SA(2) before SA(10)."""
    key = lambda s: [(0, float(p), "") if re.fullmatch(r"\d+(\.\d+)?", p) else (1, 0.0, p) for p in re.split(r"(\d+(?:\.\d+)?)", s) if p]
    return [n for n in first if n in names] + sorted((n for n in names if n not in first), key=key)


def write_csv(df: DataFrame, path: str, append: bool = True) -> None:
    """Adds df's formatted rows to the table at path, or replaces it; every part file has a header."""
    formatted(df).write.mode("append" if append else "overwrite").option("header", "true").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", "true").option("nanValue", MISSING).option("nullValue", "").schema(schema).csv(path)


def readme(spark: SparkSession, described: dict[str, str]) -> DataFrame:
    """The table of column headers and what they mean."""
    return spark.createDataFrame([*described.items()], "`Column header` string, Description string")


def metric_table(long: DataFrame, keys: list[str], metric: str, value: str, names: list[str]) -> DataFrame:
    """One wide row for keys from a row for each metric; names are given, so no pass is needed to find them."""
    wide = long.groupBy(*keys).pivot(metric, names).agg(F.first(value, ignorenulls=True))
    return wide.select(*keys, *(F.col(f"`{n}`") for n in natural_order(names, [])))
