"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate: its target share of the output over its share of the rows. A row's count
inverts the Poisson distribution of that rate at a uniform number hashed from seed and doc_id, so a rerun or a
lost executor gives the same counts. Rows are exploded by their count and shuffled globally by a hash of seed,
doc_id and copy. DataFrame functions only; the rates are one row for each source, written before they are joined, so Spark
broadcasts them only where their size allows.

Null sources form a source of their own. A null doc_id hashes as the text 'null'. Rows with equal doc_id have
equal counts. An empty table gives no rows. Extra columns are carried along, whatever
their names, but for columns copy and copies, whose place the counts take.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from smframe.llm.common import packed, stored


def uniform(seed: int, *key: Column) -> Column:
    """A number inside (0, 1) from 52 bits of a digest."""
    text = F.concat_ws("/", F.lit(str(seed)), *(F.coalesce(k.cast("string"), F.lit("null")) for k in key))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def poisson_cdf(rate: Column) -> tuple[Column, Column]:
    """(low, cdf): P(count <= k) for k from low up to ten deviations and twenty beyond the mean.

    low lies as far below the mean, where what is left out is less than the least uniform number; the first term takes
    Stirling's series, which is exact to double precision there. Terms are in logarithms, so large rates hold.
    """
    low = F.greatest(F.lit(0), F.floor(rate - 10 * F.sqrt(rate) - 20)).cast("int")
    top = F.ceil(rate + 10 * F.sqrt(rate) + 20).cast("int")
    k = low.cast("double")
    ln_factorial = F.when(low == 0, F.lit(0.0)).otherwise(k * F.ln(k) - k + 0.5 * F.ln(2 * math.pi * k) + 1 / (12 * k) - 1 / (360 * F.pow(k, F.lit(3.0))) + 1 / (1260 * F.pow(k, F.lit(5.0))))
    first = F.when(low == 0, -rate).otherwise(k * F.ln(rate) - rate - ln_factorial)
    start = F.struct(F.array(F.exp(first)).alias("c"), first.alias("lp"), F.exp(first).alias("s"))

    def step(a: Column, k: Column) -> Column:
        lp = a["lp"] + F.ln(rate) - F.ln(k.cast("double"))
        s = a["s"] + F.exp(lp)
        return F.struct(F.concat(a["c"], F.array(s)).alias("c"), lp.alias("lp"), s.alias("s"))

    return low, F.when(rate <= 0, F.array(F.lit(1.0))).otherwise(F.aggregate(F.sequence(low + 1, top), start, step, lambda a: a["c"]))


def rates(docs: DataFrame, weights: DataFrame | None = None, temperature: float = 0.5, size_factor: float = 1.0) -> DataFrame:
    """_source, _rate, _low, _cdf of each source: expected output rows by weight over its rows.

    weights: (source, weight), normalised here; without it a source weighs its rows to the power `temperature`.
    The expected output has size_factor times the rows of the input.
    """
    n = docs.groupBy(F.col("source").alias("_source")).agg(F.count(F.lit(1)).alias("_n"))
    if weights is None:
        n = n.withColumn("_w", F.pow(F.col("_n").cast("double"), F.lit(temperature)))
    else:
        w = weights.select(F.col("source").alias("_s"), F.col("weight").cast("double").alias("_w"))
        n = n.join(w, F.col("_source").eqNullSafe(F.col("_s")), "left").select("_source", "_n", F.coalesce("_w", F.lit(0.0)).alias("_w"))
    n = stored(n)
    total = n.agg(F.sum("_n").alias("n"), F.sum("_w").alias("w")).first()  # two numbers
    scale = size_factor * (total["n"] or 0) / (total["w"] or 1.0)
    n = n.withColumn("_rate", F.lit(scale) * F.col("_w") / F.col("_n"))
    low, cdf = poisson_cdf(F.col("_rate"))
    return stored(n.select("_source", "_rate", low.alias("_low"), cdf.alias("_cdf")))


def mix(docs: DataFrame, weights: DataFrame | None = None, seed: int = 17, temperature: float = 0.5, size_factor: float = 1.0) -> DataFrame:
    """Every row of docs as often as its count, in a random order, with `copy` (from 0) and `copies` added."""
    r = rates(docs, weights, temperature, size_factor)
    d = docs.select(packed(docs).alias("_row"), F.col("source").alias("_s"), F.col("doc_id").alias("_id"))
    dealt = d.join(r, F.col("_s").eqNullSafe(F.col("_source")), "left")
    dealt = dealt.select("_row", "_id", (F.col("_low") + F.size(F.filter("_cdf", lambda c: c < uniform(seed, F.col("_id"))))).alias("_copies"))
    out = dealt.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    out = out.withColumn("_order", F.xxhash64(F.lit(seed), F.col("_id").cast("string"), "_copy"))
    out = out.repartition("_order").sortWithinPartitions("_order")
    keep = (F.col("_row").getField(c).alias(c) for c in docs.columns if c.lower() not in ("copy", "copies"))
    return out.select(*keep, F.col("_copy").cast("int").alias("copy"), F.col("_copies").cast("int").alias("copies"))
