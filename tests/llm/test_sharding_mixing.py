"""Sharding keeps its law and moves little; Poisson counts follow their rates."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from smframe.llm import mixing, sharding


@pytest.mark.parametrize("n", [0, 5, 333])
def test_counts_are_one_apart_and_slots_gapless(spark, n):
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 3).alias("text"), F.lit(1).alias("shard"))
    got = sharding.shard(docs).collect()
    assert len(got) == n
    by = Counter(r["shard"] for r in got)
    assert not n or max(by.values()) - min(by.get(s, 0) for s in range(16)) <= 1
    for s in by:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(by[s]))


def test_nulls_and_repeats(spark):
    rows = [(None, None), (None, None), (1, ""), (1, "é")]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=3).collect()
    assert sorted(r["size"] for r in got) == [1, 1, 1, 3] and {r["law"] for r in got} == {"rows"}


def test_another_shard_moves_few_rows():
    counts = {c: 1 for c in range(0, 65536, 8)}
    owner = lambda s: {g[0]: g[3] for g in sharding.deal(counts, sharding.ring(s, 64), [len(counts) // s + 1] * s)}
    a, b = owner(16), owner(17)
    assert sum(a[c] != b[c] for c in counts) < 0.12 * len(counts)  # a plain remainder moves 94 %


def test_every_row_is_dealt_once():
    counts = {3: 1000, 40000: 1, 65535: 500}
    got = sharding.deal(counts, sharding.ring(4, 8), [376, 375, 375, 375])
    assert sum(hi - lo for _, lo, hi, _, _ in got) == 1501
    assert Counter({s: sum(hi - lo for _, lo, hi, t, _ in got if t == s) for s in range(4)}) == Counter({0: 376, 1: 375, 2: 375, 3: 375})


def test_mix_follows_weights(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.when(F.col("id") % 3 > 0, "a").otherwise(F.lit(None)).alias("source"), F.lit(9).alias("copies"))
    w = spark.createDataFrame([("a", 1.0), (None, 1.0)], "source string, weight double")
    got = mixing.mix(docs, w).groupBy("source").count().collect()
    by = {r["source"]: r["count"] for r in got}
    assert abs(by["a"] - 3000) < 250 and abs(by[None] - 3000) < 250
    one = mixing.mix(docs, w).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copies").alias("c"), F.max("copy").alias("m"))
    assert one.where("n <> c or m <> c - 1").count() == 0
    assert mixing.mix(docs.limit(0)).count() == 0


def test_large_rates_and_unlisted_sources(spark):
    docs = spark.createDataFrame([(1, "x", "rare"), (1, "x", "rare")] + [(i, "x", "b") for i in range(2000)], "doc_id long, text string, source string")
    w = spark.createDataFrame([("rare", 1.0)], "source string, weight double")
    got = mixing.mix(docs, w).collect()
    assert {r["source"] for r in got} == {"rare"} and abs(len(got) - 2002) < 400 and len(got) % 2 == 0


def test_callers_columns_keep_their_values(spark):
    docs = spark.range(50).selectExpr("id as doc_id", "'x' as text", "'s' as source", "5 as _order", "6 as _copies", "7 as _row", "8 as _id", "9 as `a.b`", "10 as _cdf")
    got = mixing.mix(docs).collect()
    assert len(got) > 20 and {tuple(r)[3:9] for r in got} == {(5, 6, 7, 8, 9, 10)}
    assert got[0].__fields__ == [*docs.columns, "copy", "copies"]


def test_rates_around_the_window(spark):
    """Counts of large rates have the mean and the deviation of the law."""
    for rate in (150.0, 400.0, 90_000.0):
        n = 300
        docs = spark.range(n).selectExpr("id as doc_id", "'s' as source")
        r = mixing.rates(docs, None, 0.5, rate)
        c = [x[0] for x in docs.crossJoin(r).select((F.col("_low") + F.size(F.filter("_cdf", lambda c: c < mixing.uniform(17, F.col("doc_id"))))).alias("n")).collect()]
        mean = sum(c) / n
        assert abs(mean - rate) < 4 * (rate / n) ** 0.5 and 0.75 * rate < sum((x - mean) ** 2 for x in c) / n < 1.3 * rate
