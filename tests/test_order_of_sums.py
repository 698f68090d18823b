"""Means decide at ties: what is added in the order of event_id gives the same rows as SQL, however rows are dealt over files."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from smframe.plans import catalogue


def added(x):
    total = 0.0
    for v in x:
        total += v
    return total


def values(seed, n, wanted, most=50_000):
    """n values of two decimals, whose sums in order and in reverse are as wanted."""
    r = random.Random(seed)
    while True:
        x = [r.randrange(1, most) / 100 for _ in range(n)]
        if wanted(added(x), added(x[::-1])):
            return x


def answers(spark, folder, name, rows):
    """Rows of the query over a table in order, and over one in reverse; and those of its SQL over the one in order."""
    got = []
    for k, ordered in enumerate((rows, rows[::-1])):
        d = spark.createDataFrame([(i, u, t, v) for i, u, t, v in ordered], "event_id long, user_id long, event_type string, value double").coalesce(1)
        d.select("event_id", F.timestamp_seconds("event_id").alias("ts"), "user_id", "event_type", "value", F.lit("{}").alias("props")).write.parquet(f"{folder}/{k}/events.parquet")
        q = catalogue.QUERIES[name](spark, f"{folder}/{k}")
        got.append(sorted(q.select(sorted(q.columns)).collect()))
    c = duckdb.connect(config={"threads": 1})
    for t in ("embeddings", "customer", "supplier"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    c.execute(f"CREATE TABLE events AS SELECT * FROM '{folder}/0/events.parquet/*.parquet' ORDER BY event_id")
    want = c.execute(catalogue.ORACLE[name])
    order = [d[0] for d in want.description]
    return *got, sorted(tuple(r[order.index(k)] for k in sorted(order)) for r in want.fetchall())


def test_picks_hang_on_no_order_of_rows(spark, tmp_path):
    """A mean at a tie of the sixth decimal: added in reverse, it falls on the other side."""
    rows = []
    for u in range(4):
        x = values(u, 32, lambda a, b: round(a * 100) % 2 and a != b and abs(round(a / 32, 6) - round(b / 32, 6)) > 5e-7)
        rows += [(1000 * u + i, 3 * u, "click", v) for i, v in enumerate(x)]
    one, two, sql = answers(spark, tmp_path, "pick_combine", sorted(rows))
    assert [tuple(r) for r in one] == [tuple(r) for r in two] == sql


def test_combined_picks(spark):
    """Of three pickers and one without a pick; of equal ratios the earliest; none at all."""
    from smframe.operators import relational as r

    d = spark.createDataFrame([(1, 4.0, 2.0), (1, 1.0, 3.0), (1, 2.0, 3.0), (1, None, 9.0), (1, float("nan"), 9.0), (2, None, 1.0), (3, 5.0, None), (4, 1.0, 1.0), (4, 2.0, 1.5)], "k int, pick double, snr double")
    got = {x["k"]: tuple(x)[1:] for x in r.pick_combine(d, ["k"], ("median", "mean", "max_snr")).collect()}
    assert got == {1: (2.0, pytest.approx(7 / 3), 1.0, 3), 2: (None, None, None, 0), 3: (5.0, 5.0, None, 1), 4: (1.5, 1.5, 2.0, 2)}
    for m in ("median", "mean", "max_snr"):
        assert {x["k"]: x["n"] for x in r.pick_combine(d, ["k"], m).collect()} == {1: 3, 2: 0, 3: 1, 4: 2}


def test_corners_hang_on_no_order_of_rows(spark, tmp_path):
    """The first frequency's ratio is 1 exactly, so the band begins at the next; added in reverse it is more than 1, or less."""
    rows = []
    for u in range(4):
        x, n = [], 24
        while not x:
            part = values(100 * u + n, 11, lambda a, b: True, 4_000)
            rest = round(20 * 12 - sum(part), 2)
            if rest > 0 and added([*part, rest]) == 240 and added([rest, *part[::-1]]) > 240:
                x = [*part, rest]
            n += 1
        rows += [(24 * (1000 * u + i), u, "click", v) for i, v in enumerate(x)]
        rows += [(24 * (1000 * u + 100) + k, u, "click", 50.0) for k in range(1, 20)]
    one, two, sql = answers(spark, tmp_path, "snr_corners_of_records", sorted(rows))
    assert [tuple(r) for r in one] == [tuple(r) for r in two] == sql
    assert {r["low"] for r in one} == {0.13}
