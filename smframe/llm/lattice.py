"""Embedding near-dedup by lattice hashing in E8.

Each of several tables projects the unit vector at random onto eight dimensions, scales it, and decodes it to the
nearest point of the E8 lattice; a bucket is that point within a label. A vector probes the neighbouring points
nearest to it too. Vectors that meet, one at home and the other at home or probing, are verified by cosine in double
precision. The scale and the number of tables and probes are set so that pairs at the threshold are found with a
probability above 0.97; recall against brute force is measured in the tests.

Equal vectors of a label are one row with a multiplicity. Buckets of any size are cut into blocks that meet pairwise;
links are counted where a pair first meets (in the order of tables), so each counts once, and only counts and a
spanning forest leave a task.

Null, zero, or not finite vectors, vectors of differing dimension, and null labels link with nothing and are kept.
Rows of one vec_id each have their row. Other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from smframe.llm.common import components, discard, stored

#: The 240 shortest vectors of E8, where neighbouring lattice points lie: (+-1, +-1, 0...) and even sign changes of (1/2, ...).
ROOTS = np.array(
    [[a if k == i else b if k == j else 0 for k in range(8)] for i, j in combinations(range(8), 2) for a in (1, -1) for b in (1, -1)]
    + [[-0.5 if s >> k & 1 else 0.5 for k in range(8)] for s in range(256) if bin(s).count("1") % 2 == 0]
)


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row: the nearer of those of D8 and of D8 shifted by one half (Conway and Sloane)."""

    def d8(y: np.ndarray) -> np.ndarray:
        f = np.floor(y + 0.5)
        odd = np.flatnonzero(f.sum(1).astype(np.int64) & 1)
        off = y - f
        k = np.abs(off[odd]).argmax(1)
        f[odd, k] += np.where(off[odd, k] >= 0, 1, -1)
        return f

    a, b = d8(x), d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


class Tables:
    """Seeded projections of vectors of one dimension."""

    def __init__(self, dim: int, tables: int, probes: int, scale: float, seed: int = 11):
        r = np.random.default_rng([seed, dim])
        self.maps = [np.linalg.qr(r.normal(size=(dim, 8)))[0] * np.sqrt(dim / 8) * scale if dim >= 8 else r.normal(size=(dim, 8)) * scale / np.sqrt(8) for _ in range(tables)]
        self.probes = probes

    def codes(self, v: np.ndarray) -> np.ndarray:
        """(rows, tables, 1 + probes): the bucket at home, then the neighbouring ones by distance."""
        out = np.empty((len(v), len(self.maps), 1 + self.probes), np.int64)
        weights = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(8)], np.uint64)
        salt = [np.uint64((t + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1) for t in range(len(self.maps))]
        for t, m in enumerate(self.maps):
            x = v @ m
            home = decode(x)
            gap = x - home
            near = np.argsort(-(gap @ ROOTS.T), axis=1, kind="stable")[:, : self.probes]  # all roots are equally long
            points = np.concatenate((home[:, None, :], home[:, None, :] + ROOTS[near]), axis=1)
            p = (points * 2).astype(np.int64).astype(np.uint64)
            h = (p * weights).sum(-1, dtype=np.uint64) + salt[t]
            out[:, t] = (h ^ (h >> np.uint64(29))).view(np.int64)
        return out


def units(rows: list) -> np.ndarray:
    v = np.array(rows, np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, tables: int = 8, probes: int = 6, scale: float = 4.5, block: int = 1024) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, embedding, label)."""
    e = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), e.alias("e"))
    ok = F.col("e").isNotNull() & F.col("label").isNotNull() & F.forall("e", finite) & F.exists("e", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(ok & F.col("vec_id").isNotNull(), F.lit(False)))
    rows = stored(rows.withColumn("h", F.when(F.col("ok"), F.sha2(F.concat_ws("/", "label", F.array_join(F.transform("e", lambda x: (x + 0.0).cast("string")), ",")).cast("binary"), 256))))
    first = stored(rows.where("ok").groupBy("h").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("mult")))
    distinct = rows.where("ok").join(first, "h").where("vec_id = id").dropDuplicates(["h"]).select("id", "mult", "label", F.size("e").alias("dim"), "e")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Tables] = {}
        for b in batches:
            dims = b.column("dim").to_pylist()
            vs = b.column("e").to_pylist()
            out: list = [None] * len(dims)
            for d in {*dims}:
                t = known.setdefault(d, Tables(d, tables, probes, scale))
                at = [i for i, x in enumerate(dims) if x == d]
                for i, c in zip(at, t.codes(units([vs[i] for i in at])).reshape(len(at), -1)):
                    out[i] = c
            if dims:
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "mult", "label", "dim", "e")), pa.array(out, pa.list_(pa.int64()))], ["id", "mult", "label", "dim", "e", "codes"])

    coded = stored(distinct.mapInArrow(hashed, "id long, mult long, label string, dim int, e array<double>, codes array<long>"))
    width = 1 + probes
    seat = coded.select("id", F.posexplode("codes").alias("at", "code"), "label", "dim").withColumn("at_table", F.floor(F.col("at") / width).cast("int")).select("id", F.xxhash64("label", "dim", "at_table", "code").alias("bucket"), F.expr(f"at % {width} = 0").alias("home"), "at_table", "code")
    full = stored(seat.groupBy("bucket").agg(F.count_if("home").alias("homes"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n")).where("homes > 0 and lo < hi").select("bucket", "homes", "n"))
    at = seat.join(full, "bucket")
    # a bucket's rows are dealt to blocks by id; every pair of blocks with a home row on one side meets
    at = at.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64(F.lit("block"), "id"), F.col("blocks").cast("long")).cast("int"))
    at = at.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    at = at.select("id", "at_table", "code", F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("g"), (F.col("own") <= F.col("other")).alias("left"), (F.col("own") == F.col("other")).alias("same"))
    at = at.join(coded.select("id", "mult", "e", "codes"), "id").repartition("g").sortWithinPartitions("g", "id")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        group = None

        def flush() -> pa.RecordBatch | None:
            if len(held) < 2:
                return None
            got = counted([h[3:] for h in held], held[0][1], held[0][2], cosine, tables, width)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*got)], ["id", "links", "to"]) if got else None

        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("g", "code", "at_table", "id", "left", "same", "mult", "e", "codes"))):
                if r[0] != group:
                    if (x := flush()) is not None:
                        yield x
                    held, group = [], r[0]
                held.append(r)
        if (x := flush()) is not None:
            yield x

    met = stored(at.mapInArrow(verify, "id long, links long, to long"))
    links = met.where("links > 0").groupBy("id").agg(F.sum("links").alias("links"))
    found = components(met.where("to is not null").select(F.col("id").alias("a"), F.col("to").alias("b")))
    info = stored(first.join(links, "id", "left").join(found, "id", "left").select("h", F.col("mult"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "id").alias("component")))
    discard(first, coded, full, met, found)
    out = rows.select("vec_id", "h").join(info, "h", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce(F.col("mult") - 1 + F.col("links"), F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def counted(held: list[tuple], code: int, table: int, cosine: float, tables: int, width: int) -> list[tuple]:
    """(id, links, None) for what each id gains here, and (id, 0, other) for a spanning forest of the links here.

    held: (id, left, same, mult, e, codes), an id once. A pair counts in the first table in which it meets, there in
    the bucket at home of the lesser id if the other reaches it, else in that of the greater id.
    """
    ids, left, same, mult = (np.array([h[k] for h in held]) for k in range(4))
    v, codes = units([h[4] for h in held]), np.array([h[5] for h in held]).reshape(len(held), tables, width)
    ok = np.tril(v @ v.T >= cosine, -1)
    if not same.all():
        ok &= left[:, None] != left[None, :]
    gained, forest, root = np.zeros(len(ids), np.int64), [], list(range(len(ids)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    every, each = np.nonzero(ok)
    for k in range(0, len(every), 50_000):
        i, j = every[k : k + 50_000], each[k : k + 50_000]  # ids[i] > ids[j]
        p, q = codes[i], codes[j]
        low, high = (p == q[:, :, :1]).any(2), (q == p[:, :, :1]).any(2)
        here = (low | high).argmax(1) == table
        n = np.arange(len(i))
        here &= np.where(low[n, table], q[n, table, 0], p[n, table, 0]) == code
        i, j = i[here], j[here]
        np.add.at(gained, i, mult[j])
        np.add.at(gained, j, mult[i])
        for a, b in zip(i.tolist(), j.tolist()):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
                forest.append((int(ids[a]), 0, int(ids[b])))
    return [(int(ids[k]), int(gained[k]), None) for k in np.flatnonzero(gained)] + forest
