"""N-gram Jaccard join by PartEnum signatures.

A document's set holds the hashes of its distinct word shingles. Sizes fall into classes. Two sets whose Jaccard
similarity reaches the threshold differ in at most k elements, where k follows from the class of the smaller one.
The hash domain is cut into k + 1 + m cells, so that m + 1 cells at least agree wholly; the content of a cell, tagged
with the class, is a signature (PartEnum with one partition out of each group chosen). A set with at most m empty
cells needs no signature of an empty cell, as one of the agreeing cells then holds something; other sets emit those
too. A set emits signatures for its own class and for those that a smaller partner may be in.

Equal sets are one, by their digest. Pairs that share a signature are verified exactly on whole sets, as module links says.

Null and empty texts have an empty set and are linked with nothing. Fewer words than a shingle's give the whole
sequence as one. Rows of one doc_id are one document with the links of all its texts, each reported with its own size; doc_ids
are below 2 ** 62. A null doc_id is reported with its own size and no links.
Other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from smframe.llm.common import components, discard, stored, stored_in_turns, swept
from smframe.llm.links import links, possible, regions

U = np.uint64
FULL = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers (finaliser of Stafford's variant 13)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(text: str, n: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the word n-grams; A-Z lower-cased, words between ASCII white space."""
    from xxhash import xxh3_64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, U)
    h = np.fromiter(map(xxh3_64_intdigest, words), U, len(words))
    if len(h) < n:
        return mix(np.array([xxh3_64_intdigest(b" ".join(words), seed=1)], U))
    s = np.full(len(h) - n + 1, U(n))
    for j in range(n):
        s = mix(s * U(0x9E3779B97F4A7C15) + h[j : len(h) - n + 1 + j])
    s.sort()
    return s[np.concatenate(([True], s[1:] != s[:-1]))]


@lru_cache(maxsize=None)
def size_class(n: int, ratio: float = 1.25) -> tuple[int, int, int]:
    """(class, least size, largest size) of a set of n >= 1 elements; widths grow by ratio."""
    c, lo = 0, 1
    while True:
        hi = max(lo, int(lo * ratio + 1e-9) - (lo * ratio == int(lo * ratio)))
        if n <= hi:
            return c, lo, hi
        c, lo = c + 1, hi + 1


def spare(k: int) -> int:
    """How many cells there are beyond k + 1: as many empty cells a set may have and leave out."""
    return k // 20 + 2


def signatures(s: np.ndarray, percent: int) -> np.ndarray:
    """The signatures of a sorted set, as signed numbers."""
    n, out = len(s), []
    if not n:
        return np.zeros(0, np.int64)
    sums = np.concatenate((np.zeros(1, U), np.cumsum(mix(s + U(0x632BE59BD9B4E019)))))
    c, lo, hi = size_class(n)
    while True:
        k = hi * (100 - percent) // percent
        m = spare(k)
        cells = k + 1 + m
        at = np.append(np.searchsorted(s, np.array([(FULL + 1) * i // cells for i in range(cells)], U)), n)
        full = at[1:] > at[:-1]
        if cells - np.count_nonzero(full) > m:
            full[:] = True
        out.append(mix(sums[at[1:]] - sums[at[:-1]] + U(0xA24BAED4963EE407) * np.arange(1, cells + 1, dtype=U) + U(0x8CB92BA72F3D8DD7 * (c + 1) & FULL))[full])
        if lo == 1 or (lo - 1) * 100 < percent * n:  # no set of the class below can be similar enough
            break
        c, lo, hi = size_class(lo - 1)
    return np.concatenate(out).view(np.int64)


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a sorted set, as two signed numbers."""
    if not len(s):
        return 0, 0
    a, b = mix(s).sum(dtype=U), (mix(s + U(1)) * (s | U(1))).sum(dtype=U)
    return int(np.int64(a.astype(np.int64))), int(np.int64(b.astype(np.int64)))


def sets(docs: DataFrame, words: int, percent: int, remembered: int = 200_000) -> DataFrame:
    """id, x (a hash of the text), n, d1, d2, region counts and signatures of every row; a task gives the signatures of equal sets once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in batches:
            t, ids, n, d, counts, sig = b.column("text"), b.column("id"), [], [], [], []
            for i in range(b.num_rows):
                s = shingles(t[i].as_py() or "", words)
                n.append(len(s)), d.append(digest(s)), counts.append(regions(s))
                new = d[-1] not in seen and ids[i].is_valid
                sig.append(signatures(s, percent) if new else np.zeros(0, np.int64))
                if new:
                    if len(seen) >= remembered:
                        seen.clear()
                    seen.add(d[-1])
            if n:
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sig)]), pa.int32()), pa.array(np.concatenate(sig)))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("x"), pa.array(n, pa.int64()), *(pa.array(v, pa.int64()) for v in zip(*d)), pa.array(counts, pa.binary()), lists], ["id", "x", "n", "d1", "d2", "counts", "sig"])

    return with_text(docs).mapInArrow(run, "id long, x long, n long, d1 long, d2 long, counts binary, sig array<long>")


def with_text(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("x"), text.alias("text"))


def further(t: DataFrame) -> DataFrame:
    """(id, x, own) of the texts of an id but for the one of least hash: own is an id for that text alone, beyond all doc_ids in use."""
    first = t.where("n > 0 and id is not null").groupBy("id").agg(F.min("x").alias("first"), F.max("x").alias("last")).where("first < last")
    rest = t.where("n > 0").join(first, "id").where("x <> first").select("id", "x").distinct()
    return stored(rest.select("id", "x", (F.pmod(F.xxhash64(F.lit("text"), "id", "x"), F.lit(1 << 61)) + F.lit(1 << 62)).alias("own")))


def named_apart(t: DataFrame, other: DataFrame) -> DataFrame:
    """t with the further texts of an id under ids of their own."""
    return t.join(other, ["id", "x"], "left").withColumn("id", F.coalesce("own", "id")).select(t.columns)


def join(docs: DataFrame, words: int = 3, percent: int = 90, block: int = 1024, most: int = 256, turns: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    words: a shingle's length; percent: the least 100 * intersection / union; block: rows that a signature's other rows
    pass in one group; most: partners of one document that are verified in one group, on average; turns: parts of the
    signatures that meet one after another, as their shuffle files would outgrow all else on disk.
    """
    raw = stored(sets(docs, words, percent))
    slim = raw.select("id", "n")
    other = further(raw)
    t = named_apart(raw, other)
    one = t.where("n > 0 and id is not null").groupBy("id").agg(F.min(F.struct("x", "n", "d1", "d2")).alias("v")).select("id", "v.*")
    rep = one.groupBy("d1", "d2", "n").agg(F.min("id").alias("rep"))
    rep = stored(rep)  # so that a set with very many copies can be split in the join
    named = stored(one.join(rep, ["d1", "d2", "n"]).select("id", "x", "n", "rep"))
    slim = stored(slim)
    # a task gives a set's signatures under any one id that has it, so an id stands for the sets of all its rows
    to = stored(t.where("n > 0 and id is not null").select("id", "n", "d1", "d2").join(rep, ["d1", "d2", "n"]).select("id", "rep").distinct())
    w = Window.partitionBy("s")

    def seated(turn: int) -> DataFrame:
        seats = t.select("id", F.explode("sig").alias("s")).where(F.pmod("s", F.lit(turns)) == turn)
        seats = seats.repartition("s").select("s", "id", F.min("id").over(w).alias("lead"), F.max("id").over(w).alias("hi"))
        seats = seats.where("lead < hi").select("s", "id", "lead").join(to, "id").select("s", "lead", F.col("rep").alias("a"))
        return seats.join(to.withColumnRenamed("id", "lead"), "lead").select("s", "a", F.col("rep").alias("b")).distinct()

    seats = stored_in_turns([seated(k) for k in range(turns)])
    kept = stored(raw.drop("sig"))
    discard(raw)  # signatures are most of it
    t = named_apart(kept, other)
    side = named.where("id = rep").join(seats.select(F.col("a").alias("id")).distinct(), "id").join(t.select("id", "x", "counts"), ["id", "x"])
    side = stored(side.select("id", "x", "n", "counts").dropDuplicates(["id"]))
    # the table of texts outgrows any broadcast, and so does the list of ids: both are sorted, whatever the input's size
    texts = stored(named_apart(with_text(docs), other).join(side.select("id", "x").hint("merge"), ["id", "x"]).dropDuplicates(["id", "x"]).select("id", "text"))  # an id has one x in side, and rows meet by both: no second shuffle
    swept(docs.sparkSession)
    pairs = possible(seats.where("a <> b").select("a", "b").distinct(), side.drop("x"), percent)
    linked = links(seats, pairs, True, texts, lambda lines: (shingles(x or "", words) for x in lines), percent, block, most)
    found = components(named.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")).union(linked).union(other.select("id", "own")))
    discard(kept, other, rep, named, to, seats, side, texts, linked)
    swept(docs.sparkSession)
    out = slim.join(found, "id", "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def representatives(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component: the one of least doc_id. Columns as they are."""
    gone = join(docs, words, percent).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
