"""Links between sets that share signatures: what the joins on shingles have in common.

Rows of a signature are linked to its least id; those pairs that sizes and region counts (a lower bound of the
differences) allow are verified exactly on whole texts, and joined into components. Signatures that then still hold
several components are met once more: the rows outside the largest component are dealt into blocks of bounded size,
all rows pass each block, and the pairs across components that may be similar enough are verified. Of long texts
the signatures that chain together meet as one cluster, so that a text is there once, as a sketch whose
distance bounds the differences from below and is close to them; first a tentative spanning forest is verified, then
whatever pairs are left across components. No signature and no component is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from smframe.llm.common import components, discard, stored, swept

def regions(s: np.ndarray, bits: int = 6) -> bytes:
    """How many of the distinct 64-bit elements each of the 2 ** bits equal parts of their domain has, 255 at most: the sum of differences bounds those of two sets from below."""
    return np.minimum(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def counts_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1).astype(np.int16)


def overlap(s: np.ndarray, t: np.ndarray) -> int:
    """How many elements two sorted sets share."""
    both = np.concatenate((s, t))
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


def may_link(n: np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes and region counts of pairs of sets leave room for the similarity."""
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (np.abs(x - y).sum(1, dtype=np.int64) * (100 + percent) <= (n + m) * (100 - percent))


def possible(pairs: DataFrame, side: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and region counts of side (id, n, counts) allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            n, m = (b.column(c).to_numpy() for c in ("n", "m"))
            ok = may_link(n, m, counts_of(b.column("p")), counts_of(b.column("q")), percent)
            yield b.select(["a", "b"]).filter(pa.array(ok))

    one, two = side.select(F.col("id").alias("a"), "n", F.col("counts").alias("p")), side.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("counts").alias("q"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "n", "m", "p", "q").mapInArrow(run, "a long, b long")


def across(rows: DataFrame, percent: int, sets_of: Callable, bits: int = 8) -> DataFrame:
    """Links (a, b) of different components c, in one group g, one of them resident there, that join whatever such links join.

    Rows of a group come residents first. Only a group's residents are held, a batch at a time passes them. The pairs that
    sizes and region counts allow are verified at once: of those that are similar enough a spanning forest of the
    components leaves the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, root = None, {}

        def find(k: int) -> int:
            while (up := root.get(k, k)) != k:
                root[k] = k = root.get(up, up)
            return k

        def links(p: np.ndarray, q: np.ndarray, c: np.ndarray, sets: np.ndarray) -> list[int]:
            out = []
            for k, (i, j) in enumerate(zip(p.tolist(), q.tolist())):
                x, y = find(int(c[i])), find(int(c[j]))
                if x != y:
                    both = overlap(sets[i], sets[j])
                    if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                        root[max(x, y)] = min(x, y)
                        out.append(k)
            return out

        for b in batches:
            if not b.num_rows:
                continue
            sets = np.empty(b.num_rows, object)
            sets[:] = [*sets_of(b.column("text").to_pylist())]
            n, x = np.fromiter(map(len, sets), np.int64, len(sets)), np.stack([np.frombuffer(regions(v, bits), np.uint8) for v in sets]).astype(np.int16)
            new = [*(b.column(k).to_numpy(zero_copy_only=False) for k in ("g", "id", "c", "resident")), n, x, sets, np.ones(b.num_rows, bool)]
            g, ids, c, resident, n, x, sets, fresh = new if held is None else [np.concatenate(v) for v in zip(held, new)]
            ends = np.flatnonzero(np.append(g[1:] != g[:-1], True))
            last = ends[np.searchsorted(ends, np.arange(len(g)))]  # where each row's group ends
            i, d, got = np.flatnonzero(resident), 1, []
            while len(i := i[i + d <= last[i]]):
                j = i + d
                ok = fresh[j] & (c[i] != c[j])
                p, q = i[ok], j[ok]
                ok = may_link(n[p], n[q], x[p], x[q], percent)
                p, q = p[ok], q[ok]
                at = links(p, q, c, sets)
                got.append((ids[p[at]], ids[q[at]]))
                d += 1
            if got:
                p, q = (np.concatenate(v) for v in zip(*got))
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(p, q)), pa.array(np.minimum(p, q))], ["a", "b"])
            keep = resident & (g == g[-1])
            held = [v[keep] for v in (g, ids, c, resident, n, x, sets)] + [np.zeros(np.count_nonzero(keep), bool)]
            if g[0] != g[-1]:
                root.clear()  # bounded by the groups of a batch

    rows = rows.repartition("g").sortWithinPartitions("g", F.desc("resident"))
    return rows.select("g", "id", "c", "resident", "text").mapInArrow(run, "a long, b long")


def sketch(s: np.ndarray) -> bytes:
    """Parities of how many elements fall into each of 2 ** k equal parts of the domain, at least four parts an element; two sets differ in as many elements at least as their sketches in bits."""
    parts = max(64, 1 << (4 * len(s) - 1).bit_length()) if len(s) else 64
    return np.packbits((np.bincount((s & np.uint64(parts - 1)).astype(np.int64), minlength=parts) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(x: np.ndarray, words: int) -> np.ndarray:
    """Sketches, one a row, as they are of half, a quarter ... as many parts."""
    while x.shape[1] > words:
        x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
    return x


class Residents:
    """Sketched rows of one group, and which of them may link with a row that passes."""

    def __init__(self, rows: list[list]) -> None:
        self.ids, self.c, self.n = (np.fromiter((r[k] for r in rows), np.int64, len(rows)) for k in range(3))
        sketches = [r[3] for r in rows]
        size = np.fromiter(map(len, sketches), np.int64, len(sketches)) // 8
        self.of = {int(w): np.flatnonzero(size == w) for w in np.unique(size)}
        own = {w: np.frombuffer(b"".join(sketches[k] for k in at), np.uint64).reshape(len(at), w) for w, at in self.of.items()}
        self.at_width = cache(lambda w, words: folded(own[w], words))

    def near(self, c: int, n: int, x: bytes, percent: int) -> np.ndarray:
        """Positions of those of another component than c, whose size and sketch leave room for the similarity with a set of n elements."""
        row, out = np.frombuffer(x, np.uint64)[None], []
        for w, at in self.of.items():
            m = self.n[at]
            ok = np.flatnonzero((self.c[at] != c) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m)))
            if len(ok):
                words = min(w, row.shape[1])
                d = np.bitwise_count(self.at_width(w, words)[ok] ^ folded(row, words)).sum(1, dtype=np.int64)
                out.append(at[ok[d * (100 + percent) <= (n + m[ok]) * (100 - percent)]])
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def meeting(rows: DataFrame, percent: int, forest: bool) -> DataFrame:
    """The pairs (a, b) of different components c, in one group g, one of them resident there, that sizes and sketches allow.

    Rows of a group come residents first. Only a group's residents are held, a row at a time passes them. With forest,
    of a group's pairs come as many as join its components the way all would, were they links.
    """

    def of_group(rows: Iterator[tuple]) -> Iterator[tuple[int, int]]:
        residents, held, root = [], None, {}

        def find(k: int) -> int:
            while (up := root.get(k, k)) != k:
                root[k] = k = root.get(up, up)
            return k

        def met(row: tuple, before: int) -> Iterator[tuple[int, int]]:
            i, c, n, x = row
            for k in held.near(c, n, x, percent).tolist():
                if k >= before:
                    continue
                p, q = find(c), find(int(held.c[k]))
                if p != q or not forest:
                    root[max(p, q)] = min(p, q)
                    yield max(i, int(held.ids[k])), min(i, int(held.ids[k]))

        def all_held() -> Iterator[tuple[int, int]]:
            for k, row in enumerate(residents):
                yield from met(row, k)

        for _, resident, *row in rows:
            if resident:
                residents.append(row)
                continue
            if held is None:
                held = Residents(residents)
                yield from all_held()
            yield from met(row, len(residents))
        if held is None:
            held = Residents(residents)
            yield from all_held()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda got: pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*got)], ["a", "b"])
        stream = (row for b in batches for row in zip(*(b.column(k).to_pylist() for k in ("g", "resident", "id", "c", "n", "sketch"))))
        got = []
        for _, rows in groupby(stream, itemgetter(0)):
            for pair in of_group(rows):
                got.append(pair)
                if len(got) >= 10_000:
                    yield out(got)
                    got = []
        if got:
            yield out(got)

    rows = rows.repartition("g").sortWithinPartitions("g", F.desc("resident"))
    return rows.select("g", "resident", "id", "c", "n", "sketch").mapInArrow(run, "a long, b long")


def sketched(texts: DataFrame, sets_of: Callable) -> DataFrame:
    """id, n and sketch of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(len(s), sketch(s)) for s in sets_of(b.column("text").to_pylist())]
            if got:
                n, x = zip(*got)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(x, pa.binary())], ["id", "n", "sketch"])

    return texts.select("id", "text").mapInArrow(run, "id long, n long, sketch binary")


def dealt(members: DataFrame, key: str, block: int) -> DataFrame:
    """Members (key, id, c ...) of the keys with several components, dealt into groups g: residents of one block each, and what passes them; each two blocks meet once."""
    per = members.groupBy(key, "c").agg(F.count(F.lit(1)).alias("_n")).groupBy(key).agg(F.max(F.struct("_n", "c")).alias("_top"), F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    per = per.where("_k > 1").select(key, F.col("_top.c").alias("_main"), F.ceil((F.col("_all") - F.col("_top._n")) / block).cast("int").alias("_blocks"))
    own = F.when(F.col("c") != F.col("_main"), F.pmod(F.xxhash64(F.lit("block"), "id"), F.col("_blocks").cast("long")).cast("int")).otherwise(F.lit(-1))
    rows = members.join(per, key).withColumn("_own", own).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).where("_own <= _j")
    return rows.withColumn("g", F.xxhash64(key, "_j")).withColumn("resident", F.col("_own") == F.col("_j"))


def verified(pairs: DataFrame, texts: DataFrame, sets_of: Callable, percent: int, most: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough. b's text meets those of its partners, `most` or so in a group."""
    turns = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("turns"))
    group = lambda turn: F.xxhash64(F.lit("group"), F.col("b"), turn)
    guests = pairs.join(turns, "b").select(F.col("a").alias("id"), group(F.pmod(F.xxhash64(F.lit("turn"), "a"), F.col("turns").cast("long")).cast("int")).alias("g"), F.col("b"), F.lit(False).alias("first"))
    hosts = turns.select(F.col("b").alias("id"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "b").select("id", group(F.col("turn")).alias("g"), "b", F.lit(True).alias("first"))
    rows = guests.union(hosts).join(texts.hint("merge"), "id").repartition("g").sortWithinPartitions("g", "b", F.desc("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host = None
        for b in batches:
            got = []
            for s, i, h, first in zip(sets_of(b.column("text").to_pylist()), *(b.column(c).to_pylist() for c in ("id", "b", "first"))):
                if first:
                    host = s
                    continue
                both = overlap(s, host)
                if 100 * both >= percent * (len(s) + len(host) - both):
                    got.append((i, h))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*got)], ["a", "b"])

    return rows.select("id", "b", "first", "text").mapInArrow(run, "a long, b long")


def links(seats: DataFrame, pairs: DataFrame, long: bool, texts: DataFrame, sets_of: Callable, percent: int, block: int, most: int) -> DataFrame:
    """Links (a, b), enough to join whatever links join, between ids that share a signature.

    seats: (s, a, b), stored: signature, id, and the signature's least id. pairs: (a, b), those of seats that are to be
    verified. long: whether texts are long, then they are met again as sketches, by clusters of signatures; short
    texts go along with each signature that is met again. texts: (id, text), stored. sets_of: the sorted sets of a
    list of texts.
    """
    tried = stored(pairs)
    found = stored(verified(tried, texts, sets_of, percent, most))
    swept(texts.sparkSession)
    joined = components(found)
    at = stored(seats.select("s", F.col("a").alias("id")).distinct().join(joined, "id", "left").select("s", "id", F.coalesce("component", "id").alias("c")))
    per = at.groupBy("s", "c").agg(F.count(F.lit(1)).alias("n")).groupBy("s").agg(F.max(F.struct("n", "c")).alias("top"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("k"))
    # of two rows the one pair has been tried
    open_ = stored(per.where("k > 1 and all > 2").select("s", F.col("top.c").alias("main")))
    rows = stored(at.join(open_, "s"))
    swept(texts.sparkSession)
    if not long:
        more = stored(across(dealt(rows.drop("main").join(texts, "id"), "s", block), percent, sets_of).distinct())
        out = stored(found.union(more))
        discard(tried, found, joined, at, open_, rows, more)
        return out
    cluster = components(rows.where("c <> main").select(F.col("c").alias("a"), F.col("main").alias("b")))
    members = rows.select("id", "c").distinct().join(cluster.select(F.col("id").alias("c"), F.col("component").alias("cluster")), "c")
    drawn = stored(sketched(texts.join(rows.select("id").distinct().hint("merge"), "id"), sets_of))
    members = stored(members.join(drawn, "id"))
    discard(cluster, drawn, at, open_, rows)
    swept(texts.sparkSession)
    for forest in (True, False):
        rest = stored(meeting(dealt(members, "cluster", block), percent, forest).join(tried, ["a", "b"], "left_anti"))
        more = stored(verified(rest, texts, sets_of, percent, most))
        before, found = (tried, found, joined, members), stored(found.union(more))
        if forest:
            tried, joined = stored(tried.union(rest)), components(found)
            members = stored(members.drop("c").join(joined, "id", "left").select("id", F.coalesce("component", "id").alias("c"), "cluster", "n", "sketch"))
        discard(*before, rest, more)
        swept(texts.sparkSession)
    return found
