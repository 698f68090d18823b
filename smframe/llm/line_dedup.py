"""Fuzzy line dedup by MinHash.

A line's shingles are all its overlapping runs of five characters, or the whole of a shorter line. Its signature is
the least value of each of 48 hash functions; six of them make a band. Each function serves two of the sixteen bands and
no two bands share more than one, so that a pair of lines at similarity 0.8 shares a band with a probability of
0.979, at 0.85 of 0.997. Lines that share a band are verified by exact Jaccard of their shingles. Union-find over the
links is distributed. One line of each component stays: its first by doc_id and position.

All is DataFrame functions. A line is laid out at four bytes a character and dealt into blocks of sixteen shingles; the
least values of a block are plain arithmetic on its sixteen hashes, those of a line an aggregate over its blocks, in the
task that holds the line. A hash function is the 64-bit hash of a shingle, or the hash of that, shifted and combined
with a constant by exclusive or. `bands` and `sets_of` do the same for a list of lines in NumPy.

Lines are what newlines part; blank lines always stay. Equal lines are one, by a 64-bit hash. Null and empty texts
pass unchanged. Rows that are equal in doc_id and text are one document. A null doc_id comes first. An empty table
gives no rows. Extra columns are carried, whatever their names, but for n_lines and n_removed, whose place the counts take.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from smframe.functions.arrays import let
from smframe.llm.common import components, discard, packed, stored, swept
from smframe.llm.links import dealt

LONG, BLOCK, WORDS = 5, 16, 8
BANDS, ROWS, CLASS = 16, 6, 8
U = np.uint64
_random = np.random.default_rng(20).integers(0, 1 << 60, (ROWS, CLASS), dtype=np.uint64)
#: The constant of function (row, k). Those of a row differ in their first bits, so that they look at different elements.
CONSTANT = (_random | (np.array([[(2 * k + r % 2) for k in range(CLASS)] for r in range(ROWS)], np.uint64) << U(60))).view(np.int64)
#: Band b takes function (r, k) for each (r, k) of MEMBERS[b].
MEMBERS = [[(r, (b + (b // CLASS) * r) % CLASS) for r in range(ROWS)] for b in range(BANDS)]
P1, P2, P3, P4, P5 = (U(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << U(by)) | (x >> U(64 - by))


def xxhash(words: list[np.ndarray], rest: np.ndarray | None = None, seed: np.ndarray | int = 42) -> np.ndarray:
    """Spark's xxhash64 of columns of 64-bit words, and of 32 bits more."""
    h = np.asarray(seed, np.uint64) + P5 + U(8 * len(words) + (0 if rest is None else 4))
    for w in words:
        h = _turn(h ^ (_turn(w * P2, 31) * P1), 27) * P1 + P4
    if rest is not None:
        h = _turn(h ^ (rest * P1), 23) * P2 + P3
    h = (h ^ (h >> U(33))) * P2
    h = (h ^ (h >> U(29))) * P3
    return h ^ (h >> U(32))


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, counts): the hashes of the shingles of lines that aren't empty; line k's are the counts[k] from starts[k] on."""
    n = np.fromiter(map(len, lines), np.int64, len(lines))
    start = np.cumsum(n) - n
    c = np.frombuffer("".join(lines).encode("utf-32-be", "surrogatepass") + bytes(4 * LONG), np.uint32).astype(np.uint64)
    of = lambda at, m: xxhash([c[at + j] | (c[at + j + 1] << U(32)) for j in range(0, m - 1, 2)], c[at + m - 1] if m % 2 else None)
    h = of(np.arange(len(c) - LONG + 1), LONG)
    for m in range(1, LONG):
        h[start[n == m]] = of(start[n == m], m)
    return h, start, np.maximum(1, n - LONG + 1)


def bands(lines: list[str]) -> np.ndarray:
    """(lines, BANDS): a hash of each band of the signature."""
    h, start, count = shingle_hashes(lines)
    edges, both = np.stack([start, start + count], 1).ravel(), (h, xxhash([h]))
    value = lambda r, k: ((both[r // 3] << U(21 * (r % 3))).view(np.int64) ^ CONSTANT[r, k])
    least = {(r, k): np.minimum.reduceat(value(r, k), edges)[::2].view(np.uint64) for r in range(ROWS) for k in range(CLASS)}
    out = np.empty((len(lines), BANDS), np.uint64)
    for b, members in enumerate(MEMBERS):
        key = xxhash([np.full(len(lines), U(b))])
        for m in members:
            key = xxhash([least[m]], seed=key)
        out[:, b] = key
    return out.view(np.int64)


def parts(lines: list[str], most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Runs of lines of about `most` characters, so that arrays stay in the processor's cache."""
    first = size = 0
    for k, x in enumerate(lines):
        size += len(x)
        if size >= most:
            yield first, k + 1
            first, size = k + 1, 0
    if first < len(lines):
        yield first, len(lines)


def sets_of(lines: list[str]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each line."""
    for i, j in parts(lines):
        h, start, count = shingle_hashes(lines[i:j])
        for k, m in zip(start.tolist(), count.tolist()):
            yield np.unique(h[k : k + m])


def codes(line: Column) -> Column:
    """A line at four bytes a character, so that its parts are found at once."""
    return F.encode(line, "UTF-32")


def shingles_of(line: Column) -> Column:
    """The distinct shingle hashes of a line."""
    at = lambda c: F.sequence(F.lit(1), F.greatest(F.octet_length(c) - 4 * LONG + 1, F.lit(1)), F.lit(4))
    return let(codes(line), lambda c: F.array_distinct(F.transform(at(c), lambda i: F.xxhash64(F.substring(c, i, F.lit(4 * LONG))))))


def similar(x: Column, y: Column, percent: int) -> Column:
    """Whether two arrays of distinct elements are similar enough."""
    both = F.size(F.array_intersect(x, y))
    return 100 * both >= percent * (F.size(x) + F.size(y) - both)


def row_key(df: DataFrame) -> Column:
    return F.xxhash64(df["doc_id"].cast("string"), df["text"])


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, rk, pos, cid and the text of every line that isn't blank."""
    keyed = docs.select("doc_id", row_key(docs).alias("rk"), "text")  # before the explode, else each line would hash its text anew
    rows = keyed.select("doc_id", "rk", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return rows.where(F.col("line").rlike(r"\S")).withColumn("cid", F.xxhash64("line"))


def unique(docs: DataFrame) -> DataFrame:
    """id and text of every different line, all of an id in one task; a line's copies meet in their own tasks first."""
    return lines(docs).groupBy(F.col("cid").alias("id")).agg(F.min("line").alias("text"))


def banded(docs: DataFrame) -> DataFrame:
    """id and bands of every different line. A line's blocks are made and folded where the line is, without a shuffle between."""
    last = F.greatest(F.octet_length("codes") - 4 * LONG, F.lit(0))
    rows = unique(docs).select("id", codes(F.col("text")).alias("codes")).select("id", "codes", last.alias("last"))
    rows = rows.select("id", "codes", "last", F.explode(F.sequence(F.lit(0), "last", F.lit(4 * BLOCK))).alias("at"))
    # the last block ends with the line; of a line that has fewer shingles than a block, the first one stands for those that lack
    at = F.least("at", F.greatest(F.col("last") - 4 * (BLOCK - 1), F.lit(0))) + 1
    rows = rows.select("id", "last", F.substring("codes", at, F.lit(4 * (BLOCK + LONG - 1))).alias("block"))
    piece = lambda j: F.substring("block", 4 * j + 1, 4 * LONG)
    rows = rows.select("id", *(F.xxhash64(F.when(F.col("last") >= 4 * j, piece(j)).otherwise(piece(0))).alias(f"h{j}") for j in range(BLOCK)))
    rows = rows.select("*", *(F.xxhash64(f"h{j}").alias(f"k{j}") for j in range(BLOCK)))
    moved = lambda c, by: F.shiftleft(c, by) if by else F.col(c)
    value = lambda r, k, j: moved(f"{'hk'[r // 3]}{j}", 21 * (r % 3)).bitwiseXOR(F.lit(int(CONSTANT[r, k])))
    least = [F.min(F.least(*(value(r, k, j) for j in range(BLOCK)))).alias(f"m{r}_{k}") for r in range(ROWS) for k in range(CLASS)]
    band = (F.xxhash64(F.lit(b).cast("long"), *(f"m{r}_{k}" for r, k in members)) for b, members in enumerate(MEMBERS))
    return rows.groupBy("id").agg(*least).select("id", F.array(*band).alias("bands"))


def verified(pairs: DataFrame, texts: DataFrame, percent: int, most: int) -> DataFrame:
    """The pairs (a, b) whose lines are similar enough. b's line meets those of its partners, `most` or so in a group."""
    turns = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("turns"))
    hosts = turns.join(texts.hint("merge").select(F.col("id").alias("b"), F.col("text").alias("y")), "b").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).drop("turns")
    guests = pairs.join(turns, "b").select("a", "b", F.pmod(F.xxhash64(F.lit("turn"), "a"), F.col("turns").cast("long")).cast("int").alias("turn"))
    rows = guests.join(texts.hint("merge").select(F.col("id").alias("a"), F.col("text").alias("x")), "a").join(hosts.hint("merge"), ["b", "turn"])
    return rows.where(similar(shingles_of(F.col("x")), shingles_of(F.col("y")), percent)).select("a", "b")


def sketched(texts: DataFrame) -> DataFrame:
    """id, n and x0, x1 ... of every line, each id once: its shingles, and parities of how many of them fall into each of 64 * WORDS parts of their domain. Two lines differ in as many shingles at least as their parities in bits."""
    each = texts.select("id", F.explode(shingles_of(F.col("text"))).alias("h"))
    bit = F.expr("shiftleft(1L, cast(h & 63 as int))")
    word = F.shiftright("h", 6).bitwiseAND(F.lit(WORDS - 1))
    return each.groupBy("id").agg(F.count(F.lit(1)).alias("n"), *(F.bit_xor(F.when(word == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"x{k}") for k in range(WORDS)))


def meeting(rows: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of different components c, in one group g, one of them resident there, that sizes and sketches allow."""
    left = rows.select("g", *(F.col(c).alias(f"_{c}") for c in rows.columns if c != "g"))
    right = rows.where("resident").drop("resident")
    met = left.join(right.hint("merge"), "g").where("_c <> c and (not _resident or _id > id)")
    met = met.where(100 * F.least("_n", "n") >= percent * F.greatest("_n", "n"))
    differ = sum((F.bit_count(F.col(f"_x{k}").bitwiseXOR(F.col(f"x{k}"))) for k in range(1, WORDS)), F.bit_count(F.col("_x0").bitwiseXOR(F.col("x0"))))
    met = met.where(differ * (100 + percent) <= (F.col("_n") + F.col("n")) * (100 - percent))
    return met.select(F.greatest("_id", "id").alias("a"), F.least("_id", "id").alias("b")).distinct()


def line_components(docs: DataFrame, percent: int = 80, block: int = 1024, most: int = 256) -> DataFrame:
    """(id, component) of the hashes of lines that have links.

    Lines of a band are verified with its least one first. Bands that then still hold several components are met once
    more: the lines outside the largest component are dealt into blocks of bounded size, all lines of the band pass each
    block, and the pairs across components that sizes and sketches allow are verified.
    """
    w = Window.partitionBy("s")
    seats = banded(docs).select(F.col("id").alias("a"), F.explode("bands").alias("s")).repartition("s")
    seats = seats.select("s", "a", F.min("a").over(w).alias("b"), F.max("a").over(w).alias("hi")).where("b < hi")
    seats = stored(seats.select("s", "a", "b"))
    swept(docs.sparkSession)
    # the table of lines outgrows any broadcast, and so does the list of those that share a band: both are sorted, whatever the input's size
    texts = stored(unique(docs).join(seats.select(F.col("a").alias("id")).distinct().hint("merge"), "id"))
    tried = stored(seats.where("a <> b").select("a", "b").distinct())
    found = stored(verified(tried, texts, percent, most))
    joined = components(found)
    at = stored(seats.select("s", F.col("a").alias("id")).distinct().join(joined, "id", "left").select("s", "id", F.coalesce("component", "id").alias("c")))
    per = at.groupBy("s", "c").agg(F.count(F.lit(1)).alias("n")).groupBy("s").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("k"))
    # of two lines the one pair has been tried
    rows = stored(at.join(per.where("k > 1 and all > 2").select("s"), "s"))
    drawn = stored(sketched(texts.join(rows.select("id").distinct().hint("merge"), "id")))
    rest = stored(meeting(dealt(rows.join(drawn, "id"), "s", block), percent).join(tried, ["a", "b"], "left_anti"))
    more = stored(verified(rest, texts, percent, most))
    out = components(found.union(more))
    discard(seats, texts, tried, found, joined, at, rows, drawn, rest, more)
    swept(docs.sparkSession)
    return out


def dedup(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs with each text less the lines removed, and n_lines, n_removed (lines that aren't blank) added."""
    found = line_components(docs, percent)
    at = lines(docs).select("doc_id", "rk", "pos", "cid")
    at = at.join(found, at["cid"] == found["id"], "left").select("doc_id", "rk", "pos", F.coalesce("component", "cid").alias("c"))
    at = stored(at)
    first = stored(at.groupBy("c").agg(F.min(F.struct("doc_id", "rk", "pos")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1").select("c", "f"))
    gone = at.join(first, "c").where(~F.struct("doc_id", "rk", "pos").eqNullSafe(F.col("f")))
    gone = gone.groupBy(F.col("rk").alias("_rk"), F.col("doc_id").alias("_doc")).agg(F.collect_set("pos").alias("p"))
    gone = stored(gone.select("_rk", "_doc", marks(F.col("p")).alias("_gone"), F.size("p").alias("_n")))
    discard(found, at, first)
    d = docs.select(packed(docs.drop("text")).alias("_row"), F.col("doc_id").alias("_id"), F.col("text").alias("_text"), row_key(docs).alias("_k"))
    d = d.join(gone, (F.col("_k") == F.col("_rk")) & F.col("_id").eqNullSafe(F.col("_doc")), "left")
    parts = F.split("_text", "\n", -1)
    left = let(F.col("_gone"), lambda g: F.array_join(F.filter(parts, lambda s, i: F.substring(g, i + 1, F.lit(1)) != F.lit(b"1")), "\n"))
    text = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(left)
    count = F.coalesce(F.size(F.filter(parts, lambda s: s.rlike(r"\S"))), F.lit(0))
    keep = (text.alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns if c.lower() not in ("n_lines", "n_removed"))
    return d.select(*keep, count.cast("long").alias("n_lines"), F.coalesce("_n", F.lit(0)).cast("long").alias("n_removed"))


def marks(positions: Column) -> Column:
    """One byte for each position up to the last: 1 for those of the array, else 0. A byte is found at once, an array is searched."""
    run = lambda p, i, a: F.concat(F.repeat(F.lit("0"), p - F.when(i == 0, F.lit(-1)).otherwise(F.get(a, i - 1)) - 1), F.lit("1"))
    return let(F.sort_array(positions), lambda a: F.array_join(F.transform(a, lambda p, i: run(p, i, a)), "")).cast("binary")
