"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of seven bytes triggers a chunk's end where its low bits are all ones; each chunk gives one of 64
characters; block sizes are powers of two, the smallest whose signature has at most 64 characters, and the next one.
Fingerprints are compared by edit distance of the signatures at equal block sizes, in the JVM.

Rows meet the next document in a range shuffle by doc_id: within a partition the rows stream by in order; the last
row of each partition meets the first of the next in a table of one row for each partition. Null texts count as empty; rows of
one doc_id stand in the order of a hash of their texts; a single row is its own next; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from smframe.llm.common import stored

LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
SPAN, FACTOR, MOST, LEAST_BLOCK = 7, 0x01000193, 64, 4


def rolling(raw: bytes) -> np.ndarray:
    """A mixed hash of the seven bytes that end at each position (zeros before the start)."""
    a = np.zeros(len(raw) + SPAN - 1, np.uint32)
    a[SPAN - 1 :] = np.frombuffer(raw, np.uint8)
    h = np.zeros(len(raw), np.uint32)
    for j in range(SPAN):
        h *= np.uint32(FACTOR)
        h += a[j : j + len(raw)]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    return h


def signature(h: np.ndarray, ends: np.ndarray) -> str:
    """One character for each chunk; a rest behind the last trigger is a chunk too."""
    starts = np.concatenate(([0], ends + 1)) if len(ends) else np.zeros(1, np.int64)
    starts = starts[starts < len(h)]
    if not len(starts):
        return ""
    sums = np.add.reduceat(h.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), starts)
    return LETTERS[(sums >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(text: str) -> str:
    """block:signature:signature at twice the block."""
    h = rolling(text.encode("utf-8", "surrogatepass"))
    block = LEAST_BLOCK
    while block * MOST < len(h):
        block *= 2
    at = lambda b, of=None: np.flatnonzero((h & np.uint32(b - 1)) == b - 1) if of is None else of[(h[of] & np.uint32(b - 1)) == b - 1]
    ends = at(block)
    while block > LEAST_BLOCK and len(ends) < MOST // 2 and len(finer := at(block // 2)) < MOST:
        block, ends = block // 2, finer
    while len(ends) >= MOST:
        block *= 2
        ends = at(block, ends)
    return f"{block}:{signature(h, ends)}:{signature(h, at(2 * block, ends))}"


def edited(text: str, following: str) -> str:
    """text with its last half replaced by as much of the start of the following text."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: one less the edit distance over the longer length, the best of the compatible block sizes; 0 where none is."""
    part = lambda x, i: F.split_part(x, F.lit(":"), F.lit(i))
    block = lambda x: part(x, 1).cast("long")

    def near(p: Column, q: Column) -> Column:
        longer = F.greatest(F.length(p), F.length(q))
        return F.when(longer == 0, F.lit(0.0)).otherwise(1 - F.levenshtein(p, q) / longer)

    best = (
        F.when(block(a) == block(b), F.greatest(near(part(a, 2), part(b, 2)), near(part(a, 3), part(b, 3))))
        .when(block(a) == 2 * block(b), near(part(a, 2), part(b, 3)))
        .when(2 * block(a) == block(b), near(part(a, 3), part(b, 2)))
        .otherwise(F.lit(0.0))
    )
    return F.when(a == b, F.lit(1.0)).otherwise(best).cast("double")


def compare(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint", "part", "first", "last", "text"]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()]

    def follow(row: tuple, after: tuple) -> tuple[str, str]:
        x = edited(row[1], after[1])
        return hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest(), fingerprint(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, first = TaskContext.get().partitionId(), None, True
        schema = None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            cols = [*zip(*rows)]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], schema), *(pa.array(c, t) for c, t in zip(cols[1:], types))], names)

        def row(x: tuple, after: tuple | None, first: bool) -> tuple:
            sha, fp = follow(x, after) if after else (None, None)
            return (x[0], len(x[1]), sha, x[2], fp, after and after[2], part, first, after is None, x[1] if first or after is None else None)

        for b in batches:
            schema, rows, texts, ids = b.schema.field("doc_id").type, [], b.column("text"), b.column("doc_id")
            for i in range(b.num_rows):
                t = texts[i].as_py()
                now = (ids[i].as_py(), t, fingerprint(t))
                if held:
                    rows.append(row(held, now, first))
                    first = False
                held = now
            if rows:
                yield out(rows)
        if held:
            yield out([row(held, None, first)])

    ordered = docs.select("doc_id", text.alias("text")).repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    fields = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string, part long, first boolean, last boolean, text string"
    rows = stored(ordered.mapInArrow(run, fields))

    # one first and one last row for each partition
    w = Window.orderBy("part")
    lowest = F.min("part").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    order = rows.where("first").select("part", F.coalesce(F.lead("part").over(w), lowest).alias("_to"))
    heads = rows.where("first").select(F.col("part").alias("_to"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fp"))
    ends = rows.where("last").join(order, "part").join(heads, "_to")

    def fix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, u = b.column("text").to_pylist(), b.column("next_text").to_pylist()
            new = [follow((None, x, None), (None, y)) for x, y in zip(t, u)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_chars"), pa.array([x[0] for x in new], pa.string()), b.column("fingerprint"), pa.array([x[1] for x in new], pa.string()), b.column("next_fp")], names[:6])

    six = fields.split(", part ")[0]
    done = rows.where("not last").select(*names[:6]).unionByName(ends.select("doc_id", "n_chars", "fingerprint", "text", "next_text", "next_fp").mapInArrow(fix, six))
    return done.select(*names[:5], likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
