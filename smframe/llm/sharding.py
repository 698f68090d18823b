"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has 2^16 cells; each shard owns `vnodes` of them and every cell belongs to the next owned cell clockwise.
A row's cell is a hash of its key. A shard takes rows in clockwise order until it is full; the rest continue to the
next virtual node whose shard has room. The bounds add up to the number of rows and differ by one at most, so the
law is `rows`. What the driver plans on is a count per cell (a fixed number of cells), never rows.

A null doc_id is a key like any other; a null text has size 1 and checksum 0; equal keys stand in the order of
checksum and size; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from smframe.llm.common import stored

CELLS = 1 << 16


def ring(shards: int, vnodes: int, cells: int = CELLS) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, clockwise; a node whose cell is taken moves on to the next free one.

    Positions hash from the shard's own number, so more shards leave the others' nodes in place but for such moves.
    """
    taken: dict[int, int] = {}
    for s in range(shards):
        for v in range(vnodes):
            at = int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big") % cells
            while at in taken:
                at = (at + 1) % cells
            taken[at] = s
    return sorted(taken.items())


def deal(counts: dict[int, int], nodes: list[tuple[int, int]], caps: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Segments (cell, lo, hi, shard, slot of lo): rows lo..hi-1 of a cell go to shard.

    counts: rows by cell. In turns, each shard takes what waits at its nodes, clockwise, while it has room; what it
    can't take waits at the next node clockwise whose shard isn't full.
    """
    waiting: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    k = 0
    for cell in sorted(counts):
        while k < len(nodes) and nodes[k][0] < cell:
            k += 1
        waiting[k % len(nodes)].append((cell, 0, counts[cell]))
    room, slot, out = [*caps], [0] * len(caps), []
    while any(waiting.values()):
        moved: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for k in sorted(waiting):
            shard = nodes[k][1]
            for cell, lo, hi in waiting[k]:
                if took := min(hi - lo, room[shard]):
                    out.append((cell, lo, lo + took, shard, slot[shard]))
                    room[shard] -= took
                    slot[shard] += took
                if lo + took < hi:
                    moved[k].append((cell, lo + took, hi))
        waiting = defaultdict(list)
        for k, rest in moved.items():
            j = (k + 1) % len(nodes)
            while not room[nodes[j][1]]:
                j = (j + 1) % len(nodes)
            waiting[j] += rest
    return out


def shard(docs: DataFrame, shards: int = 16, vnodes: int = 64) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = stored(docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")))
    key = F.xxhash64(F.lit("key"), F.col("doc_id").cast("string"), "text_crc32")
    placed = rows.withColumn("_cell", F.shiftrightunsigned(key, 48).cast("int"))
    counts = {r[0]: r[1] for r in placed.groupBy("_cell").count().collect()}  # at most CELLS rows
    whole, more = divmod(sum(counts.values()), shards)
    segments = deal(counts, ring(shards, vnodes), [whole + (s < more) for s in range(shards)])
    plan = spark.createDataFrame(segments, "_c int, _lo long, _hi long, shard int, _slot long")
    order = Window.partitionBy("_cell").orderBy(key, F.col("doc_id"), "text_crc32", "size")
    ranked = placed.withColumn("_rank", F.row_number().over(order).cast("long") - 1)
    # one segment for each cell and split: bounded by CELLS and the shards' turns, not by the rows
    at = ranked.join(F.broadcast(plan), (F.col("_cell") == F.col("_c")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    return at.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("_slot") + F.col("_rank") - F.col("_lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
