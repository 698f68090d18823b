"""Filter interaction audit: what each of five filters removes, in every order in which they can be applied.

Words are exploded and counted by (document, word), then by document for totals and distinct words; the other flags are
joined to that from outside. Each document then has a mask of the filters that it fails, and each part of the table one
row with 32 conditional counts (and as many of good and of toxic documents). All 120 orders follow from those counts.

A text crosses one shuffle, whole, by its document; words are counted behind it, so that no word is shuffled. Rows that
are equal in doc_id and text are told apart by the file and block that they come from, as far as there are several,
so that not even those meet in one task; a document's counts are divided by its rows. DataFrame functions only.

A null text counts as empty, a null lang as the empty string. A null doc_id is smaller than none: it fails no comparison
of texts, makes no other fail, and has no labels. Rows of one doc_id are documents of their own; so are repeated rows. Of several
labels of one doc_id the highest counts. A table without rows has no parts, and gives no rows. Other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from smframe.llm.common import discard, stored

FILTERS = "ABCDE"
BLANK = r"[\x20\x09-\x0D]+"
ORDERS = ["".join(p) for p in permutations(FILTERS)]


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, part, text, d1 and d2 (128 bits of the text's SHA-256), and block: where the row lies, one of 64."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"), F.sha2(text.cast("binary"), 256).alias("h"), F.pmod(F.xxhash64(F.input_file_name(), F.input_file_block_start()), F.lit(64)).alias("block"))
    half = lambda at: F.conv(F.substring("h", at, 16), 16, -10).cast("long")
    return d.select("doc_id", "part", "text", half(1).alias("d1"), half(17).alias("d2"), "block")


def word_counts(docs: DataFrame) -> DataFrame:
    """doc_id, d1, d2, total and distinct: the words of all rows of a document together, and its distinct words; none for documents without words."""
    key = ["doc_id", "d1", "d2", "block"]
    dealt = _keyed(docs).select(*key, "text").repartition(*key)
    words = dealt.select(*key, F.explode(F.split("text", BLANK)).alias("word")).where("word <> ''")
    each = words.groupBy(*key, "word").agg(F.count(F.lit(1)).alias("n"))
    by_block = each.groupBy(*key).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct"))
    return by_block.groupBy("doc_id", "d1", "d2").agg(F.sum("total").alias("total"), F.max("distinct").alias("distinct"))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic and n: how many rows of docs fail just the filters of mask (bit k: the k-th of FILTERS)."""
    t = F.col("text")
    upper = F.regexp_count(t, F.lit("[A-Z]"))
    rows = _keyed(docs).select("doc_id", "part", "d1", "d2", (F.lit(100) * upper > F.lit(10) * F.length(t)).alias("c"), t.rlike("[#$%&*|]").alias("d"))
    rows = stored(rows.groupBy("doc_id", "part", "d1", "d2", "c", "d").agg(F.count(F.lit(1)).alias("n")))
    # written, as is the next one, so that Spark can split the join of a text with very many copies
    first = stored(rows.groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("d1", "d2", "first"))
    counts = stored(word_counts(docs).alias("l").join(rows.groupBy("doc_id", "d1", "d2").agg(F.sum("n").alias("rows")).alias("r"), _on("doc_id", "d1", "d2")).select("l.doc_id", "l.d1", "l.d2", F.expr("total div rows").alias("words"), "distinct"))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    r = rows.join(first, ["d1", "d2"], "left").join(known, "doc_id", "left")
    r = r.alias("l").join(counts.alias("r"), _on("doc_id", "d1", "d2"), "left")
    words, distinct = F.coalesce("words", F.lit(0)), F.coalesce("distinct", F.lit(0))
    fails = [words < 100, F.lit(100) * distinct < F.lit(80) * words, F.col("c"), F.col("d"), F.coalesce(F.col("l.doc_id") > F.col("first"), F.lit(False))]
    mask = sum((F.when(f, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(fails)), F.lit(0))
    no = F.lit(False)
    out = r.select("part", mask.alias("mask"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"), "n")
    out.needs = (rows, first, counts)
    return out


def _on(*columns: str) -> Column:
    on = F.col(f"l.{columns[0]}").eqNullSafe(F.col(f"r.{columns[0]}"))
    for c in columns[1:]:
        on = on & (F.col(f"l.{c}") == F.col(f"r.{c}"))
    return on


def counts_by_part(failed: DataFrame) -> DataFrame:
    """One row for each part: 32 conditional counts n0..n31 by mask, and g0.., t0.. of those among them that are good and toxic."""
    kinds = {"n": "true", "g": "good", "t": "toxic"}
    counts = (f"sum(if(mask = {m} and {only}, n, 0L)) as {x}{m}" for x, only in kinds.items() for m in range(1 << len(FILTERS)))
    return failed.groupBy("part").agg(*map(F.expr, counts))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and what the filter of that step does there; 600 rows for each part.

    docs: a table or what is made of one; Spark can't tell the file of a join's rows, so store a join first.
    """
    failed = failures(docs, labels)
    per = stored(counts_by_part(failed))
    discard(*failed.needs)
    masks = range(1 << len(FILTERS))
    arrays = (F.expr(f"array({', '.join(f'named_struct("m", {m}, "v", {x}{m})' for m in masks)})").alias(x) for x in "ngt")
    r = per.select("part", *arrays, F.explode(F.lit(ORDERS)).alias("filter_order"))
    r = r.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit = lambda k: F.call_function("shiftleft", F.lit(1), F.ascii(F.substring("filter_order", k, F.lit(1))) - ord(FILTERS[0]))
    bits = F.transform(F.sequence(F.lit(1), F.col("step")), bit)
    r = r.withColumn("own", F.element_at(bits, -1)).withColumn("before", F.aggregate(bits, F.lit(0), lambda a, x: a + x) - F.col("own"))
    before, own = F.col("before"), F.col("own")

    def total(column: str, which, times=lambda m: F.lit(1)) -> Column:
        return F.aggregate(F.filter(column, lambda x: which(x["m"])), F.lit(0).cast("long"), lambda a, x: a + x["v"] * times(x["m"]))

    here = lambda m: (m.bitwiseAND(before) == 0) & (m.bitwiseAND(own) != 0)
    first = F.array(*(F.lit(len(ORDERS) // max(1, m.bit_count())).cast("long") for m in masks))  # in so many orders one of a mask's filters is the first
    return r.select(
        "part", "filter_order", "step",
        total("n", lambda m: m.bitwiseAND(before.bitwiseOR(own)) == 0).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda m: (m.bitwiseAND(before) != 0) & (m.bitwiseAND(own) != 0)).alias("redundant"),
        total("n", lambda m: m == own).alias("unique_fails"),
        total("g", here).alias("good_lost"),
        total("t", here).alias("toxic_lost"),
        total("n", lambda m: m.bitwiseAND(own) != 0, lambda m: F.get(first, m)).alias("shapley"),
    )
