"""Quality classifier: Bradley-Terry ranking of documents, thresholded by score quantile.

A document's strength is linear in features of its text. From labelled rows, preference pairs (a row of label 1
over one of label 0) give the weights by logistic loss on feature differences. The threshold is the exact quantile of the
strengths of all labelled rows that aren't held out, at the share of label 0 among them; the score is the logistic of
strength less threshold, so 0.5 is the cut.

Features come from the text alone; a null text counts as empty and has a score. The fit reads every labelled row (conflicting
labels of one doc_id count as 0; of several texts of a doc_id that of the least features). Rows are dealt into cells by a hash of
doc_id, 8 * `most` rows of the commoner label in each, and all pairs within a cell count. Of a label too rare to give each cell
`most` rows, each row is in as many cells as it takes. A Newton step is a job over the cells, whose sums alone reach the
driver, in whole numbers, so that no order matters. Without rows of both labels every score is 0.5.
Rows are independent; ties and repeated rows get equal scores; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from smframe.llm.common import discard, stored

# Frequent function words of four languages.
COMMON = frozenset("the of and to in is for with that are was this by as on be have from die der und den das ist von mit zu ein eine nicht auf le la les et de des en un une que qui pour dans est el los las y del por con no se".split())
WORD_END = re.compile(r"[^\w\s]+$")
NAMES = (
    "chars", "words", "upper", "digit", "bang", "bar", "symbol", "stop", "non_ascii", "blank", "word_length", "word_spread", "distinct_words", "distinct_lines", "common", "ends_symbol", "line_words", "longest_word", "top_word", "bigrams", "capitals",
)


def features(text: str) -> list[float]:
    """The measures named in NAMES; zeros for a text without words, whose first entries still say so."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, len(raw))
    h = np.bincount(raw, minlength=256)
    words = text.split()
    m = len(words)
    if not m:
        return [np.log1p(len(raw))] + [0.0] * (len(NAMES) - 1)
    lens = np.fromiter(map(len, words), np.int64, m)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x]
    symbols = sum(int(h[ord(c)]) for c in "#$%&*@^~<>{}[]\\=+_")
    tail = sum(not w[-1].isalnum() and w[-1] not in ".,;:" for w in words)
    capitals = sum(w[0].isupper() for w in words)
    common = sum(counts.get(w, 0) for w in COMMON)
    pairs = len(set(zip(words, words[1:]))) / max(1, m - 1)
    return [
        np.log1p(len(raw)), np.log1p(m), h[65:91].sum() / n, h[48:58].sum() / n, h[33] / n, h[124] / n, symbols / n, (h[46] + h[44]) / n, h[128:].sum() / n, (h[32] + h[10]) / n,
        float(np.log(lens.mean())), float(lens.std() / lens.mean()), len(counts) / m, len({*lines}) / max(1, len(lines)), common / m, tail / m,
        np.log1p(m / max(1, len(lines))), float(np.log(lens.max())), max(counts.values()) / m, pairs, capitals / m,
    ]


def expand(x: np.ndarray) -> np.ndarray:
    """Measures, their square roots where they are shares, and squares: the ranking stays linear in what it is given."""
    return np.concatenate([x, np.sqrt(np.abs(x)), x * x], axis=1)


@dataclass(frozen=True)
class Ranking:
    """What fit() learns: strength = weights . (x - mean) / spread; scores are logistic in (strength - threshold) * steepness."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    steepness: float

    def strengths(self, x: np.ndarray) -> np.ndarray:
        return standard(x, self.mean, self.spread) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.strengths(x) - self.threshold) * self.steepness, -30, 30)))


def standard(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    return np.clip((expand(x) - mean) / spread, -8, 8)


def weighted_quantile(s: np.ndarray, w: np.ndarray, q: float) -> float:
    """The quantile q of s, linear between values; with equal weights that of np.quantile."""
    order = np.argsort(s, kind="stable")
    at = np.cumsum(w[order]) - w[order] / 2
    return float(np.interp(q, (at - at[0]) / (at[-1] - at[0]), s[order]))


def quantile(table: DataFrame, q: float) -> float:
    """The quantile q of column s of a stored table that has rows, linear between values; all rows are counted, in bins that narrow until two neighbours are told."""
    r = table.agg(F.count("s").alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi")).first()
    lo, hi, at = r["lo"], r["hi"], q * (r["n"] - 1)
    k, frac = int(at), at - int(at)
    if k == r["n"] - 1:
        return hi
    while lo < hi:
        place = F.least(F.floor((F.col("s") - lo) / (hi - lo) * 4096), F.lit(4095))
        bins = table.where(F.col("s").between(lo, hi)).groupBy(place.alias("bin")).agg(F.count("s").alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi")).orderBy("bin").collect()
        i = 0
        while k >= bins[i]["n"]:
            k -= bins[i]["n"]
            i += 1
        if k == bins[i]["n"] - 1:  # of two values the one ends a bin, the other begins the next; past the last, its equals follow
            lo, hi = bins[i]["hi"], bins[i + 1]["lo"] if i + 1 < len(bins) else bins[i]["hi"]
            break
        lo, hi = bins[i]["lo"], bins[i]["hi"]
    return lo + frac * (hi - lo)


Cell = tuple[np.ndarray, np.ndarray, np.ndarray]


def of_cells(cells: DataFrame, f: Callable[[Cell], np.ndarray], out: str, whole: bool = False) -> DataFrame:
    """f of the (labels, features, whether a row's first copy) of each cell as column v; with whole, a task's sum of what f gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for y, x, own in zip(b.column("y"), b.column("x"), b.column("own")):
                y = y.values.to_numpy()
                v = f((y, x.values.to_numpy().reshape(len(y), -1), own.values.to_numpy(zero_copy_only=False)))
                if whole:
                    total = v if total is None else total + v
                else:
                    yield pa.RecordBatch.from_arrays([pa.array([v], pa.list_(pa.float64()))], ["v"])
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.int64()))], ["v"])

    return cells.select("y", "x", "own").mapInArrow(run, f"v array<{out}>")


def summed(cells: DataFrame, f: Callable[[Cell], np.ndarray], quantum: float) -> np.ndarray:
    """The sum of f over all cells; each cell's share is rounded to quanta, which add up alike in any order."""
    each = of_cells(cells, lambda c: np.rint(f(c) / quantum).astype(np.int64), "bigint", whole=True)
    got = each.select(F.posexplode("v").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect()
    return np.array([r["v"] for r in sorted(got)]) * quantum


def pair_sums(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradient and curvature (its upper triangle) of the logistic loss of all pairs of a cell, one after the other."""
    good, bad = z[y == 1], z[y == 0]
    p = 1 / (1 + np.exp(np.clip((good @ w)[:, None] - bad @ w, -30, 30)))
    g = good.T @ p.sum(1) - bad.T @ p.sum(0)
    p *= 1 - p
    cross = good.T @ p @ bad
    h = (good.T * p.sum(1)) @ good + (bad.T * p.sum(0)) @ bad - cross - cross.T
    return np.concatenate([g, h[np.triu_indices(len(w))]])


def _with_features(df: DataFrame, extra: list[str], then=None, out: str = "x array<double>") -> DataFrame:
    """extra columns and the features of column text, or what then(matrix) gives of them, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            t = b.column("_text")
            x = [features(t[i].as_py() or "") for i in range(len(t))]
            cols = then(np.array(x)) if then else [pa.array(x, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in extra), *cols], [*extra, *(f.split()[0] for f in out.split(", "))])

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in extra)
    return df.select(*extra, F.col("text").cast("string").alias("_text")).mapInArrow(run, f"{kinds}, {out}")


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most: int = 64, weight: float = 30_000, penalty: float = 20.0, rounds: int = 25) -> Ranking | None:
    """Bradley-Terry by Newton's method over all labelled rows, never held-out ones.

    most: see above; more rows in a cell are more pairs. weight: what all pairs together weigh, against the penalty.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("_y"))
    known = known.where("_y in (0, 1)").groupBy("doc_id").agg(F.min("_y").alias("_y"))
    # features before the join, which then moves no text
    x = _with_features(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text"), ["doc_id"])
    rows = stored(x.join(known, "doc_id").groupBy("doc_id", "_y").agg(F.min("x").alias("x")))
    total = {r["_y"]: r["n"] for r in rows.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(total) < 2:
        discard(rows)
        return None
    n, rare = sum(total.values()), min(total, key=lambda y: (total[y], y))
    number = max(1, total[1 - rare] // (8 * most))
    copies = min(number, -(-number * most // total[rare]))
    at = rows.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.when(F.col("_y") == rare, copies - 1).otherwise(0))))
    at = at.withColumn("_cell", F.pmod(F.xxhash64(F.lit("cell"), "doc_id") + F.col("_copy"), F.lit(number)))
    member = F.struct("_y", "x", (F.col("_copy") == 0).alias("own"), "doc_id")
    at = at.groupBy("_cell").agg(F.sort_array(F.collect_list(member)).alias("m"))  # a cell's order is the same, however rows arrive
    cells = stored(at.select(F.col("m._y").alias("y"), F.flatten("m.x").alias("x"), F.col("m.own").alias("own")))
    firsts = lambda c: expand(c[1][c[2]])
    largest = of_cells(cells, lambda c: np.abs(expand(c[1])).max(0), "double").select(F.posexplode("v").alias("k", "v")).groupBy("k").agg(F.max("v").alias("v")).collect()
    scale = np.array([r["v"] for r in sorted(largest)]) + 1e-9
    mean = summed(cells, lambda c: (firsts(c) / scale).sum(0) / n, 2.0**-60)
    spread = np.sqrt(summed(cells, lambda c: ((firsts(c) / scale - mean) ** 2).sum(0) / n, 2.0**-60)) * scale + 1e-9
    mean = mean * scale
    pairs = float(summed(cells, lambda c: np.array([(c[0] == 1).sum() * (c[0] == 0).sum()]), 1.0)[0])
    w = np.zeros(len(mean))
    for _ in range(rounds):
        v = summed(cells, lambda c, w=w: pair_sums(standard(c[1], mean, spread), c[0], w) * (weight / pairs), 2.0**-36)
        h = np.zeros((len(w), len(w)))
        h[np.triu_indices(len(w))] = v[len(w) :]
        h = h + np.triu(h, 1).T
        step = np.linalg.solve(h + penalty * np.eye(len(w)), v[: len(w)] - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    learned = Ranking(mean, spread, w, 0.0, 1.0)
    s = stored(of_cells(cells, lambda c: learned.strengths(c[1][c[2]]), "double").select(F.explode("v").alias("s")))
    threshold = quantile(s, total[0] / n)
    steepness = 4 / (s.agg(F.stddev_pop("s")).first()[0] + 1e-9)
    discard(rows, cells, s)
    return Ranking(mean, spread, w, threshold, float(steepness))


def classify(docs: DataFrame, ranking: Ranking | None, keep: list[str] | None = None) -> DataFrame:
    """keep (doc_id by default), score and predicted of every row."""

    def then(x: np.ndarray) -> list[pa.Array]:
        s = ranking.scores(x) if ranking else np.full(len(x), 0.5)
        return [pa.array(s), pa.array((s >= 0.5).astype(np.int32))]

    return _with_features(docs, keep or ["doc_id"], then, "score double, predicted int")
