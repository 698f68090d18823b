"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

Two first-order models over one alphabet, of random strings and of ordinary identifiers, are trained from labelled
samples. A long token outside the pattern matches is reported as kind `markov` where the mean log-likelihood ratio
for a step exceeds a threshold, whatever its length, unless it repeats a few characters. DataFrame functions only. The model is a matrix of the size of the alphabet
squared, whatever the input's size.

Null and empty texts have no spans; rows are independent, so ties and repeated rows don't matter; other columns are
not read; an empty table gives no rows. Offsets count code points, ends exclusive.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from smframe.functions.arrays import let

# The base patterns.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]{16,})"
HEX = r"((?<![0-9a-f])[0-9a-f]{24,})"
#: (kind, pattern, least characters of group 1); the order breaks ties of the start. Runs of access and hex are
#: maximal whatever their length, so their least lengths (20 and 24 in all) can stand in the pattern.
BASE = (("assign", ASSIGN, 6), ("access", ACCESS, 20), ("hex", HEX, 24))

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WIDTH = len(ALPHABET) + 1
#: A token of fewer distinct characters is repetition (dashes, rulers); 20 random hexadecimal digits have about 12.
FEWEST = 6
#: Matches of one text that are handled together: work grows with matches to the power 1.5.
BLOCK = 256
#: Words of ordinary identifiers; samples join two to four of them in the usual styles.
WORDS = (
    "account action active add address all app array async auth average back base batch begin block body buffer build byte cache call "
    "center change channel check child class clean click client close code color column command compare config connect content context "
    "copy core count create current cursor data date debug default delete description detail device direct display document domain download "
    "element email empty enable encode end engine entry error event example execute export factory false field file filter first flag "
    "folder font format forward frame from function get global graph group handler hash header height helper history image import index "
    "info init input insert instance integer interface internal item iterator job join key label language last layer layout length level "
    "library line link list load local location lock logger login main manager map margin match matrix max memory menu message method "
    "middle min mode model module mouse move name native network next node note number object offset open operation option order output "
    "package page panel parent parse part path pattern pixel point pool position post prefix previous print process profile project property "
    "provider proxy public query queue random range read record refresh region register release remote remove render report request reset "
    "resource response result return root route row rule run sample save scale schema screen script scroll search section select self send "
    "server service session set shape shared size sort source space split stack start state static status stream string style submit suffix "
    "switch symbol system table target task template test text thread time title tool total track transform tree trigger true type unit "
    "update upload user valid value vector version view visible width window word worker wrapper write zone"
).split()

SPAN = "array<struct<s:int,o:int,e:int,k:string>>"


def labelled_samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """(text, secret): n random strings in four alphabets and n identifiers in four styles, from seeded hashes."""
    words, ids = F.array(*map(F.lit, WORDS)), spark.range(n)
    digest = F.unhex(F.sha2(F.concat(F.lit("random/"), "id").cast("binary"), 256))
    b64 = F.substring(F.base64(digest), 1, 40)
    random = F.when(F.col("id") % 4 == 0, F.substring(F.lower(F.hex(digest)), 1, 40)).when(F.col("id") % 4 == 1, F.translate(b64, "+/=", "xQ7")).when(F.col("id") % 4 == 2, F.translate(b64, "+/", "-_")).otherwise(b64)
    word = lambda i: F.get(words, F.pmod(F.xxhash64(F.lit("word"), F.lit(i), "id"), F.lit(len(WORDS))).cast("int"))
    parts = F.slice(F.array(*(word(i) for i in range(4))), 1, (F.col("id") % 3 + 2).cast("int"))
    styles = (F.array_join(parts, "_"), F.array_join(F.transform(parts, F.initcap), ""), F.array_join(parts, "-"), F.array_join(parts, "/"), F.upper(F.array_join(parts, "_")), F.array_join(parts, ""))
    name = styles[0]
    for i, s in enumerate(styles[1:], 1):
        name = F.when(F.pmod(F.xxhash64(F.lit("style"), "id"), F.lit(len(styles))) == i, s).otherwise(name)
    return ids.select(random.alias("text"), F.lit(1).alias("secret")).union(ids.select(name.alias("text"), F.lit(0).alias("secret")))


def steps(token: Column) -> Column:
    """Where each pair of neighbouring characters stands in the matrix."""
    at = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return let(at, lambda x: F.zip_with(F.slice(x, 1, F.length(token) - 1), F.slice(x, 2, F.length(token) - 1), lambda a, b: a * F.lit(WIDTH) + b))


def train(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """The log-likelihood ratio of each step, random over ordinary, row by row; from (text, secret), texts of two characters or more."""
    seen = samples.where(F.length("text") > 1).select("secret", F.explode(steps(F.col("text"))).alias("step"))
    counts = {(r["secret"], r["step"]): r["n"] for r in seen.groupBy("secret", "step").agg(F.count(F.lit(1)).alias("n")).collect()}  # 2 * WIDTH ** 2 at most

    def logs(label: int) -> list[float]:
        out = []
        for a in range(WIDTH):
            row = [counts.get((label, a * WIDTH + b), 0) + smoothing for b in range(WIDTH)]
            out += [math.log(x / sum(row)) for x in row]
        return out

    return [round(p - q, 4) for p, q in zip(logs(1), logs(0))]


def score(token: Column, model: list[float]) -> Column:
    """The mean log-likelihood ratio of all steps."""
    ratio = F.from_json(F.lit(json.dumps(model)), "array<double>")
    return F.aggregate(steps(token), F.lit(0.0), lambda a, s: a + F.get(ratio, s)) / (F.length(token) - 1)


def varied(token: Column) -> Column:
    """Whether the token is more than a repetition of few characters."""
    return F.size(F.array_distinct(F.split(token, ""))) >= FEWEST


def blocks(items: Column) -> Column:
    """items in runs of BLOCK: what would copy or scan all of them for each of them does so for a run only."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0)), F.lit(BLOCK)), lambda i: F.slice(items, i + 1, F.lit(BLOCK)))


def found(text: Column, kind: int, name: str, pattern: str, keep) -> Column:
    """Spans of the matches that keep(match, group 1) holds for. Positions: lengths of the pieces between matches, summed."""
    whole, group = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    gaps = F.split(text, pattern, -1)
    each = F.arrays_zip(gaps.alias("g"), whole.alias("w"), group.alias("v"))
    none = F.array().cast(SPAN)

    def step(a: Column, x: Column) -> Column:
        s = a["at"] + F.length(x["g"])
        e = s + F.length(x["w"])
        here = F.array(F.struct(s.alias("s"), F.lit(kind).alias("o"), e.alias("e"), F.lit(name).alias("k")))
        return F.when(x["w"].isNull(), a).otherwise(F.struct(e.alias("at"), F.when(keep(x["w"], x["v"]), F.concat(a["out"], here)).otherwise(a["out"]).alias("out")))

    def block(a: Column, xs: Column) -> Column:
        inner = F.aggregate(xs, F.struct(a["at"].alias("at"), none.alias("out")), step)
        return let(inner, lambda r: F.struct(r["at"].alias("at"), F.concat(a["out"], F.array(r["out"])).alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
    spans = let(each, lambda x: F.aggregate(blocks(x), start, block, lambda a: F.flatten(a["out"])))
    return F.when(text.rlike(pattern), spans).otherwise(none)


def apart(spans: Column, base: Column) -> Column:
    """The spans that overlap none of base."""
    runs = F.transform(F.filter(blocks(F.array_sort(base)), lambda x: F.size(x) > 0), lambda x: F.struct(F.get(x, F.lit(0))["s"].alias("s"), F.array_max(F.transform(x, lambda y: y["e"])).alias("e"), x.alias("of")))
    meets = lambda x, y: (x["s"] < y["e"]) & (y["s"] < x["e"])
    return F.when(F.size(base) == 0, spans).otherwise(let(runs, lambda r: F.filter(spans, lambda m: ~F.exists(r, lambda run: meets(run, m) & F.exists(run["of"], lambda b: meets(b, m))))))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan(docs: DataFrame, model: list[float] | None = None, least: int = 20, threshold: float = 0.7) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov of every row.

    model: what train() gives; by default of labelled_samples(). least: characters of a token that the models judge.
    """
    model = model or train(labelled_samples(docs.sparkSession))
    text = F.col("_t")
    df = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"))
    df = df.select("doc_id", "_t", *(found(text, i, k, p, lambda w, v, n=n: F.length(v) >= n).alias(f"_{k}") for i, (k, p, n) in enumerate(BASE)))
    token = r"((?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,})" % least
    df = df.withColumn("_m", found(text, len(BASE), "markov", token, lambda w, v: varied(w) & (score(w, model) > threshold)))
    df = df.select("doc_id", *(F.size(f"_{k}").cast("long").alias(f"n_{k}") for k, _, _ in BASE), F.concat("_assign", "_access", "_hex").alias("_base"), "_m")
    df = df.withColumn("_new", apart(F.col("_m"), F.col("_base")))
    return df.select("doc_id", *(f"n_{k}" for k, _, _ in BASE), F.sha2(joined(F.col("_base")).cast("binary"), 256).alias("base_sha256"), joined(F.concat("_base", "_new")).alias("spans"), F.size("_new").cast("long").alias("n_markov"))
