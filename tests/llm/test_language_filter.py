"""Language ID against sums over all segmentations; the filter audit against plain Python over all orders."""

import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from smframe.llm import filter_audit as fa
from smframe.llm import language_id as li

DOCS = "doc_id long, text string, lang string"


def segmentations(word, vocabulary):
    """All ways to cut a word into pieces; a character that is no piece is unknown."""
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        head = word[:k]
        if head in vocabulary or k == 1:
            for rest in segmentations(word[k:], vocabulary):
                yield [vocabulary.get(head, len(vocabulary)), *rest]


def test_forward_and_expected_counts_equal_all_segmentations():
    r, g = random.Random(1), np.random.default_rng(1)
    vocabulary = sorted({"".join(r.choice("ab" + li.MARK * (k == 0)) for k in range(n)) for n in (1, 2, 3, 4) for _ in range(8)} - {"b"})
    vocabulary = [v for v in vocabulary if li.MARK not in v[1:]]
    index = {v: k for k, v in enumerate(vocabulary)}
    log_p = np.log(g.dirichlet(np.ones(len(vocabulary) + 1), 3).T)
    words = ["", "a", "b", "ab", "abba", "xay", "aaaaaaa", *("".join(r.choice("abc") for _ in range(r.randint(1, 9))) for _ in range(30))]
    lattice = li.Lattice(li.Trie.of(vocabulary), words, len(vocabulary))
    got = lattice.scores(log_p)
    each = np.array([0] * len(lattice.word))
    uses = np.zeros((len(words), len(vocabulary) + 1))
    np.add.at(uses, (lattice.word, lattice.piece), lattice.expected(log_p[lattice.piece, each]))
    for k, w in enumerate(words):
        ways = [*segmentations(li.MARK + w, index)]
        p = [sum(math.exp(sum(log_p[i, x] for i in way)) for way in ways) for x in range(3)]
        assert np.allclose(got[k], np.log(p))
        want = np.zeros(len(vocabulary) + 1)
        for way in ways:
            np.add.at(want, way, math.exp(sum(log_p[i, 0] for i in way)) / p[0])
        assert np.allclose(uses[k], want)
    model = li.Model(["x", "y", "z"], np.zeros(3), log_p, li.Trie.of(vocabulary))
    assert np.allclose(li.Scorer(model)._short(words), got)


def test_very_long_words_and_runs_of_words_do_not_change_scores():
    path = public_tokenizers.path(li.VOCABULARY)
    vocabulary = li.pieces(path)
    log_p = np.full((len(vocabulary) + 1, 1), -np.log(len(vocabulary) + 1))
    model = li.Model(["x"], np.zeros(1), log_p, li.Trie.of(vocabulary))
    text = " ".join(["the", "a" * 3000, "löwe", "日本"] * 50)
    whole, short = li.Scorer(model), li.Scorer(model, remembered=2)
    a, b = whole.score([text]), short.score([text], 7)
    assert np.allclose(a, b) and np.allclose(a, 50 * whole.score(["the " + "a" * 3000 + " löwe 日本"])) and np.isfinite(a).all()
    many = ["", "the", text, "löwe the"]
    assert np.allclose(whole.score(many), [whole.score([t])[0] for t in many]) and np.allclose(whole.score(many, 3), whole.score(many))


def test_held_out_accuracy_and_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = li.fit(docs, public_tokenizers.path(li.VOCABULARY))
    assert model.languages == ["de", "en", "es", "fr"]
    rows = li.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == docs.count() and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held) and all(0 <= r["score"] <= 1 for r in rows)
    odd = spark.createDataFrame([(1, None, "en", 7), (2, "", "en", 7), (3, "12 --- 34!", None, 7), (None, "the and of", "xx", 7), (4, "le la les des", None, 7), (4, "le la les des", None, 7), (5, "x" * 50_000, None, 7)], DOCS + ", `a.b` int")
    got = sorted(((r["doc_id"] or 0, r["lang_pred"], round(r["score"], 9)) for r in li.predict(odd, model).collect()))
    assert [g[1] for g in got] == ["en", "und", "und", "und", "fr", "fr", got[-1][1]] and got[4] == got[5] and got[-1][1] in model.languages
    assert all(g[2] == 0 for g in got[1:4])
    # nothing to learn from: no lang, or held out only
    none = li.fit(odd.where("lang is null"), public_tokenizers.path(li.VOCABULARY))
    assert none is None and {r["lang_pred"] for r in li.predict(odd, none).collect()} == {"und"}
    empty = spark.createDataFrame([], DOCS)
    assert li.fit(empty, public_tokenizers.path(li.VOCABULARY)) is None and li.predict(empty, model).collect() == []


def test_held_out_rows_teach_nothing(spark):
    """A label of a held-out row changes no model."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    other = docs.selectExpr("doc_id", "text", "case when crc32(cast(doc_id as string)) % 4 = 2 then 'zz' else lang end as lang")
    path = public_tokenizers.path(li.VOCABULARY)
    a, b = li.fit(docs, path), li.fit(other, path)
    assert a.languages == b.languages and (a.log_p == b.log_p).all() and (a.prior == b.prior).all()


def plain_audit(docs, labels):
    """The contract, row by row and order by order."""
    low = {}
    for i, text, _ in docs:
        if i is not None:
            low[text or ""] = min(i, low.get(text or "", i))
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    fails = []
    for i, text, lang in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 100, "B": 100 * len({*w}) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and t in low and i > low[t]}
        fails.append((lang or "", {x for x in f if f[x]}, i in good if i is not None else False, i in toxic if i is not None else False))
    out = {}
    for part in {x[0] for x in fails}:
        own = [x for x in fails if x[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, f in enumerate(order):
                before = {*order[:k]}
                gone = [x for x in own if f in x[1] and not x[1] & before]
                total[f] += len(gone)
                out[part, order, k + 1] = [sum(not x[1] & (before | {f}) for x in own), len(gone), sum(f in x[1] and bool(x[1] & before) for x in own), sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(total[order[k - 1]])
    return out


@pytest.mark.parametrize("repeat", [1, 40])
def test_audit_equals_plain_python(spark, repeat):
    r = random.Random(3)
    words = [f"w{k}" for k in range(400)] + ["ABC", "#x", "É", "a|b"]
    texts = [None, "", " \t\n ", "THE END", "a" * 5000] + [" ".join(r.choices(words[: r.choice([20, 200, 404])], k=r.choice([5, 99, 100, 150, 3000]))) for _ in range(40)]
    docs = [(r.choice([k, k, k, None]), r.choice(texts), r.choice(["en", "de", None, ""])) for k in range(150)]
    docs += [docs[7]] * repeat + [(docs[9][0], docs[9][1], "de"), (docs[9][0], "other", "en")]
    labels = [(k, r.choice([0, 1, None]), r.choice([0, 1])) for k in range(0, 150, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "'x' as part", "1 as d1", "2 as mask", "3 as words", "4 as n", "5 as `a.b`").repartition(3)
    got = fa.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = plain_audit(docs, labels)
    assert len(got) == len(want) and {(x["part"], x["filter_order"], x["step"]): [*x[3:]] for x in got} == want


def test_audit_of_repeated_rows_in_several_files(spark, tmp_path):
    rows = [(1, "one two two", "en"), (2, "one two two", "en")] * 3
    spark.createDataFrame(rows, DOCS).repartition(5).write.parquet(str(tmp_path / "d"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = fa.audit(spark.read.parquet(str(tmp_path / "d")), labels).collect()
    assert {(x["part"], x["filter_order"], x["step"]): [*x[3:]] for x in got} == plain_audit(rows, [])


def test_audit_of_an_empty_table(spark):
    assert fa.audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []
