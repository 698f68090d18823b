"""PartEnum finds every link that brute force finds."""

import os
import random

import numpy as np
import pytest

from smframe.llm import ngram_join as nj


def test_similar_sets_share_a_signature():
    r = np.random.default_rng(0)
    for percent in (80, 90):
        for n in [*range(1, 60), 100, 237, 1000, 5000]:
            for _ in range(6):
                s = np.unique(nj.mix(r.integers(0, 1 << 62, n).astype(np.uint64)))
                # as many removals and additions as the threshold allows
                k = int(r.integers(0, max(1, n * (100 - percent) // percent) + 1))
                gone = int(r.integers(0, k + 1))
                t = np.unique(np.concatenate((s[r.permutation(len(s))[gone:]], nj.mix(r.integers(0, 1 << 62, k - gone).astype(np.uint64)))))
                both = len(np.intersect1d(s, t))
                if len(t) and 100 * both >= percent * (len(s) + len(t) - both):
                    assert np.intersect1d(nj.signatures(s, percent), nj.signatures(t, percent)).size, (percent, n, k)


def test_size_classes_tile_the_sizes():
    last = 0
    for n in range(1, 3000):
        c, lo, hi = nj.size_class(n)
        assert lo <= n <= hi and (lo == 1 or nj.size_class(lo - 1)[0] == c - 1)


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for _ in range(25):
        base = [r.choice(words) for _ in range(r.choice([0, 1, 2, 3, 5, 12, 40, 150, 400]))]
        for _ in range(r.choice([1, 2, 5, 14])):
            d = [*base]
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                if d:
                    d[r.randrange(len(d))] = r.choice(words)
            docs.append(" ".join(w.upper() if r.random() < 0.1 else w for w in d))
    return docs


def brute(docs, words, percent):
    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())

    s = [grams(t) for t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(s)):
        for j in range(i):
            x = len(s[i] & s[j])
            if s[i] and s[j] and 100 * x >= percent * len(s[i] | s[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(len(s[i]), find(i)) for i in range(len(s))]


@pytest.mark.parametrize("words,percent,block,most", [(3, 90, 1024, 256), (5, 80, 1024, 256), (3, 80, 2, 2), (2, 50, 3, 1)])
def test_components_equal_brute_force(spark, words, percent, block, most):
    docs = [*corpus(words + block), None, "", " \n"]
    rows = [(i, t, 7) for i, t in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.join(df, words, percent, block, most).collect()}
    want = dict(enumerate(brute(docs, words, percent)))
    assert got == want


def test_shared_passage_and_chain(spark):
    """Documents that share a passage stay apart; a chain of edits is one component, though its ends are not similar."""
    r = random.Random(4)
    word = lambda: f"w{r.randrange(10**6)}"
    passage = [word() for _ in range(60)]
    docs = [" ".join([word() for _ in range(60)] + passage + [word() for _ in range(60)]) for _ in range(120)]
    link = [word() for _ in range(150)]
    for _ in range(40):
        link = [*link]
        at = r.randrange(145)
        link[at : at + 5] = [word() for _ in range(5)]
        docs.append(" ".join(link))
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(6)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in nj.join(df, 3, 90, 4, 3).collect()}
    assert got == dict(enumerate(brute(docs, 3, 90)))


def test_repeated_and_null_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(90))
    rows = [(1, a), (1, b), (1, b), (2, a), (3, b), (None, a), (None, None), (4, "")]
    got = nj.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and sorted(r.n_shingles for r in got) == [0, 0, 38, 38, 38, 88, 88, 88]
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert {r.doc_id for r in got if r.component_id == 1} == {1, 2, 3}  # the links of both its texts


def test_links_of_all_texts_of_an_id(spark):
    """Random documents of several texts each, against union-find over all pairs of texts."""
    docs = [t for t in corpus(11) if t]
    r = random.Random(2)
    rows = [(r.randrange(len(docs) // 2), t) for t in docs]
    got = {x.doc_id: x.component_id for x in nj.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 3, 80).collect()}
    parts = brute([t for _, t in rows], 3, 80)
    root = {i: i for i, _ in rows}
    find = lambda k: k if root[k] == k else find(root[k])
    by: dict[int, int] = {}
    for (i, _), (_, c) in zip(rows, parts):
        a, b = find(i), find(by.setdefault(c, i))
        root[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in root}


def test_few_empty_cells_are_left_out():
    r = np.random.default_rng(1)
    s = np.unique(nj.mix(r.integers(0, 1 << 62, 400).astype(np.uint64)))
    k = nj.size_class(len(s))[2] * 20 // 80
    assert len(nj.signatures(s, 80)) < 2 * (k + 1 + nj.spare(k))


def test_representatives_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (3, None, "z"), (4, "", "z")], "doc_id long, text string, sig string")
    assert sorted(r.doc_id for r in nj.representatives(df).collect()) == [1, 3, 4]
    assert nj.join(df.limit(0)).count() == 0


def test_a_cluster_just_below_the_threshold_sends_few_pairs(spark, monkeypatch):
    """150 edits of one text, each two at 0.85: their 11,175 pairs stay in the tasks that hold sketches. One link among them is found."""
    from smframe.llm import links

    r = random.Random(6)
    base = [f"w{r.randrange(10**6)}" for _ in range(402)]
    docs = []
    for k in range(150):
        d = [*base]
        at = r.randrange(388)
        d[at : at + 14] = [f"e{k}x{j}" for j in range(14)]
        docs.append(" ".join(d))
    docs.append(docs[77] + " more")
    sent, verified = [], links.verified
    monkeypatch.setattr(links, "verified", lambda pairs, *a: sent.append(pairs.count()) or verified(pairs, *a))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in nj.join(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(brute(docs, 3, 90))) and got[150][1] == got[77][1]
    assert sum(sent) < 1500, sent


def test_sketches_bound_the_differences_at_any_width():
    from smframe.llm import links

    r = np.random.default_rng(3)
    for _ in range(200):
        n, k = int(r.integers(1, 3000)), int(r.integers(0, 400))
        s = np.unique(nj.mix(r.integers(0, 1 << 62, n).astype(np.uint64)))
        t = np.unique(np.concatenate((s[min(k, n - 1) :], nj.mix(r.integers(0, 1 << 62, k).astype(np.uint64)))))
        x, y = (np.frombuffer(links.sketch(v), np.uint64)[None] for v in (s, t))
        w = min(x.shape[1], y.shape[1])
        d = int(np.bitwise_count(links.folded(x, w) ^ links.folded(y, w)).sum())
        true = len(np.setxor1d(s, t))
        assert d <= true and (d > 0.8 * true or true > len(s) / 4 or true < 20)


def test_signatures_meet_in_turns_and_go_before_texts_are_read(spark, monkeypatch):
    """What takes most of the disk never lies there at once: parts of the signatures, and the texts after all of them."""
    r = random.Random(8)
    base = [" ".join(r.choice("abcdefghij") + str(r.randrange(500)) for _ in range(60)) for _ in range(20)]
    rows = [(k, base[k % 20] + (" more" if k % 3 else "")) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made, left = [], []

    def watched(df, keep=nj.stored):
        if df.columns == ["id", "text"]:
            left.extend(p for p, columns in made if "sig" in columns and os.path.exists(p))
        out = keep(df)
        made.append((out.stored_at.removeprefix("file:"), df.columns))
        return out

    monkeypatch.setattr(nj, "stored", watched)
    got = sorted(map(tuple, nj.join(docs, 3, 90).collect()))
    assert any("sig" in columns for _, columns in made) and not left
    assert {c for _, _, c in got} == {*range(20)} and all(c == i % 20 for i, _, c in got)
    assert got == sorted(map(tuple, nj.join(docs, 3, 90, turns=1).collect()))
