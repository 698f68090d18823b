"""Line dedup against brute force over all pairs of lines."""

import random

import numpy as np

from smframe.llm import line_dedup as ld

def grams(line):
    return {line[i : i + 5] for i in range(max(1, len(line) - 4))}


def brute(docs, percent=80):
    at = [(i, p, x) for i, t in sorted(docs) for p, x in enumerate((t or "").split("\n")) if x.strip()]
    s = [grams(x) for _, _, x in at]
    root = list(range(len(at)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(at)):
        for j in range(i):
            if 100 * min(len(s[i]), len(s[j])) < percent * max(len(s[i]), len(s[j])):
                continue
            x = len(s[i] & s[j])
            if 100 * x >= percent * (len(s[i]) + len(s[j]) - x):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    gone = {(at[i][0], at[i][1]) for i in range(len(at)) if find(i) != i}
    return {i: t if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in docs}


def corpus(seed, n=60):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 14))) for _ in range(300)]
    pool = [" ".join(r.choice(words) for _ in range(r.choice([1, 3, 12, 40]))) for _ in range(60)]
    docs = []
    for i in range(n):
        out = []
        for _ in range(r.randrange(0, 8)):
            x = r.choice(pool).split(" ")
            for _ in range(r.choice([0, 0, 1, 2])):
                x[r.randrange(len(x))] = r.choice(words)
            out.append(r.choice(["", " ", "\t"]) if r.random() < 0.1 else " ".join(x))
        docs.append((i, "\n".join(out)))
    return [*docs, (n, None), (n + 1, ""), (n + 2, "\n\n"), (n + 3, "same\nsame\nsame"), (n + 4, "z" * 3000)]


def test_equals_brute_force(spark):
    same = total = 0
    for seed in (1, 2):
        docs = corpus(seed)
        df = spark.createDataFrame([(i, t, 9) for i, t in docs], "doc_id long, text string, n_lines int").repartition(4)
        got = {r.doc_id: r.text for r in ld.dedup(df).collect()}
        want = brute(docs)
        assert got.keys() == want.keys()
        kept = lambda x: (x or "").split("\n")
        same += sum(len({*kept(got[i])} & {*kept(want[i])}) for i in want)
        total += sum(len({*kept(got[i])} | {*kept(want[i])}) for i in want)
        # exact copies never survive, and what goes is always a real link
        left = [x for t in got.values() for x in kept(t) if x.strip()]
        assert len(left) == len({*left})
    assert same >= 0.97 * total, (same, total)


def test_blocks_find_links_past_the_least_line(spark):
    docs = corpus(7, 40)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    small, large = (ld.line_components(df, block=b, most=b).count() for b in (1, 10_000))
    assert small == large


def test_null_ids_repeats_and_empty_tables(spark):
    rows = [(None, "alpha beta gamma"), (1, "alpha beta gamma\nother line here"), (1, "alpha beta gamma\nother line here"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text or "", r.n_removed) for r in ld.dedup(df).collect())
    assert got == [(0, "alpha beta gamma", 0), (1, "other line here", 1), (1, "other line here", 1), (2, "", 0)]
    assert ld.dedup(df.limit(0)).count() == 0


def test_near_copies_by_overlapping_shingles_are_linked(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(r.randrange(2, 9)))
    rows = []
    for i in range(400):
        line = " ".join(word() for _ in range(r.choice([10, 12, 15])))
        at = r.randrange(len(line))
        rows.append((i, line, line[:at] + "#" + line[at + 1 :]))
    near = {i for i, x, y in rows if 100 * len(grams(x) & grams(y)) >= 80 * len(grams(x) | grams(y))}
    got = {x.doc_id: x.n_removed for x in ld.dedup(spark.createDataFrame([(i, f"{x}\n{y}") for i, x, y in rows], "doc_id long, text string")).collect()}
    assert len(near) > 300 and sum(got[i] for i in near) >= 0.94 * len(near)
    assert all(got[i] == 0 for i in range(400) if i not in near)


def test_shingles_are_all_runs_of_five_characters():
    lines = ["abc", "abcde", "ab cd ef", "xé日🙂 yz wé日🙂 y", "z" * 3000, "a", "abca"]
    sets = [*ld.sets_of(lines)]
    assert [len(s) for s in sets] == [len(grams(x)) for x in lines]
    assert [len(np.intersect1d(sets[1], s)) for s in sets] == [len(grams(lines[1]) & grams(x)) for x in lines]
    # a line's hashes depend on nothing beside it
    alone = np.concatenate([ld.bands([x]) for x in lines])
    assert (ld.bands(lines) == alone).all() and len({*alone[:, 0].tolist()}) == len(lines)


def test_bands_find_pairs_at_the_threshold():
    r = np.random.default_rng(2)
    found = total = 0
    while total < 400:
        line = "".join(map(chr, r.integers(97, 123, int(r.integers(60, 300)))))
        other = [*line]
        for at in r.integers(0, len(line), len(line) // 46):
            other[at] = "#"
        other = "".join(other)
        x, y = grams(line), grams(other)
        if 80 <= 100 * len(x & y) / len(x | y) <= 84:
            found, total = found + bool((ld.bands([line]) == ld.bands([other])).any()), total + 1
    assert found >= 0.97 * total, found


def test_all_pairs_of_the_smallest_table(spark):
    """Recall against brute force over all lines of the given documents at sf0.001; extra columns pass."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = [(r.doc_id, r.text) for r in df.collect()]
    got = {r.doc_id: r for r in ld.dedup(df).collect()}
    want = brute(docs)
    kept = lambda x: (x or "").split("\n")
    n = sum(len(kept(t)) for _, t in docs)
    gone, due = n - sum(len(kept(r.text)) for r in got.values()), n - sum(len(kept(t)) for t in want.values())
    assert due > 20 and 0.97 * due <= gone <= due
    assert all(set(kept(want[i])) <= set(kept(r.text)) for i, r in got.items()) and got[docs[0][0]].source is not None


def test_callers_columns_keep_their_values_and_long_texts_are_linear(spark):
    rows = [(1, "\n".join(["the same line of text"] * 30_000 + ["another"]), *range(5, 12)), (2, "another", *range(5, 12))]
    df = spark.createDataFrame(rows, "doc_id long, text string, _k int, _gone int, _doc int, _rk int, _row int, `a.b` int, c int")
    got = {r.doc_id: r for r in ld.dedup(df).collect()}
    assert got[1].text == "the same line of text\nanother" and got[1].n_removed == 29_999 and got[2].text == ""
    assert all(tuple(r)[2:9] == tuple(range(5, 12)) for r in got.values())


def test_no_python_runs_on_executors_and_hashes_equal_numpy(spark):
    r = random.Random(11)
    line = lambda n: "".join(r.choice("abcdefghijklmnop é日🙂") for _ in range(n)).strip() or "a"
    texts = sorted({line(n) for n in (*range(1, 45), 100, 1000, 20_000)})
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    banded = ld.banded(df)
    for plan in (banded, ld.dedup(df), ld.verified(spark.range(3).selectExpr("id a", "id b"), ld.unique(df), 80, 4)):
        assert not any(x in plan._jdf.queryExecution().toString() for x in ("InArrow", "InPandas", "PythonUDF", "EvalPython"))
    got = {x.text: x.bands for x in banded.join(ld.unique(df), "id").collect()}
    assert [got[x] for x in texts] == ld.bands(texts).tolist()
    sets = {x.text: x.s for x in df.select("text", ld.shingles_of(df["text"]).alias("s")).collect()}
    assert all(sorted(sets[x]) == np.sort(s.view(np.int64)).tolist() for x, s in zip(texts, ld.sets_of(texts)))


def test_no_job_of_line_dedup_runs_python(spark, monkeypatch):
    def stop(*_, **__):
        raise AssertionError("Python on the executors")

    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(type(spark.range(1)), name, stop)
    df = spark.createDataFrame(corpus(3, 40), "doc_id long, text string")
    assert ld.dedup(df).where("n_removed > 0").count() > 0


def test_sketches_bound_differences_and_pairs_of_a_group_meet_once(spark):
    rows = corpus(9, 40)
    texts = ld.unique(spark.createDataFrame(rows, "doc_id long, text string"))
    line = {x.id: x.text for x in texts.collect()}
    members = ld.sketched(texts).selectExpr("*", "id as c", "'g' as s")
    for block in (3, 1000):
        met = ld.meeting(ld.dealt(members, "s", block), 80).collect()
        assert len(met) == len({*met}) and all(x.a > x.b for x in met)
        s = {i: grams(x) for i, x in line.items()}
        near = {(a, b) for a in s for b in s if a > b and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])}
        assert near and near <= {(x.a, x.b) for x in met} and len(met) < len(s) * (len(s) - 1) / 2
