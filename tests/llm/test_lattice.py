"""E8 decoding, recall against brute force, and exact links among what is found."""

import numpy as np

from smframe.llm import lattice


def test_decode_is_the_nearest_of_the_neighbours():
    r = np.random.default_rng(0)
    x = r.normal(size=(400, 8)) * 2
    d = lattice.decode(x)
    twice = (2 * d).astype(int)
    assert ((twice % 2 == 0).all(1) | (twice % 2 != 0).all(1)).all() and (d.sum(1) % 2 == 0).all()
    assert len(np.unique(lattice.ROOTS, axis=0)) == 240
    for a, b in zip(x, d):
        assert ((a - b) ** 2).sum() <= ((a - b - lattice.ROOTS) ** 2).sum(1).min() + 1e-9


def vectors():
    r = np.random.default_rng(1)
    rows, k = [], 0
    for g in range(60):
        base = r.normal(size=64)
        base /= np.linalg.norm(base)
        for _ in range(r.integers(1, 12)):
            v = base + r.normal(size=64) * r.uniform(0.0, 0.02)
            rows.append((k, v.tolist(), int(g % 3)))
            k += 1
    rows += [(k + i, rows[5][1], rows[5][2]) for i in range(3)]
    return rows


def brute(rows, cosine):
    v = np.array([x[1] for x in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    lab = np.array([x[2] for x in rows])
    ok = (v @ v.T >= cosine) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(ok, False)
    return ok


def test_links_and_components(spark):
    rows = vectors()
    ok = brute(rows, 0.98)
    bad = [(1000, None, 1), (1001, [0.0] * 64, 1), (1002, [float("nan")] * 64, 1), (1003, rows[0][1], None), (1004, [1.0, None], 1), (1005, [], 1), (1006, [float("inf")] + [1.0] * 63, 1)]
    for block in (1024, 4):
        df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int").repartition(6)
        got = {r.vec_id: r for r in lattice.near_duplicates(df, block=block).collect()}
        assert len(got) == len(rows) + len(bad)
        assert all(got[b[0]].n_links == 0 and got[b[0]].kept and got[b[0]].component_id == b[0] for b in bad)
        n = np.array([got[i].n_links for i in range(len(rows))])
        assert (n <= ok.sum(1)).all() and n.sum() >= 0.9 * ok.sum(), (n.sum(), ok.sum())
        assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
        assert len({got[i].component_id for i in (5, len(rows) - 1, len(rows) - 2)}) == 1
    assert lattice.near_duplicates(df.limit(0)).count() == 0


def test_recall_at_the_threshold():
    r = np.random.default_rng(2)
    a = r.normal(size=(4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o = r.normal(size=(4000, 64))
    o -= (o * a).sum(1, keepdims=True) * a
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    b = 0.981 * a + np.sqrt(1 - 0.981**2) * o
    t = lattice.Tables(64, 8, 6, 4.5)
    p, q = t.codes(a), t.codes(b)
    found = ((p == q[:, :, :1]).any(2) | (q == p[:, :, :1]).any(2)).any(1).mean()
    s = t.codes(a[r.permutation(4000)])
    chance = ((p == s[:, :, :1]).any(2)).mean()
    print(found, chance)
    assert found > 0.98 and chance < 1e-3
