"""Distributed union-find against a plain one."""

import random

from smframe.llm.common import components


def plain(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components_equal_union_find(spark):
    r = random.Random(0)
    shapes = {
        "path": [(i, i + 1) for i in range(200)],
        "star": [(i, 7) for i in range(300) if i != 7],
        "random": [(r.randrange(600), r.randrange(600)) for _ in range(450)],
        "shuffled path": [*zip(p := r.sample(range(1000), 300), p[1:])],
        "loops": [(3, 3), (5, 6), (6, 5)],
    }
    for name, edges in shapes.items():
        got = {x.id: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {k: v for k, v in plain(e for e in edges if e[0] != e[1]).items()}, name
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
