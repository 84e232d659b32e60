"""Connected components against union-find."""

import random

import pytest

from stowage.llm.components import components


def union_find(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


@pytest.mark.parametrize("kind", ["chain", "star", "random", "loops", "none"])
def test_components(spark, kind):
    rnd = random.Random(7)
    edges = {
        "chain": [(n, n + 1) for n in rnd.sample(range(60), 55)],
        "star": [(50, n) for n in range(200)],
        "random": [(rnd.randrange(150), rnd.randrange(150)) for _ in range(110)] * 2,
        "loops": [(3, 3), (4, 5), (5, 4)],
        "none": [],
    }[kind]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {x: c for x, c in union_find(edges).items() if x != c}
    assert got == want
