import random

import pytest

from grove.llm.components import components


def plain(edges):
    top = {}
    find = lambda x: x if top.setdefault(x, x) == x else find(top[x])
    for a, b in edges:
        u, v = sorted((find(a), find(b)))
        top[v] = u
    return {x: find(x) for x in top}


@pytest.mark.parametrize("kind", ["path", "shuffled path", "stars", "random", "loops"])
def test_against_union_find(spark, kind):
    rng = random.Random(1)
    ids = list(range(60))
    if kind == "shuffled path":
        rng.shuffle(ids)
    edges = {
        "stars": [(h, 100 * h + i) for h in (3, 5) for i in range(40)] + [(301, 502)],
        "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(60)],
        "loops": [(1, 1), (2, 3), (3, 2), (3, 2)],
    }.get(kind) or list(zip(ids, ids[1:]))
    got = {r.id: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == plain([e for e in edges if e[0] != e[1]])


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
