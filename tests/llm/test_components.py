"""Connected components against a union of sets."""

import random

import pytest

from custody.llm.work import connected_components


def union(edges):
    parent = {x: x for e in edges for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {x: top(x) for x in parent}


def drawn(nodes, edges):
    r = random.Random(nodes)
    return [(a, b) for a, b in ((r.randrange(nodes), r.randrange(nodes)) for _ in range(edges)) if a != b]


@pytest.mark.parametrize("edges", [
    [], [(1, 2)], [(2, 1), (1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)], [(99, i) for i in range(60)],
    [(-5, 3), (3, 9), (9, -7)], drawn(50, 30), drawn(200, 150), drawn(30, 200),
])
def test_components(spark, edges):
    rows = connected_components(spark.createDataFrame(edges, "a LONG, b LONG"), "a", "b", "id").collect()
    assert len(rows) == len({r.id for r in rows})
    assert {r.id: r.component_id for r in rows} == union(edges)
