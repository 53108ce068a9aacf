"""Components against union-find: chains, stars, cliques, hubs and loops."""

import random

import pytest

from skillweft.llm import common, components
from skillweft.llm.common import workspace


def truth(edges):
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for e in edges if e[0] != e[1] for x in e}


@pytest.mark.parametrize("limit", [500_000, 0])
def test_components(spark, monkeypatch, limit):
    monkeypatch.setattr(common.small, "__defaults__", (limit,))
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(100, 160)]
    rng.shuffle(chain)
    cases = [chain, [(7, x) for x in range(300, 400)], [(999, x) for x in range(300, 400)], [(a, b) for a in range(6) for b in range(6)], [(rng.randrange(-50, 50), rng.randrange(-50, 50)) for _ in range(60)], [(5, 5)], []]
    for edges in cases:
        df = spark.createDataFrame(edges, "a long, b long")
        rows = components.connected_components(df, workspace(spark, "t")).collect()
        assert len(rows) == len({r.node for r in rows})
        assert {r.node: r.component for r in rows} == truth(edges)
