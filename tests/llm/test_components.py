import random

import pytest

from kinetrace.llm import components as C
from kinetrace.llm.common import Workspace


@pytest.mark.parametrize("one_task", [100_000, 0])
def test_equals_union_find(spark, monkeypatch, one_task):
    monkeypatch.setattr(C, "ONE_TASK", one_task)
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 90)] + [(5, 5), (1003, 1002)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    got = {r.node: r.component for r in C.components(df, Workspace(spark, "c"), "t").collect()}
    assert got == {x: root(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
    assert C.components(df.limit(0), Workspace(spark, "c"), "t").collect() == []
