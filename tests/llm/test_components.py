"""Connected components against union-find."""

import random

from millrace.llm.common import Scratch
from millrace.llm.components import connected


def test_random_graphs(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(90), rng.randrange(90)) for _ in range(60)] + [(-7, 500 + i) for i in range(40)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        if u is not None and u != v:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    out = connected(spark.createDataFrame(edges, "u BIGINT, v BIGINT"), Scratch(spark, "test")).collect()
    assert {r.node: r.component for r in out} == {x: find(x) for x in root}
    bounded = connected(spark.createDataFrame(edges, "u BIGINT, v BIGINT"), Scratch(spark, "test"), most_edges=len(edges)).collect()
    assert sorted(bounded) == sorted(out)
    assert connected(spark.createDataFrame([], "u BIGINT, v BIGINT"), Scratch(spark, "test")).count() == 0
