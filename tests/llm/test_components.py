import random

from corpuslane.llm.components import components
from conftest import rows


def test_components(spark):
    random.seed(1)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)] + [(5, 5), (None, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    want = sorted((x, min(y for y in parent if root(y) == root(x))) for x in parent)
    assert rows(components(spark.createDataFrame(edges, "u long, v long"))) == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
