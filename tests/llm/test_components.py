import random

from tessera.llm.common import work_dir
from tessera.llm.components import components


def test_components_of_chains_stars_and_noise(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)]
    edges += [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(5, 5), (7, 6)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    want = {x: root(x) for a, b in edges if a != b for x in (a, b)}
    df = spark.createDataFrame(edges, "a long, b long")
    found = {r.v: r.label for r in components(df, work_dir(spark, "test"), "c").collect()}
    assert found == want


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long"), work_dir(spark, "test"), "c").count() == 0
