import random

from mullion.llm.common import connected_components


def test_random_graphs(spark):
    rng = random.Random(4)
    for n, k in ((40, 20), (60, 80), (30, 29)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(k)] + [(7, 7)]
        up = {x: x for e in edges for x in e}

        def find(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in edges:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
        got = connected_components(spark.createDataFrame(edges, "a bigint, b bigint"))
        assert {r.node: r.component for r in got.collect()} == {x: find(x) for x in up}


def test_path_and_empty(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(50)], "a bigint, b bigint")
    assert {r.component for r in connected_components(path).collect()} == {0}
    assert connected_components(path.where("false")).count() == 0
    assert [tuple(r) for r in connected_components(spark.createDataFrame([(4, 4)], "a bigint, b bigint")).collect()] == [(4, 4)]
