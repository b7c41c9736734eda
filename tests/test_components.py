import random

import pytest

from kerbsight.operators.components import connected_components


def expected(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def path(n):
    return [(i, i + 1) for i in range(1, n)]


def shuffled_path(n, seed=5):
    order = list(range(1, n + 1))
    random.Random(seed).shuffle(order)
    return list(zip(order, order[1:]))


def star(n):
    return [(n, i) for i in range(1, n)]


def sparse(n, m, seed=6):
    rng = random.Random(seed)
    return [tuple(rng.sample(range(1, n + 1), 2)) for _ in range(m)]


@pytest.mark.parametrize(
    "n, edges",
    [
        (300, path(300)),
        (300, shuffled_path(300)),
        (400, star(400)),
        (400, sparse(400, 250)),
        (5, []),
    ],
    ids=["path", "shuffled path", "star", "sparse", "no edges"],
)
def test_components(spark, ws, n, edges):
    nodes = list(range(1, n + 1))
    both = edges + [(b, a) for a, b in edges]
    node_df = spark.createDataFrame([(i,) for i in nodes], "node long")
    edge_df = spark.createDataFrame(both, "a long, b long")
    got = connected_components(ws, node_df, edge_df).collect()
    assert {r["node"]: r["root"] for r in got} == expected(nodes, edges)
