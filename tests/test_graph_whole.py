"""Shortest loopless paths and centralities against enumeration."""

import itertools
import random

import pytest

from featurelab.operators import graph


def some_edges(n, m, seed):
    rnd = random.Random(seed)
    return sorted({(f"n{a}", f"n{b}") for a, b in ((rnd.randrange(n), rnd.randrange(n)) for _ in range(m)) if a != b})


def all_paths(edges, source, target):
    after, out = {}, []
    for a, b in edges:
        after.setdefault(a, []).append(b)

    def walk(path):
        for x in after.get(path[-1], []):
            if x == target:
                out.append([*path, x])
            elif x not in path:
                walk([*path, x])

    walk([source])
    return sorted(out, key=lambda p: (len(p), p))


@pytest.mark.parametrize("seed", [1, 2])
def test_shortest_loopless_paths(spark, seed):
    edges = some_edges(8, 22, seed)
    df = spark.createDataFrame(edges, "src string, dst string")
    every = {t: all_paths(edges, "n0", t) for t in ("n3", "n7")}
    assert [r["path"] for r in graph.simple_paths(df, "n0", "n3", 6).collect()] == every["n3"][:6]
    got = {}
    for r in graph.paths_to(df, "n0", ["n3", "n7", "gone"], 4, 3).collect():
        got.setdefault(r["target"], []).append(list(r["path"]))
    assert got == {t: short for t, paths in every.items() if (short := [p for p in paths if len(p) <= 4][:4])}


def test_a_dense_graph_is_not_enumerated(spark):
    """Layers of 6 nodes: 6^7 paths, all of one length."""
    layers = [["s"], *[[f"a{i}{j}" for j in range(6)] for i in range(7)], ["t"]]
    edges = [e for a, b in itertools.pairwise(layers) for e in itertools.product(a, b)]
    got = [r["path"] for r in graph.simple_paths(spark.createDataFrame(edges, "src string, dst string"), "s", "t", 2).collect()]
    assert got == [["s", *[f"a{i}0" for i in range(7)], "t"], ["s", *[f"a{i}0" for i in range(6)], "a61", "t"]]


@pytest.mark.parametrize("batches", [None, 3])
def test_betweenness_by_levels(spark, batches):
    df = spark.createDataFrame(some_edges(12, 30, 5), "src string, dst string")
    want = {r["node"]: r["centrality"] for r in graph.betweenness(df).collect()}
    assert {r["node"]: r["centrality"] for r in graph.betweenness_by_levels(df, batches).collect()} == pytest.approx(want) and max(want.values()) > 0
    assert {r["node"]: r["centrality"] for r in graph.betweenness(df, 5).collect()} == pytest.approx(want)
