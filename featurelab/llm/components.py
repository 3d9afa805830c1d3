"""Connected components of a large graph: alternating large-star and small-star steps until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, with_hot_keys, written


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)


def _least(edges: DataFrame) -> DataFrame:
    return written(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "cc-least")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for all nodes of edges (u, v: bigint). Loops and repeats do no harm; no
    edges give no rows.

    Neighbours are only ever reduced to their minimum, so no node's neighbourhood is gathered in one place, and the edges of
    a node with very many stay where they are when they learn that minimum. Each round is a table in the shared folder;
    rounds go on until the edges stay the same (their number grows with the logarithm of a component's size).
    """
    e = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = written(e, "cc")
    old, state = None, _state(e)
    while state != old:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _least(both)
        up = e.select(F.col("v").alias("u"), F.col("u").alias("v"))  # the neighbours above each node
        large = with_hot_keys(up, low.select("u", F.least("u", "m").alias("m"), "n"), ["u"], "n")
        large = written(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc-large")
        least = _least(large)
        small = with_hot_keys(large, least, ["u"], "n")
        nxt = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        nxt = written(nxt, "cc")
        old, state = state, _state(nxt)
        for t in (e, low, large, least):
            removed(t)
        e = nxt
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
