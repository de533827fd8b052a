"""Connected components by alternating stars: every round is two shuffles, and rounds grow with the logarithm of a chain's length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage_table


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` from ``u, v``: the root is the smallest node that the node reaches. Each node of an edge is in the result.

    A large star hangs each node's larger neighbours on its smallest one; a small star does so with the smaller ones. The edges
    stay as many, whatever the size of a component, so that a component of any size is a star in the end. Each round is written
    to the shared folder.
    """
    edges = stage_table(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(edges)
    while state[0]:
        sym = _both_ways(edges)
        least = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select("v", "m").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stage_table(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = _state(after)
        edges = after
        if now == state:
            break
        state = now
    return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
