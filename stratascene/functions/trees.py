"""Packed trees over points: rows in Morton order are cut into blocks of equally many, blocks into nodes, each with its bounds.

Blocks are as full wherever the points lie. A search goes down the levels by equi-joins of what is still open with the children's
bounds, and leaves out nodes that can't do better than what is known.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut

#: Points in a block, and children of a node.
BLOCK, FANOUT = 64, 16
#: Nodes that are broadcast, at most, and points that a target is held against without a tree.
BROADCAST, DIRECT = 4096, 512


def morton(coords: list[Column], low: list[float], high: list[float], bits: int) -> Column:
    """The Morton code of a place between two corners, ``bits`` a dimension."""
    code = F.lit(0).cast("long")
    for k, (c, lo, hi) in enumerate(zip(coords, low, high)):
        cell = F.least(F.lit((1 << bits) - 1), F.greatest(F.lit(0), F.floor((c - lo) / (hi - lo if hi > lo else 1.0) * ((1 << bits) - 1)))).cast("long")
        code = code.bitwiseOR(_spread(cell, len(coords), k, bits))
    return code


def _spread(cell: Column, dims: int, place: int, bits: int) -> Column:
    parts = [F.shiftleft(F.shiftright(cell, b).bitwiseAND(1), b * dims + place) for b in range(bits)]
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseOR(p)
    return out


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``number``, counted from 0 in an order; sorted in ranges, which are then counted, so that no task sees all rows."""
    marked = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()), "ordered")
    marked = marked.withColumn("__part", F.shiftright("__id", 33))
    counts = marked.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).drop("__n")  # a row for each range
    return marked.join(F.broadcast(before), "__part").withColumn("number", F.col("__before") + F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__id", "__part", "__before")


def packed(points: DataFrame, axes: tuple[str, ...], bits: int = 20, ordered: tuple[str, ...] | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """The points with their ``block``, and the levels from the top: ``node, parent`` and the bounds ``<axis>_lo, <axis>_hi``. The last level are the blocks.

    Blocks follow the Morton order of the axes ``ordered``, by default all.
    """
    ordered = ordered or axes
    bounds = points.agg(*(f(a) for a in ordered for f in (F.min, F.max)), F.count(F.lit(1))).first()
    low, high, n = list(bounds[:-1:2]), list(bounds[1:-1:2]), bounds[-1]
    rows = numbered(points.withColumn("__code", morton([F.col(a) for a in ordered], low, high, bits)), "__code", *axes)
    blocks = cut(rows.withColumn("block", F.floor(F.col("number") / BLOCK).cast("long")).drop("__code", "number"), "blocks")
    level = blocks.select(F.col("block").alias("node"), *(F.col(a).alias(f"{a}_{s}") for a in axes for s in ("lo", "hi")))
    levels, count = [], -(-n // BLOCK)
    while True:
        level = level.groupBy("node").agg(*(f(f"{a}_{s}").alias(f"{a}_{s}") for a in axes for s, f in (("lo", F.min), ("hi", F.max))))
        level = cut(level.withColumn("parent", F.floor(F.col("node") / FANOUT).cast("long")), "level")
        levels.insert(0, _small(level, count))
        if count <= FANOUT:
            return blocks, levels
        level, count = level.drop("node").withColumnRenamed("parent", "node"), -(-count // FANOUT)


def _small(frame: DataFrame, rows: int) -> DataFrame:
    """Marked for broadcasting if it has few rows, which have been counted."""
    return F.broadcast(frame) if rows <= BROADCAST else frame


def best_scores(targets: DataFrame, points: DataFrame, key: str, axes: tuple[str, ...], score: Callable[[dict[str, Column]], Column], bounds: Callable[[dict[str, tuple[Column, Column]]], tuple[Column, Column]], ordered: tuple[str, ...] | None = None) -> DataFrame:
    """``key, score``: for each target the highest score with any point; none where all scores are null.

    ``score`` takes the point's coordinates by axis, and columns of the targets. ``bounds`` takes the corners of a box of points: what their
    scores are at least (null if some may have none) and at most (null if all have none). A first way down takes the most promising child at each
    level; what its block scores spares the search most of the nodes.
    """
    distinct = cut(points.select(*axes).dropna().distinct(), "places")
    n = distinct.count()
    if n <= DIRECT:
        return targets.crossJoin(F.broadcast(distinct)).select(key, score({a: F.col(a) for a in axes}).alias("score")).groupBy(key).agg(F.max("score").alias("score")).where("score IS NOT NULL")
    blocks, levels = packed(distinct, axes, ordered=ordered)
    start = cut(targets.withColumn("node", F.lit(0).cast("long")), "targets")
    least, most = bounds({a: (F.col(f"{a}_lo"), F.col(f"{a}_hi")) for a in axes})
    children = [level.withColumnsRenamed({"node": "child", "parent": "node"}) for level in levels]
    scores = lambda open_: open_.join(blocks.withColumnRenamed("block", "node"), "node").select(key, score({a: F.col(a) for a in axes}).alias("score")).where("score IS NOT NULL")
    way = start
    for level in children:
        best = F.max(F.struct("__most", "child", *(F.col(c) for c in targets.columns if c != key))).alias("b")
        way = way.join(level, "node").withColumn("__most", most).where("__most IS NOT NULL").groupBy(key).agg(best).select(key, *(F.col(f"b.{c}").alias(c) for c in targets.columns if c != key), F.col("b.child").alias("node"))
    known = cut(scores(way).groupBy(key).agg(F.max("score").alias("score")), "known")
    open_ = start.join(known.withColumnRenamed("score", "__best"), key, "left")
    for level in children:
        seen = open_.join(level, "node").withColumns({"__least": least, "__most": most}).where("__most IS NOT NULL AND (__best IS NULL OR __most > __best)")
        seen = seen.withColumn("__known", F.max("__least").over(Window.partitionBy(key)))
        seen = cut(seen.select(*targets.columns, F.col("child").alias("node"), "__most", F.greatest("__best", "__known").alias("__best"), "__known"), "open")
        known = known.unionByName(seen.groupBy(key).agg(F.max("__known").alias("score")).where("score IS NOT NULL"))
        open_ = seen.where("__best IS NULL OR __most > __best").select(*targets.columns, "node", "__best")
    return known.unionByName(scores(open_)).groupBy(key).agg(F.max("score").alias("score"))
