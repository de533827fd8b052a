"""Density clustering of each object's points as plans: neighbours on a grid, components of core points, the largest cluster.

Points at one place count as one with a weight. Objects of up to ``SMALL`` places, of which a task holds some at a time, are clustered in Arrow batches; nothing of
a larger one meets in one task. Pairs of those grow with the square of what is in a cell as wide as ``eps``; ``denoised`` bounds that by taking one point a voxel first.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from .graph import components

_AXES = ("x", "y", "z")
#: Half of the cells about one, so that each pair of cells meets once.
_AHEAD = [d for d in itertools.product((-1, 0, 1), repeat=3) if d >= (0, 0, 0)]

#: Places of an object that is clustered in one batch, at most, and pairs of places that are held at once.
SMALL, PAIRS = 512, 2_000_000


def _clustered(start: np.ndarray, size: np.ndarray, xyz: np.ndarray, w: np.ndarray, pt: np.ndarray, eps: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Clusters of the places of whole objects, and whether they are in one; ``start`` and ``size`` are those of each place's object."""
    n = len(w)
    a = np.repeat(np.arange(n), size)
    b = start[a] + np.arange(len(a)) - np.repeat(np.cumsum(size) - size, size)
    d2 = sum(((xyz[a, k] - xyz[b, k]) * (xyz[a, k] - xyz[b, k]) for k in range(3)), np.zeros(len(a)))
    near = d2 <= eps * eps
    a, b, d2 = a[near], b[near], d2[near]
    core = np.bincount(a, w[b], n) >= least
    cluster, found = np.zeros(n, dtype=np.int64), core.copy()
    inner = core[a] & core[b]
    if inner.any():
        i, j = a[inner], b[inner]  # each core point is near itself, and i is sorted
        first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        label = np.arange(n)
        while True:
            after = label.copy()
            after[i[first]] = np.minimum.reduceat(label[j], first)
            after = after[after]
            if (after == label).all():
                break
            label = after
        name = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(name, label[core], pt[core])
        cluster[core] = name[label[core]]
        border = ~core[a] & core[b]
        i, j, d = a[border], b[border], d2[border]
        order = np.lexsort((pt[j], d, i))
        i, j = i[order], j[order]
        first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else i
        cluster[i[first]], found[i[first]] = cluster[j[first]], True
    return cluster, found


def _small_clusters(spots: DataFrame, eps: float, least: int) -> DataFrame:
    """``obj_id, x, y, z, cluster`` of the places of objects with up to ``SMALL`` of them that are in a cluster."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for f in itertools.chain(frames, [None]):
            if f is not None:
                f = f if rest is None else pd.concat((rest, f), ignore_index=True)
                last = int((f["obj_id"] != f["obj_id"].iloc[-1]).sum()) if len(f) else 0  # rows are sorted; the last object may go on
                f, rest = f.iloc[:last], f.iloc[last:]
            else:
                f, rest = rest, None
            if f is None or not len(f):
                continue
            obj = f["obj_id"].to_numpy()
            ends = np.r_[np.flatnonzero(obj[1:] != obj[:-1]) + 1, len(obj)]
            sizes = np.diff(np.r_[0, ends])
            part = np.cumsum(sizes * sizes) // PAIRS
            xyz, w, pt = f[list(_AXES)].to_numpy(dtype=float), f["w"].to_numpy(dtype=float), f["pt"].to_numpy(dtype=np.int64)
            for k in np.unique(part):
                own, low = sizes[part == k], ends[part == k][0] - sizes[part == k][0]
                rows = slice(low, low + own.sum())
                cluster, found = _clustered(np.repeat(np.cumsum(own) - own, own), np.repeat(own, own), xyz[rows], w[rows], pt[rows], eps, least)
                yield f.iloc[rows][["obj_id", *_AXES]].assign(cluster=cluster)[found]

    types = {c: spots.schema[c].dataType.simpleString() for c in ("obj_id", *_AXES, "pt")}
    return spots.select("obj_id", *_AXES, "w", "pt").repartition("obj_id").sortWithinPartitions("obj_id").mapInPandas(run, ", ".join(f"{c} {types[c]}" for c in ("obj_id", *_AXES)) + f", cluster {types['pt']}")


def near_pairs(spots: DataFrame, eps: float) -> DataFrame:
    """``a, b, wa, wb, d2``: pairs of spots (``obj_id, node, w, x, y, z``) of one object at most ``eps`` apart, each once."""
    cells = [F.floor(F.col(c) / eps).cast("long") for c in _AXES]
    a = spots.select("obj_id", F.col("node").alias("a"), F.col("w").alias("wa"), *(c.alias(f"g{k}") for k, c in zip(_AXES, cells)), *(F.col(c).alias(f"a{c}") for c in _AXES))
    steps = F.explode(F.array(*[F.struct(*(F.lit(v).alias(k) for k, v in zip(_AXES, d))) for d in _AHEAD])).alias("step")
    b = spots.select("obj_id", F.col("node").alias("b"), F.col("w").alias("wb"), *(c.alias(f"h{k}") for k, c in zip(_AXES, cells)), *(F.col(c).alias(f"b{c}") for c in _AXES), steps)
    b = b.select("obj_id", "b", "wb", *(f"b{c}" for c in _AXES), *((F.col(f"h{c}") - F.col(f"step.{c}")).alias(f"g{c}") for c in _AXES), (F.col("step") == F.struct(*(F.lit(0).alias(c) for c in _AXES))).alias("own"))
    d2 = sum(((F.col(f"a{c}") - F.col(f"b{c}")) * (F.col(f"a{c}") - F.col(f"b{c}")) for c in _AXES), F.lit(0.0))
    return a.join(b, ["obj_id", "gx", "gy", "gz"]).where(~F.col("own") | (F.col("a") < F.col("b"))).select("a", "b", "wa", "wb", d2.alias("d2")).where(F.col("d2") <= eps * eps)


def dbscan(points: DataFrame, eps: float, least: int) -> DataFrame:
    """``points`` (``obj_id, pt, x, y, z`` and more) with ``cluster``: the smallest ``pt`` of the core points of its cluster in the object, null for noise.

    A core point has ``least`` points within ``eps``, itself included. Core points within ``eps`` of each other are in one cluster, and
    others within ``eps`` of a core point in that of the nearest, ties by smaller ``pt``. Points without coordinates are noise.
    """
    spots = points.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL").groupBy("obj_id", *_AXES).agg(F.count(F.lit(1)).alias("w"), F.min("pt").alias("pt"))
    spots = cut(spots.where("obj_id IS NOT NULL").withColumn("node", F.monotonically_increasing_id()), "spots")
    large = cut(spots.groupBy("obj_id").agg(F.count(F.lit(1)).alias("n"), F.count("pt").alias("m")).where((F.col("n") > SMALL) | (F.col("n") > F.col("m"))).select("obj_id"), "large")
    if large.isEmpty():
        return points.join(_small_clusters(spots, eps, least), ["obj_id", *_AXES], "left").select(*points.columns, "cluster")
    small = _small_clusters(spots.join(large, "obj_id", "left_anti"), eps, least)
    spots = cut(spots.join(large, "obj_id"), "spots")
    pairs = cut(near_pairs(spots, eps), "near")
    ends = pairs.select(F.col("a").alias("node"), F.col("wb").alias("v")).unionByName(pairs.select(F.col("b").alias("node"), F.col("wa").alias("v")))
    about = ends.groupBy("node").agg(F.sum("v").alias("v"))
    cores = cut(spots.join(about, "node", "left").where(F.col("w") + F.coalesce("v", F.lit(0)) >= least).select("node", "pt"), "cores")
    links = pairs.join(cores.select(F.col("node").alias("a")), "a").join(cores.select(F.col("node").alias("b")), "b").select(F.col("a").alias("i"), F.col("b").alias("j"))
    roots = components(cores.select(F.col("node").alias("obj_id")), links).select(F.col("obj_id").alias("node"), F.col("component").alias("root"))
    named = roots.join(cores, "node")
    named = cut(named.join(named.groupBy("root").agg(F.min("pt").alias("cluster")), "root").select("node", "pt", "cluster"), "named")
    sides = pairs.select(F.col("a").alias("node"), F.col("b").alias("core"), "d2").unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("core"), "d2"))
    border = sides.join(named.select(F.col("node").alias("core"), "pt", "cluster"), "core").join(cores, "node", "left_anti")
    border = border.groupBy("node").agg(F.min(F.struct("d2", "pt", "cluster")).alias("m")).select("node", F.col("m.cluster").alias("cluster"))
    found = spots.join(named.select("node", "cluster").unionByName(border), "node").select("obj_id", *_AXES, "cluster").unionByName(small)
    return points.join(found, ["obj_id", *_AXES], "left").select(*points.columns, "cluster")


def keep_largest_cluster(points: DataFrame, eps: float, least: int = 10, too_few: int = 5) -> DataFrame:
    """Each object's points of its largest cluster (of equal ones, that named by the smallest point); all of them where that has fewer than ``too_few``."""
    labelled = cut(dbscan(points, eps, least), "clusters")
    best = labelled.where("cluster IS NOT NULL").groupBy("obj_id", "cluster").agg(F.count(F.lit(1)).alias("n")).groupBy("obj_id").agg(F.max(F.struct("n", (-F.col("cluster")).alias("last"))).alias("m"))
    best = best.where(F.col("m.n") >= too_few).select("obj_id", (-F.col("m.last")).alias("largest"))
    return labelled.join(best, "obj_id", "left").where("largest IS NULL OR cluster = largest").select(*points.columns)


def denoised(points: DataFrame, voxel: float, eps: float, least: int = 10) -> DataFrame:
    """``obj_id, pt, x, y, z``: the mean of each voxel of an object, noise and smaller clusters left out; objects of which fewer than 4 remain keep their points."""
    cells = [F.floor(F.col(c) / voxel).cast("long").alias(f"v{c}") for c in _AXES]
    means = points.groupBy("obj_id", *cells).agg(F.min("pt").alias("pt"), *(F.round(F.avg(c), 9).alias(c) for c in _AXES)).select("obj_id", "pt", *_AXES)
    clean = cut(keep_largest_cluster(cut(means, "voxels"), eps, least), "clean")
    enough = clean.groupBy("obj_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 4").select("obj_id")
    return clean.join(enough, "obj_id").unionByName(points.select("obj_id", "pt", *_AXES).join(enough, "obj_id", "left_anti"))
