"""Oriented boxes of point clouds: sums of products meet in the shuffle, axes come from the covariance in closed form, extents from a second pass."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_AXES = ("x", "y", "z")
#: Objects of fewer points get a box along the axes.
LEAST_POINTS = 4


def covariances(points: DataFrame) -> DataFrame:
    """``obj_id, n, mx, my, mz`` and ``xx, xy, xz, yy, yz, zz``: means and covariances of each object's points."""
    pairs = [(a, b) for k, a in enumerate(_AXES) for b in _AXES[k:]]
    return points.groupBy("obj_id").agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"m{c}") for c in _AXES), *(F.covar_pop(a, b).alias(a + b) for a, b in pairs))


def _cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _vector(parts: list[Column], name: str) -> Column:
    return F.array(*parts).alias(name)


def _own_vector(frame: DataFrame, value: str, name: str) -> DataFrame:
    """``name``: the unit vector that belongs to an eigenvalue, the longest cross product of two rows; null where all vanish."""
    rows = [[F.col(a + b if a <= b else b + a) - (F.col(value) if a == b else 0.0) for b in _AXES] for a in _AXES]
    frame = frame.select("*", *(_vector(_cross(rows[i], rows[j]), f"__c{k}") for k, (i, j) in enumerate(((0, 1), (0, 2), (1, 2)))))
    size = lambda v: sum((F.col(v)[k] * F.col(v)[k] for k in range(3)), F.lit(0.0))
    frame = frame.withColumn("__best", F.greatest(*(F.struct(size(f"__c{k}").alias("s"), F.col(f"__c{k}").alias("v")) for k in range(3))))
    limit = 1e-12 * F.pow(F.col("xx") + F.col("yy") + F.col("zz"), 4)
    return frame.withColumn(name, F.when(F.col("__best.s") > limit, F.transform("__best.v", lambda x: x / F.sqrt("__best.s")))).drop("__c0", "__c1", "__c2", "__best")


def principal_axes(points: DataFrame, upright: bool = False) -> DataFrame:
    """``obj_id, n, yaw, u, v, w``: unit axes by falling variance, or, if boxes stay ``upright``, the axes turned by ``yaw`` about the vertical.

    Objects of fewer than ``LEAST_POINTS`` points, and those whose axes aren't determined, have the axes of space. Where x and y don't vary together, ``yaw`` is 0 or,
    if y varies more, a right angle to the left.
    """
    c = covariances(points)
    few = F.col("n") < LEAST_POINTS
    units = [F.array(*(F.lit(1.0 if k == j else 0.0) for k in range(3))) for j in range(3)]
    if upright:
        # a covariance that is 0 but for rounding has either sign, by the order in which partial sums meet, and would turn the box by half a turn
        xy = F.when(F.abs("xy") > 1e-12 * (F.col("xx") + F.col("yy")), F.col("xy")).otherwise(0.0)
        c = c.withColumn("yaw", F.when(few, 0.0).otherwise(F.atan2(2 * xy, F.col("xx") - F.col("yy")) / 2))
        cos, sin, zero = F.cos("yaw"), F.sin("yaw"), F.lit(0.0)
        return c.select("obj_id", "n", "yaw", F.array(cos, sin, zero).alias("u"), F.array(-sin, cos, zero).alias("v"), units[2].alias("w"))
    c = c.withColumn("q", (F.col("xx") + F.col("yy") + F.col("zz")) / 3)
    dev = [F.col(a + a) - F.col("q") for a in _AXES]
    c = c.withColumn("p", F.sqrt((dev[0] * dev[0] + dev[1] * dev[1] + dev[2] * dev[2] + 2 * (F.col("xy") * F.col("xy") + F.col("xz") * F.col("xz") + F.col("yz") * F.col("yz"))) / 6))
    xy, xz, yz = (F.col(n) for n in ("xy", "xz", "yz"))
    det = dev[0] * (dev[1] * dev[2] - yz * yz) - xy * (xy * dev[2] - yz * xz) + xz * (xy * yz - dev[1] * xz)
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.when(F.col("p") > 0, det / (2 * F.pow("p", 3))).otherwise(1.0)))) / 3
    c = c.withColumn("angle", angle)
    c = c.select("*", (F.col("q") + 2 * F.col("p") * F.cos("angle")).alias("first"), (F.col("q") + 2 * F.col("p") * F.cos(F.col("angle") + 2 * math.pi / 3)).alias("last"))
    c = _own_vector(_own_vector(c, "first", "u"), "last", "w")
    known = ~few & F.col("u").isNotNull() & F.col("w").isNotNull()
    c = c.select("obj_id", "n", *(F.when(known, F.col(a)).otherwise(e).alias(a) for a, e in (("u", units[0]), ("w", units[2]))))
    v = F.array(*_cross([F.col("w")[k] for k in range(3)], [F.col("u")[k] for k in range(3)]))
    return c.select("obj_id", "n", F.lit(None).cast("double").alias("yaw"), "u", v.alias("v"), "w")


def oriented_boxes(points: DataFrame, upright: bool = False) -> DataFrame:
    """``obj_id, n, yaw, u, v, w, cx, cy, cz, ex, ey, ez``: the box of each object's points along its principal axes, ``ex`` along ``u`` and so on."""
    axes = principal_axes(points, upright)
    along = lambda a: sum((F.col(a)[k] * F.col(c) for k, c in enumerate(_AXES)), F.lit(0.0))
    seen = points.select("obj_id", *_AXES).join(axes, "obj_id").select("obj_id", *(along(a).alias(f"p{a}") for a in "uvw"))
    ranges = seen.groupBy("obj_id").agg(*(f(f"p{a}").alias(f"{n}{a}") for a in "uvw" for n, f in (("lo", F.min), ("hi", F.max))))
    middle = {a: (F.col(f"lo{a}") + F.col(f"hi{a}")) / 2 for a in "uvw"}
    centre = [sum((F.col(a)[k] * middle[a] for a in "uvw"), F.lit(0.0)).alias(f"c{c}") for k, c in enumerate(_AXES)]
    return axes.join(ranges, "obj_id").select("obj_id", "n", "yaw", "u", "v", "w", *centre, *((F.col(f"hi{a}") - F.col(f"lo{a}")).alias(f"e{c}") for a, c in zip("uvw", _AXES)))
