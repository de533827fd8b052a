"""Pinhole cameras and angles as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import matrices


def project(x: Column, y: Column, z: Column, fx: float, fy: float, cx: float, cy: float, rounding: str = "none") -> tuple[Column, Column]:
    """Pixel of a point in camera axes; ``rounding`` is none, truncate or nearest."""
    u, v = x * fx / z + cx, y * fy / z + cy
    if rounding == "truncate":
        return u.cast("int"), v.cast("int")
    return tuple(F.round(F.round(c, 9)).cast("int") for c in (u, v)) if rounding == "nearest" else (u, v)


def in_image(u: Column, v: Column, z: Column, width: float, height: float) -> Column:
    return (z > 0.01) & (u >= 0) & (u < width) & (v >= 0) & (v < height)


def unproject(u: Column, v: Column, depth: Column, fx: float, fy: float, cx: float, cy: float) -> tuple[Column, Column, Column]:
    """The point in camera axes that a pixel with a depth shows."""
    return (u - cx) * depth / fx, (v - cy) * depth / fy, depth


def focal_from_fov(vertical_degrees: Column, height: float) -> Column:
    return height / (2 * F.tan(F.radians(vertical_degrees) / 2))


def angle_between(a: Column, b: Column) -> Column:
    """Smaller angle between two headings in degrees."""
    d = F.pmod(a - b, F.lit(360.0))
    return F.least(d, 360.0 - d)


def heat_colour(similarity: Column) -> tuple[Column, Column, Column]:
    """Blue over yellow to red for -1 to 1."""
    t = (similarity + 1) / 2
    low = t < 0.5
    return F.when(low, (255 * 2 * t).cast("int")).otherwise(255), F.when(low, (255 * 2 * t).cast("int")).otherwise((255 * 2 * (1 - t)).cast("int")), F.when(low, (255 * (1 - 2 * t)).cast("int")).otherwise(0)


def clean_tags(text: Column, added: tuple[str, ...] = (), removed: tuple[str, ...] = ()) -> Column:
    """Tags of a comma-separated text, trimmed, empty ones and those that contain a removed word left out, missing ones added."""
    tags = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    tags = F.array_union(tags, F.array(*[F.lit(a) for a in added])) if added else F.array_distinct(tags)
    if removed:
        tags = F.filter(tags, lambda x: ~reduce(lambda a, b: a | b, [x.contains(w) for w in removed]))
    return tags


def valid_depth(z: Column, kind: str, low: float, high: float) -> Column:
    """Whether a depth counts: for patches with both ends, for pixels and clouds without."""
    return (z >= low) & (z <= high) if kind == "patch" else (z > low) & (z < high)


def backproject(pixels: DataFrame, poses: DataFrame, fx: float, fy: float, cx: float, cy: float, by_angle: bool = False) -> DataFrame:
    """``pixels`` (``view_id, u, v, depth``) as points ``x, y, z`` of the world with a ``weight`` that falls with depth and, if asked, with the angle to the vertical (0.2 at least)."""
    j = pixels.join(poses.select("view_id", "m"), "view_id")
    here = unproject(F.col("u"), F.col("v"), F.col("depth"), fx, fy, cx, cy)
    x, y, z = matrices.apply(F.col("m"), *here)
    j = j.withColumn("x", x).withColumn("y", y).withColumn("z", z).withColumn("weight", 1 / (1 + F.col("depth") / 5))
    if by_angle:
        d = [F.col(c) - F.col("m")[k] for c, k in (("x", 3), ("y", 7), ("z", 11))]
        j = j.withColumn("weight", F.col("weight") * F.greatest(F.lit(0.2), F.abs(-d[2] / (F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) + 1e-8))))
    return j.drop("m")


def depth_xyz(u: Column, v: Column, depth: Column, height: int, fx: float, fy: float, cx: float, cy: float) -> tuple[Column, Column, Column]:
    """The point that a pixel of a depth image shows where rows are counted from the bottom."""
    return (u - cx) * depth / fx, (height - v - cy) * depth / fy, depth


def box_corners(objects: DataFrame) -> DataFrame:
    """``obj_id, corner, x, y, z``: the eight corners of each box."""
    signs = F.array(*[F.struct(F.lit(4 * a + 2 * b + c).alias("corner"), *(F.lit(2 * s - 1).alias(f"s{n}") for s, n in zip((a, b, c), "xyz"))) for a in (0, 1) for b in (0, 1) for c in (0, 1)])
    e = objects.select("*", F.explode(signs).alias("s"))
    return e.select("obj_id", "s.corner", *((F.col(f"c{n}") + F.col(f"s.s{n}") * F.col(f"e{n}") / 2).alias(n) for n in "xyz"))


def image_boxes(corners: DataFrame, fx: float, fy: float, cx: float, cy: float, width: int, height: int) -> DataFrame:
    """``obj_id, x1, y1, x2, y2``: the box around the corners (in camera axes) that are in the image, two at least, within it."""
    u, v = project(F.col("x"), F.col("y"), F.col("z"), fx, fy, cx, cy)
    seen = corners.select("obj_id", "z", u.alias("u"), v.alias("v")).where(in_image(F.col("u"), F.col("v"), F.col("z"), width, height))
    box = seen.groupBy("obj_id").agg(F.count(F.lit(1)).alias("n"), F.greatest(F.lit(0.0), F.min("u")).alias("x1"), F.greatest(F.lit(0.0), F.min("v")).alias("y1"), F.least(F.lit(width - 1.0), F.max("u")).alias("x2"), F.least(F.lit(height - 1.0), F.max("v")).alias("y2"))
    return box.where("n >= 2 AND x2 > x1 AND y2 > y1").select("obj_id", *(F.col(c).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")))


def crop_window(pad_x: Column | int, pad_y: Column | int, width: int, height: int) -> tuple[Column, Column, Column, Column]:
    """``x1, y1, x2, y2`` padded and kept in the image."""
    return F.greatest(F.lit(0.0), F.col("x1") - pad_x), F.greatest(F.lit(0.0), F.col("y1") - pad_y), F.least(F.lit(float(width)), F.col("x2") + pad_x), F.least(F.lit(float(height)), F.col("y2") + pad_y)


def occlusion(depth: Column, expected: Column, share: float = 0.25, band: float = 0.05, hidden: float = 0.3) -> tuple[Column, Column, Column]:
    """Whether a measured depth is that of a point, whether it hides the point, and on which side of it the point is."""
    return F.abs(depth - expected) <= share * depth, depth < expected - hidden, F.when(expected < depth - band, "front").when(expected > depth + band, "behind").otherwise("align")


def rotation_distance(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Smaller angles in degrees, added up over the axes."""
    return reduce(lambda x, y: x + y, [angle_between(p, q) for p, q in zip(a, b)])


def position_distance(a: tuple[Column, ...], b: tuple[Column, ...], ignore_y: bool = False, l1: bool = False) -> Column:
    """Distance of two places, by the sum of the parts or straight, with the height ``y`` or without."""
    parts = [p - q for k, (p, q) in enumerate(zip(a, b)) if not (ignore_y and k == 1)]
    return reduce(lambda x, y: x + y, [F.abs(p) for p in parts]) if l1 else F.sqrt(reduce(lambda x, y: x + y, [p * p for p in parts]))
