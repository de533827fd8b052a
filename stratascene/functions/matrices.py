"""4x4 matrices as row-major ``array<double>`` columns of 16, and intrinsics, as expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def product(a: Column, b: Column) -> Column:
    return F.array(*[sum((a[4 * r + k] * b[4 * k + c] for k in range(1, 4)), a[4 * r] * b[c]) for r in range(4) for c in range(4)])


def rigid_inverse(m: Column) -> Column:
    """Inverse of a rotation and a shift: the rotation's transpose, and the shift turned back."""
    turned = [[m[4 * k + r] for k in range(3)] for r in range(3)]
    shift = [-(turned[r][0] * m[3] + turned[r][1] * m[7] + turned[r][2] * m[11]) for r in range(3)]
    return F.array(*[x for r in range(3) for x in (*turned[r], shift[r])], *[F.lit(float(k == 3)) for k in range(4)])


def apply(m: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    return tuple(m[4 * r] * x + m[4 * r + 1] * y + m[4 * r + 2] * z + m[4 * r + 3] for r in range(3))


def heading_pose(px: Column, py: Column, pz: Column, fwx: Column, fwy: Column) -> Column:
    """The pose of a camera that stands upright at a place and looks along a heading."""
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(fwx, -fwy, zero, px, fwy, fwx, zero, py, zero, zero, one, pz, zero, zero, zero, one)


def flipped_axes(m: Column) -> Column:
    """P m P^T for the permutation P that turns y-up axes into z-up ones: (x, y, z) becomes (x, -z, y)."""
    p = F.array(*[F.lit(float(v)) for v in (1, 0, 0, 0, 0, 0, -1, 0, 0, 1, 0, 0, 0, 0, 0, 1)])
    t = F.array(*[F.lit(float(v)) for v in (1, 0, 0, 0, 0, 0, 1, 0, 0, -1, 0, 0, 0, 0, 0, 1)])
    return product(product(p, m), t)


def rotation(w: Column, x: Column, y: Column, z: Column) -> list[Column]:
    """The nine numbers of a quaternion's rotation."""
    n = w * w + x * x + y * y + z * z
    s = F.when(n > 0, 2.0 / n).otherwise(0.0)
    return [1 - s * (y * y + z * z), s * (x * y - z * w), s * (x * z + y * w), s * (x * y + z * w), 1 - s * (x * x + z * z), s * (y * z - x * w), s * (x * z - y * w), s * (y * z + x * w), 1 - s * (x * x + y * y)]


def intrinsics(fx: Column, fy: Column, cx: Column, cy: Column) -> Column:
    """The nine numbers of a camera matrix."""
    zero = F.lit(0.0)
    return F.array(fx, zero, cx, zero, fy, cy, zero, zero, F.lit(1.0))


def scaled(k: Column, width_ratio: float, height_ratio: float) -> Column:
    """A camera matrix for an image resized by two ratios."""
    return F.array(k[0] * width_ratio, k[1], k[2] * width_ratio, k[3], k[4] * height_ratio, k[5] * height_ratio, k[6], k[7], k[8])


def adjusted(k: Column, size: tuple[int, int], to: tuple[int, int]) -> Column:
    """A camera matrix for an image of (width, height) ``size`` brought to ``to`` by resizing to its height and cropping its width."""
    if size == to:
        return k
    width = math.floor(to[1] * size[0] / size[1])
    return F.array(k[0] * (width / size[0]), k[1], k[2] * ((to[0] - 1) / (size[0] - 1)), k[3], k[4] * (to[1] / size[1]), k[5] * ((to[1] - 1) / (size[1] - 1)), k[6], k[7], k[8])
