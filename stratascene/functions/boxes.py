"""Similarity of axis-aligned boxes given by centre and extent, as column expressions."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Box = tuple[tuple[Column, ...], tuple[Column, ...]]


def corners(centre: tuple[Column, ...], extent: tuple[Column, ...], padding: float = 0.0) -> Box:
    return tuple(c - e / 2 - padding for c, e in zip(centre, extent)), tuple(c + e / 2 + padding for c, e in zip(centre, extent))


def _product(values: list[Column]) -> Column:
    out = values[0]
    for v in values[1:]:
        out = out * v
    return out


def volume(box: Box) -> Column:
    return _product([hi - lo for lo, hi in zip(*box)])


def intersection(a: Box, b: Box) -> Column:
    return _product([F.greatest(F.lit(0.0), F.least(h1, h2) - F.greatest(l1, l2)) for l1, h1, l2, h2 in zip(*a, *b)])


def enclosing(a: Box, b: Box) -> Column:
    return _product([F.greatest(h1, h2) - F.least(l1, l2) for l1, h1, l2, h2 in zip(*a, *b)])


def iou(a: Box, b: Box, eps: float = 1e-10, volumes: tuple[Column, Column] | None = None) -> Column:
    """The shared part of two boxes. ``volumes``, if known from the extents, are free of the rounding of corners, so that equal boxes tie."""
    i = intersection(a, b)
    va, vb = volumes or (volume(a), volume(b))
    return i / (va + vb - i + eps)


def giou(a: Box, b: Box, eps: float = 1e-10) -> Column:
    i = intersection(a, b)
    union = volume(a) + volume(b) - i
    hull = enclosing(a, b)
    return i / (union + eps) - (hull - union) / (hull + eps)


def corner_points(box: Box) -> Column:
    """The eight corners of a box, the last axis running fastest."""
    return F.array(*[F.array(*(box[s][k] for k, s in enumerate(sides))) for sides in itertools.product((0, 1), repeat=3)])


def widest(boxes: DataFrame, extents: tuple[str, ...] = ("ex", "ey")) -> float:
    """The largest extent: boxes whose centres are further apart don't meet. One row comes to the driver."""
    return float(boxes.agg(F.max(F.greatest(*extents))).first()[0] or 0.0) or 1.0


def max_overlap(a: Box, b: Box) -> Column:
    i = intersection(a, b)
    return F.greatest(i / volume(a), i / volume(b))
