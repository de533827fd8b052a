"""Spatial relations between centroids as column expressions, and the plans that join by them."""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from . import trees
from .trees import best_scores

# Names that stand for a relation.
ALIASES = {
    "on_top_of": ("on", "upon", "atop", "on_top", "on_top_of", "resting_on"),
    "above": ("above", "over", "higher_than"),
    "below": ("below", "under", "beneath", "underneath", "lower_than"),
    "next_to": ("next_to", "beside", "adjacent_to", "next"),
    "near": ("near", "by", "close_to"),
    "in_front_of": ("in_front_of", "front", "facing", "before"),
    "behind": ("behind", "back", "back_of", "in_back_of"),
    "left_of": ("left_of", "left", "to_the_left_of", "on_the_left_of"),
    "right_of": ("right_of", "right", "to_the_right_of", "on_the_right_of"),
    "inside": ("inside", "in", "within", "contained_in"),
    "between": ("between", "in_between"),
    "against": ("against", "leaning_on", "leaning_against"),
    "around": ("around", "surrounding"),
}
_BY_ALIAS = {a: k for k, names in ALIASES.items() for a in names}

#: Directions: the axis along which they look and its sign, and the axis across.
_DIRECTIONS = {"in_front_of": ("y", 1, "x"), "behind": ("y", -1, "x"), "left_of": ("x", -1, "y"), "right_of": ("x", 1, "y")}
# Thresholds of relations, in metres.
THRESHOLDS = {
    "on_top_of": {"max_horizontal": 0.5, "min_vertical": 0.0}, "above": {"max_horizontal": 1.0, "min_vertical": 0.1}, "below": {"max_horizontal": 1.0, "max_vertical": -0.1},
    "next_to": {"max_distance": 1.0}, "near": {"max_distance": 2.0}, "against": {"max_distance": 0.5}, "inside": {"margin": 0.1}, "between": {"max_distance_ratio": 0.3},
}
#: Relations whose score falls with the distance alone.
_NEARER = ("near", "next_to", "against", "around")
Thresholds = dict[str, dict[str, float]]


def thresholds_of(name: str, custom: Thresholds | None = None) -> dict[str, float]:
    """The thresholds of a relation, some replaced by one's own; a relation without any has those of near."""
    key = name if name in THRESHOLDS else "near"
    return THRESHOLDS[key] | (custom or {}).get(key, {}) | (custom or {}).get(name, {})


def reach_of(name: str, custom: Thresholds | None = None) -> float | None:
    """How far apart a relation's objects are at most, horizontally: a join needs to look no further. None for directions."""
    if name in _DIRECTIONS:
        return None
    t = thresholds_of(name, custom)
    return t.get("max_horizontal", t.get("max_distance"))


def canonical(relation: str) -> str | None:
    """The relation that a phrase names, or None; the name in lower case with ``_`` for spaces."""
    return _BY_ALIAS.get(relation.strip().lower().replace(" ", "_"))


def norm(*parts: Column) -> Column:
    total = parts[0] * parts[0]
    for p in parts[1:]:
        total = total + p * p
    return F.sqrt(total)


def _reached(name: str, h: Column, r: Column, dz: Column, t: dict[str, float]) -> tuple[Column, Column]:
    """Condition and score of a relation with a reach, from the distance on the ground, that in space and the height above the anchor.

    Both fall with the distances and rise with the height, for below fall with it.
    """
    zero, one = F.lit(0.0), F.lit(1.0)
    ramp = lambda x: F.greatest(zero, 1 - x)
    if name == "on_top_of":
        return (dz >= t["min_vertical"]) & (h <= t["max_horizontal"]), 0.6 * ramp(h / t["max_horizontal"]) + 0.4 * F.least(one, dz / 0.3)
    if name == "above":
        return (dz >= t["min_vertical"]) & (h <= t["max_horizontal"]), 0.5 * ramp(h / t["max_horizontal"]) + 0.5 * F.least(one, dz)
    if name == "below":
        return (dz <= t["max_vertical"]) & (h <= t["max_horizontal"]), 0.5 * ramp(h / t["max_horizontal"]) + 0.5 * F.least(one, F.abs(dz))
    return r <= t["max_distance"], ramp(r / t["max_distance"])


def relation(name: str, d: tuple[Column, Column, Column], custom: Thresholds | None = None) -> tuple[Column, Column]:
    """Whether a displacement (target less anchor) satisfies a relation, and its score in 0..1. An unknown name means near."""
    dx, dy, dz = d
    zero, one = F.lit(0.0), F.lit(1.0)
    ramp = lambda x: F.greatest(zero, 1 - x)
    if name == "in_front_of":
        return (dy > 0) & (F.abs(dx) <= dy), F.least(one, dy / 2) * ramp(F.abs(dx) / dy)
    if name == "behind":
        return (dy < 0) & (F.abs(dx) <= F.abs(dy)), F.least(one, F.abs(dy) / 2) * ramp(F.abs(dx) / F.abs(dy))
    if name == "left_of":
        return (dx < 0) & (F.abs(dy) <= F.abs(dx)), F.least(one, F.abs(dx) / 2)
    if name == "right_of":
        return (dx > 0) & (F.abs(dy) <= F.abs(dx)), F.least(one, F.abs(dx) / 2)
    return _reached(name, norm(dx, dy), norm(dx, dy, dz), dz, thresholds_of(name, custom))


def inside(t: tuple[Column, ...], c: tuple[Column, ...], size: tuple[Column, ...], margin: float = 0.1) -> tuple[Column, Column]:
    """Whether a point is in a box about ``c``, and how central."""
    ok = None
    total = F.lit(0.0)
    for p, q, s in zip(t, c, size):
        within = (p >= q - s / 2 - margin) & (p <= q + s / 2 + margin)
        ok = within if ok is None else ok & within
        total = total + F.abs(p - q) / (s / 2 + 1e-6)
    return ok, F.greatest(F.lit(0.0), 1 - total / 3)


def between(t: tuple[Column, ...], a: tuple[Column, ...], b: tuple[Column, ...], ratio: float = 0.3) -> tuple[Column, Column]:
    """Whether a point lies between two others: its projection on their line within them, and near enough to the line."""
    ab = [q - p for p, q in zip(a, b)]
    at = [q - p for p, q in zip(a, t)]
    length = norm(*ab)
    safe = F.when(length >= 1e-6, length)
    proj = (at[0] * ab[0] + at[1] * ab[1] + at[2] * ab[2]) / safe
    off = norm(*(x - proj * y / safe for x, y in zip(at, ab)))
    ok = (length >= 1e-6) & (proj >= 0) & (proj <= length) & (off <= ratio * length)
    return F.coalesce(ok, F.lit(False)), 0.5 * (1 - F.abs(proj - length / 2) / (length / 2)) + 0.5 * (1 - off / (ratio * length))


def _cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("long")


def radius_join(left: DataFrame, right: DataFrame, reach: float, condition: Column, left_at: tuple[str, ...], right_at: tuple[str, ...], few: bool = False, cells: bool = False) -> DataFrame:
    """Rows of ``left`` and ``right`` within ``reach`` in each of the given coordinates, two or three, that meet ``condition``.

    An equi-join on grid cells as wide as the reach: each right row is put into its nine (or 27) neighbouring cells, so that no pair
    further apart than two cells is ever formed; the smaller side is best on the right. AQE splits a crowded cell. Spark takes the right side to be as small as it was before it was put
    into cells, and would bring it to the driver to broadcast it, which is done only if the caller has counted it and says that it has ``few`` rows.
    With ``cells`` the left row's cell comes along as ``__g0, __g1``: all pairs of a left row are in it, and so in one task.
    """
    return _cell_join(left, right, reach, condition, left_at, right_at, few, cells)


def _cell_join(left: DataFrame, right: DataFrame, reach: float, condition: Column, left_at: tuple[str, ...], right_at: tuple[str, ...], few: bool = False, cells: bool = False) -> DataFrame:
    n = len(left_at)
    a = left.withColumns({f"__g{k}": _cell(F.col(c), reach) for k, c in enumerate(left_at)})
    steps = F.explode(F.array(*[F.struct(*(F.lit(v).alias(f"s{k}") for k, v in enumerate(d))) for d in itertools.product((-1, 0, 1), repeat=n)]))
    b = right.withColumn("__s", steps)
    b = b.withColumns({f"__h{k}": _cell(F.col(c), reach) + F.col(f"__s.s{k}") for k, c in enumerate(right_at)}).drop("__s")
    same = functools.reduce(Column.__and__, [F.col(f"__g{k}") == F.col(f"__h{k}") for k in range(n)])
    return a.join(F.broadcast(b) if few else b.hint("merge"), same & condition).drop(*(f"__{s}{k}" for s in ("h" if cells else "gh") for k in range(n)))


def box_join(left: DataFrame, right: DataFrame, left_box: tuple[tuple[Column, ...], tuple[Column, ...]], right_box: tuple[tuple[Column, ...], tuple[Column, ...]], condition: Column) -> DataFrame:
    """Rows of ``left`` and ``right`` whose boxes (low and high corners, of either side's columns) meet and which meet ``condition``.

    Boxes are dealt to the cells that they cover, and a pair comes out of the cell where it begins to meet. Cells are as wide as boxes are on
    average along each axis, a sixteenth of the widest at least, so that a pair further apart than two cells is never formed, however wide the widest are. Neither side is broadcast.
    """
    sides, n = [], len(left_box[0])
    for table, box, s in ((left, left_box, "l"), (right, right_box, "r")):
        sides.append(table.withColumns({f"__{s}{e}{k}": c for e, ends in zip("ab", box) for k, c in enumerate(ends)}))
    wide = sides[0].select(*(F.col(f"__lb{k}") - F.col(f"__la{k}") for k in range(n))).union(sides[1].select(*(F.col(f"__rb{k}") - F.col(f"__ra{k}") for k in range(n)))).toDF(*(f"w{k}" for k in range(n)))
    found = wide.agg(*(f(f"w{k}") for k in range(n) for f in (F.avg, F.max))).first()  # one row
    cells = [max(found[2 * k] or 0.0, (found[2 * k + 1] or 0.0) / 16) or 1.0 for k in range(n)]
    dealt = []
    for table, s in zip(sides, "lr"):
        for k, c in enumerate(cells):
            table = table.withColumn(f"__{s}{k}", F.explode(F.sequence(_cell(F.col(f"__{s}a{k}"), c), _cell(F.col(f"__{s}b{k}"), c))))
        dealt.append(table)
    same = functools.reduce(Column.__and__, [F.col(f"__l{k}") == F.col(f"__r{k}") for k in range(n)])
    first = functools.reduce(Column.__and__, [_cell(F.greatest(f"__la{k}", f"__ra{k}"), c) == F.col(f"__l{k}") for k, c in enumerate(cells)])
    meet = functools.reduce(Column.__and__, [(F.col(f"__la{k}") <= F.col(f"__rb{k}")) & (F.col(f"__ra{k}") <= F.col(f"__lb{k}")) for k in range(n)])
    return dealt[0].join(dealt[1].hint("merge"), same & meet & first & condition).select(*(F.col(c) for c in (*left.columns, *right.columns)))


def nearest_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_xyz: tuple[str, ...], right_xyz: tuple[str, ...], reach: float | None = None, limit: float | None = None, others: bool = False, digits: int | None = None, carry: tuple[str, ...] = (), join: Callable[..., DataFrame] | None = None) -> DataFrame:
    """``left_id, right_id, distance``: for each left row the nearest right row, ties to the lowest identifier; none if there is no right row.

    Rings: rows that find something within the reach are done, the others look twice as far, until the reach covers the extent of both sides.
    The first reach, 0.5 m at most, is about how far the right rows are apart, so that a row meets few of them however dense they are. The smaller
    side is put into the cells about it. Rows further away than ``limit`` don't count, nor with ``others`` those of the same identifier. Distances are compared
    to so many ``digits``; right columns to ``carry`` come along. ``join`` makes the pairs of a ring, by default ``radius_join``.
    """
    join = join or radius_join
    out, rest = None, cut(left.select(left_id, *left_xyz).where(F.col(left_xyz[0]).isNotNull()))
    right = right.select(F.col(right_id).alias("__r"), *(F.col(c).alias(f"__{k}") for k, c in enumerate(right_xyz)), *(F.col(c).alias(f"__c{k}") for k, c in enumerate(carry)))
    axes = tuple(f"__{k}" for k in range(len(left_xyz)))
    both = left.select(*(F.col(c).alias(k) for k, c in zip(axes, left_xyz))).unionByName(right.select(*axes))
    low_high = both.agg(*(f(k) for k in axes for f in (F.min, F.max))).first()
    extent = sum((hi - lo) ** 2 for lo, hi in zip(low_high[::2], low_high[1::2])) ** 0.5 if None not in low_high else 0.0
    count = right.count()
    if reach is None:
        sides = [max(hi - lo, 1e-3) for lo, hi in zip(low_high[::2], low_high[1::2])] if None not in low_high else [1.0]
        reach = min(0.5, max((math.prod(sides) / max(1, count)) ** (1 / len(sides)), 1e-3))
    dist = norm(*(F.col(c) - F.col(f"__{k}") for k, c in enumerate(left_xyz)))
    rank = dist if digits is None else F.round(dist, digits)
    fits = (dist <= limit if limit is not None else F.lit(True)) & (F.col(left_id) != F.col("__r") if others else F.lit(True))
    while True:
        width = reach if digits is None else reach + 10.0**-digits
        if rest.count() < count:
            found = join(right, rest, width, (rank <= reach) & fits, axes, left_xyz)
        else:
            found = join(rest, right, width, (rank <= reach) & fits, left_xyz, axes)
        nearest = F.min(F.struct(rank.alias("rank"), F.col("__r").alias(right_id), dist.alias("distance"), *(F.col(f"__c{k}").alias(c) for k, c in enumerate(carry)))).alias("b")
        found = cut(found.groupBy(left_id).agg(nearest).select(left_id, f"b.{right_id}", "b.distance", *(f"b.{c}" for c in carry)))
        out = found if out is None else out.unionByName(found)
        if reach > extent or limit is not None and reach > limit:
            return out
        rest = cut(rest.join(found.select(left_id), left_id, "left_anti"))
        if rest.isEmpty():
            return out
        reach *= 2


#: Rows of a side that is broadcast, at most.
BROADCAST_ROWS = 100_000


def broadcast_blocks(side: DataFrame, by: str, most: int = BROADCAST_ROWS) -> list[DataFrame]:
    """``side`` in blocks of about ``most`` rows, each marked for broadcasting: its size is counted first, so what is broadcast doesn't grow with the data."""
    parts = max(1, -(-side.count() // most))
    return [F.broadcast(side if parts == 1 else side.where(F.pmod(F.xxhash64(by), F.lit(parts)) == k)) for k in range(parts)]


def direction_join(targets: DataFrame, anchors: DataFrame, name: str) -> DataFrame:
    """``obj_id, score``: targets (``obj_id, cx, cy``) that lie in a direction of any anchor (``ax, ay``), with their best score.

    Directions reach everywhere, so that pairs are found by a search in a packed tree: the score rises with the way along the direction and
    doesn't with the way across, so that the corners of a node's bounds say what its anchors can score.
    """
    main, sign, side = _DIRECTIONS[name]

    def rate(along: Column, across: Column) -> Column:
        reached = F.least(F.lit(1.0), along / 2)
        return F.when((along > 0) & (across <= along), reached * F.greatest(F.lit(0.0), 1 - across / along) if main == "y" else reached)

    def score(at: dict[str, Column]) -> Column:
        return rate(F.col("__p") - at["p"], F.abs(F.col("__q") - at["q"]))

    def bounds(box: dict[str, tuple[Column, Column]]) -> tuple[Column, Column]:
        (p0, p1), (q0, q1), p, q = box["p"], box["q"], F.col("__p"), F.col("__q")
        nearest = F.greatest(F.lit(0.0), q0 - q, q - q1)
        return rate(p - p1, F.greatest(F.abs(q - q0), F.abs(q - q1))), rate(p - p0, nearest)

    places = targets.select(F.col("obj_id"), (sign * F.col(f"c{main}")).alias("__p"), F.col(f"c{side}").alias("__q")).dropna()
    points = anchors.select((sign * F.col(f"a{main}")).alias("p"), F.col(f"a{side}").alias("q"))
    return best_scores(places.distinct(), points, "obj_id", ("p", "q"), score, bounds)


def _range(x: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
    """How far a coordinate is from a range at least and at most."""
    return F.greatest(F.lit(0.0), lo - x, x - hi), F.greatest(F.abs(x - lo), F.abs(x - hi))


def _reach_bounds(name: str, t: dict[str, float]):
    """Bounds of ``_reached`` for boxes of anchors; each step rounds as it does for an anchor, so that none is lost to rounding."""

    def bounds(box: dict[str, tuple[Column, Column]]) -> tuple[Column, Column]:
        near, far = zip(*(_range(F.col(f"c{a[1]}"), *box[a]) for a in ("ax", "ay", "az")))
        low, high = F.col("cz") - box["az"][1], F.col("cz") - box["az"][0]
        worst, best = (high, low) if name == "below" else (low, high)
        ends = _reached(name, norm(*far[:2]), norm(*far), worst, t), _reached(name, norm(*near[:2]), norm(*near), best, t)
        return tuple(F.when(ok, score) for ok, score in ends)

    return bounds


def _inside_bounds(margin: float):
    def bounds(box: dict[str, tuple[Column, Column]]) -> tuple[Column, Column]:
        sure = may = None
        worst = best = F.lit(0.0)
        for c in "xyz":
            p, (q0, q1), (s0, s1) = F.col(f"c{c}"), box[f"a{c}"], box[f"a_e{c}"]
            near, far = _range(p, q0, q1)
            in_all, in_any = (p >= q1 - s0 / 2 - margin) & (p <= q0 + s0 / 2 + margin), (p >= q0 - s1 / 2 - margin) & (p <= q1 + s1 / 2 + margin)
            sure, may = (in_all, in_any) if sure is None else (sure & in_all, may & in_any)
            worst, best = worst + far / (s0 / 2 + 1e-6), best + near / (s1 / 2 + 1e-6)
        return tuple(F.when(ok, F.greatest(F.lit(0.0), 1 - total / 3)) for ok, total in ((sure, worst), (may, best)))

    return bounds


def relation_join(targets: DataFrame, anchors: DataFrame, name: str, exclude_self: bool = False, thresholds: Thresholds | None = None) -> DataFrame:
    """``obj_id, score``: targets that satisfy a relation with any anchor, with their best score.

    Both sides have ``obj_id, cx, cy, cz`` (and ``ex, ey, ez`` for inside). Where the distance alone counts, the best anchor is the nearest one; else it is searched
    for in a packed tree, so that work doesn't grow with how many are in reach. Few anchors with a reach are joined on a grid, that of inside follows from the
    largest anchor; so are other ones of ``exclude_self``. An object isn't in a direction of itself.
    """
    key = canonical(name) or "near"
    axes = ("ax", "ay", "az", *(("a_ex", "a_ey", "a_ez") if key == "inside" else ()))
    a = anchors.select(F.col("obj_id").alias("a_id"), F.col("cx").alias("ax"), F.col("cy").alias("ay"), F.col("cz").alias("az"), *([F.col(c).alias(f"a_{c}") for c in ("ex", "ey", "ez")] if key == "inside" else []))
    reach = reach_of(key, thresholds)
    if reach is None and key != "inside":
        return direction_join(targets, a, key)
    t = thresholds_of(key, thresholds)
    if key in _NEARER and (exclude_self or a.limit(trees.DIRECT + 1).count() > trees.DIRECT):
        near = nearest_join(targets, a, "obj_id", "a_id", ("cx", "cy", "cz"), ("ax", "ay", "az"), limit=t["max_distance"], others=exclude_self, join=_cell_join)
        return near.select("obj_id", F.greatest(F.lit(0.0), 1 - F.col("distance") / t["max_distance"]).alias("score"))
    if key == "inside":
        ok, score = inside((F.col("cx"), F.col("cy"), F.col("cz")), (F.col("ax"), F.col("ay"), F.col("az")), (F.col("a_ex"), F.col("a_ey"), F.col("a_ez")), t["margin"])
    else:
        ok, score = relation(key, (F.col("cx") - F.col("ax"), F.col("cy") - F.col("ay"), F.col("cz") - F.col("az")), thresholds)
    if not exclude_self and t.get("max_vertical", 0.0) <= 0:
        a = cut(a.select(*axes).dropna().distinct(), "anchors")
        if a.limit(trees.DIRECT + 1).count() > trees.DIRECT:
            places = targets.select("obj_id", "cx", "cy", "cz").dropna().distinct()
            bounds = _inside_bounds(t["margin"]) if key == "inside" else _reach_bounds(key, t)
            return best_scores(places, a, "obj_id", axes, lambda at: F.when(ok, score), bounds, axes[:3])
    elif exclude_self:
        ok = ok & (F.col("obj_id") != F.col("a_id"))
    if key == "inside":
        largest = a.agg(F.max(F.greatest("a_ex", "a_ey"))).first()[0]
        reach = (largest or 0.0) / 2 + 2 * t["margin"]
    return radius_join(targets, a, reach, ok, ("cx", "cy"), ("ax", "ay")).groupBy("obj_id").agg(F.max(score).alias("score"))
