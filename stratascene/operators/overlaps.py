"""Pairs of boxes along the axes that share a volume, with what is asked of them, evaluated where the pairs are found."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import boxes
from ..functions.sweeps import Side, swept

#: What can be asked of a pair: volumes, the volume around both, by how much i is higher, both heights together.
_MEASURES = {
    "va": lambda a, b: a["v"],
    "vb": lambda a, b: b["v"],
    "hull": lambda a, b: _product(a, b, np.maximum, np.minimum),
    "rise": lambda a, b: a["cz"] - b["cz"],
    "tall": lambda a, b: a["ez"] + b["ez"],
}


def _product(a: Side, b: Side, high, low) -> np.ndarray:
    out = 1.0
    for c in "xyz":
        out = out * np.maximum(0.0, high(a[f"h{c}"], b[f"h{c}"]) - low(a[f"l{c}"], b[f"l{c}"]))
    return out


def intersection(a: Side, b: Side) -> np.ndarray:
    return _product(a, b, np.minimum, np.maximum)


def sharing(a: Side, b: Side, least: float, two: bool) -> tuple[Side, Side, np.ndarray]:
    """The pairs that share more than ``least``, and their shared volumes; those of one table of different identifiers."""
    inter = intersection(a, b)
    met = inter > least
    if not two:
        met &= a["id"] != b["id"]
    return (a, b, inter) if met.all() else (a.only(met), b.only(met), inter[met])


def side(objects: DataFrame, *more: str) -> DataFrame:
    """Identifier, corners and volume, height and ``more`` of boxes."""
    (lows, highs) = _box()
    corners = [c.alias(f"{e}{x}") for e, ends in (("l", lows), ("h", highs)) for c, x in zip(ends, "xyz")]
    return objects.select(F.col("obj_id").cast("long").alias("id"), *corners, (F.col("ex") * F.col("ey") * F.col("ez")).alias("v"), "cz", "ez", *more)


def _box() -> boxes.Box:
    return boxes.corners(tuple(F.col(c) for c in ("cx", "cy", "cz")), tuple(F.col(c) for c in ("ex", "ey", "ez")))


def corners() -> boxes.Box:
    return tuple(tuple(F.col(f"{e}{x}") for x in "xyz") for e in "lh")


def box_overlaps(objects: DataFrame, *wanted: str, others: DataFrame | None = None, both: bool = False, least: float = 1e-9) -> DataFrame:
    """``i, j, inter`` and what is ``wanted`` of pairs of boxes that share more than ``least``: of ``objects`` and ``others``, or of two objects, each pair once (i below j) or ``both`` ways."""
    two = others is not None

    def measure():
        def take(a: Side, b: Side) -> dict[str, np.ndarray]:
            a, b, inter = sharing(a, b, least, two)
            ways = [(a, b, inter)]
            if not two and both:
                ways = [(a, b, inter), (b, a, inter)]
            elif not two:
                turned = a["id"] > b["id"]
                ways = [(a.only(~turned), b.only(~turned), inter[~turned]), (b.only(turned), a.only(turned), inter[turned])]
            told = [{"i": x["id"], "j": y["id"], "inter": shared, **{name: _MEASURES[name](x, y) for name in wanted}} for x, y, shared in ways]
            return {c: np.concatenate([t[c] for t in told]) for c in told[0]}

        return take

    return swept(side(objects), side(others) if two else None, corners(), corners() if two else None, measure, "i long, j long, inter double" + "".join(f", {name} double" for name in wanted))


def most_overlapping(objects: DataFrame, k: int, least: float = 1e-9) -> DataFrame:
    """``i, j, ratio``: the ``k`` pairs with the largest share of i in j, rounded to nine digits, ties by identifiers, in this order.

    A task lets a pair go once it has ``k`` better ones; where a share is so close to the middle of two roundings that it may be rounded either way, the pair is kept.
    """

    def measure():
        best = [np.empty(0), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)]

        def take(a: Side, b: Side) -> dict[str, np.ndarray]:
            a, b, inter = sharing(a, b, least, False)
            ratios = inter / a["v"], inter / b["v"]
            if len(best[0]) >= k:  # what can't be rounded up to the last of them
                may = [np.flatnonzero(r * 1e9 >= best[0][k - 1] - 1) for r in ratios]
                i, j = (np.concatenate((x["id"], y["id"])) for x, y in ((a.only(may[0]), b.only(may[1])), (b.only(may[0]), a.only(may[1]))))
                ratio = np.concatenate([r[m] for r, m in zip(ratios, may)])
            else:
                i, j, ratio = np.concatenate((a["id"], b["id"])), np.concatenate((b["id"], a["id"])), np.concatenate(ratios)
            whole = np.rint(ratio * 1e9)
            unsure = np.abs(ratio * 1e9 - np.floor(ratio * 1e9) - 0.5) < 1e-4
            if len(best[0]) >= k:
                may = unsure | (whole > best[0][k - 1]) | ((whole == best[0][k - 1]) & (i <= best[1][k - 1]))
                whole, i, j, ratio, unsure = (x[may] for x in (whole, i, j, ratio, unsure))
            sure = np.flatnonzero(~unsure)
            order = sure[np.lexsort((j[sure], i[sure], -whole[sure]))[:k]]
            both_ = [np.concatenate((old, new[order])) for old, new in zip(best, (whole, i, j))]
            top = np.lexsort((both_[2], both_[1], -both_[0]))[:k]
            best[:] = [x[top] for x in both_]
            out = np.concatenate((order, np.flatnonzero(unsure)))
            return {"i": i[out], "j": j[out], "ratio": ratio[out]}

        return take

    found = swept(side(objects), None, corners(), None, measure, "i long, j long, ratio double").withColumn("ratio", F.round("ratio", 9))
    return found.orderBy(F.col("ratio").desc(), "i", "j").limit(k)


#: Edges that a task holds before it lets go of those that are in no smallest tree.
EDGES = 1_000_000


def smallest_forest(i: np.ndarray, j: np.ndarray, w: np.ndarray, a: np.ndarray | None = None, b: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the edges of the smallest trees, in order of ``w``, ``i`` and ``j``: each tree so far takes its first edge to another. The nodes and the smallest one of the tree of each.

    Edges tie ``i`` and ``j`` or, if given, the nodes ``a`` and ``b``.
    """
    order = np.lexsort((j, i, w))
    nodes, ends = np.unique(np.concatenate(((i if a is None else a)[order], (j if b is None else b)[order])), return_inverse=True)
    u, v = ends[: len(order)], ends[len(order) :]
    tree, live, kept = np.arange(len(nodes)), np.arange(len(order)), [np.empty(0, dtype=int)]
    while True:
        a, b = tree[u[live]], tree[v[live]]
        apart = a != b
        live, a, b = live[apart], a[apart], b[apart]
        if not len(live):
            least = np.zeros(len(nodes), dtype=int)
            least[tree[::-1]] = np.arange(len(nodes))[::-1]
            return order[np.concatenate(kept)], nodes, nodes[least[tree]]
        first = np.full(len(nodes), len(order))
        first[a[::-1]] = live[::-1]  # the last one written is the first edge
        other = np.full(len(nodes), len(order))
        other[b[::-1]] = live[::-1]
        first = np.minimum(first, other)
        at = np.flatnonzero(first < len(order))
        edge = first[at]
        kept.append(np.unique(edge))
        a, b = tree[u[edge]], tree[v[edge]]
        to = np.arange(len(nodes))
        to[at] = np.where(a == at, b, a)
        back = at[(to[to[at]] == at) & (at < to[at])]  # two trees that take the same edge
        to[back] = back
        while (to[to] != to).any():
            to = to[to]
        tree = to[tree]


def overlap_forests(objects: DataFrame, least: float = 1e-9) -> DataFrame:
    """``i, j, w``: edges of boxes that share more than ``least``, with the larger share of either to six digits, among them all of the smallest trees; a task keeps those of its own smallest trees."""

    def measure():
        held: list[list[np.ndarray]] = []

        def small() -> list[np.ndarray]:
            x = [np.concatenate(c) for c in zip(*held)]
            at = smallest_forest(*x)[0]
            return [c[at] for c in x]

        def take(a: Side | None, b: Side | None) -> dict[str, np.ndarray] | None:
            if a is not None:
                a, b, inter = sharing(a, b, least, False)
                i, j = a["id"], b["id"]
                w = np.floor((np.maximum(inter / a["v"], inter / b["v"]) + 1e-9) * 1e6 + 0.5) / 1e6
                held.append([np.minimum(i, j), np.maximum(i, j), w])
                if sum(len(x[0]) for x in held) < EDGES:
                    return None
            if not held:
                return None
            kept = small()
            held[:] = [kept] if a is not None and len(kept[0]) < EDGES / 2 else []
            return None if held else dict(zip("ijw", kept))

        return take

    return swept(side(objects), None, corners(), None, measure, "i long, j long, w double", rest=True)


def best_matches(detections: DataFrame, objects: DataFrame, threshold: float, bias: float, penalty: float) -> DataFrame:
    """``det_id, obj_id, sim``: for detections the object with the highest (1 + bias) * spatial + (1 - bias) * visual, less a ``penalty`` where just one of both contains others, among
    those whose boxes meet theirs, if it is ``threshold`` at least; ties to the lowest identifier.

    Visual similarity is at most 1, so that vectors are compared only where the boxes leave room for the threshold, and a few rows a block leave a task. A vector with
    a null, without length or of another length than the object's is like none.
    """
    rows = [t.where(~F.exists("feat", lambda x: x.isNull())) for t in (detections, objects)]
    widest = max((t.agg(F.max(F.size("feat"))).first()[0] or 0) for t in rows)  # one row
    sides = []
    for t in rows:
        size, squares = F.size("feat"), F.aggregate("feat", F.lit(0.0), lambda acc, x: acc + x * x)
        flag = F.coalesce((F.col("contained") > 0).cast("int"), F.lit(-1))
        t = side(t.withColumns({"norm": F.sqrt(squares), "size": size, "held": flag, "vec": F.concat(F.col("feat").cast("array<double>"), F.array_repeat(F.lit(0.0), F.lit(widest) - size))}), "norm", "size", "held", "vec")
        sides.append(t)

    def measure():
        def take(a: Side, b: Side) -> dict[str, np.ndarray] | None:
            a, b, inter = sharing(a, b, 0.0, True)
            spatial = (1 + bias) * (inter / (a["v"] + b["v"] - inter + 1e-10))
            if -1 <= bias <= 1 and penalty >= 0:
                may = spatial + (1 - bias) + 1e-9 >= threshold
                a, b, spatial = a.only(may), b.only(may), spatial[may]
            if not len(spatial):
                return None
            size = a["size"]
            with np.errstate(invalid="ignore", divide="ignore"):
                visual = np.einsum("ij,ij->i", a["vec"], b["vec"]) / (a["norm"] * b["norm"])
            off = (a["held"] != b["held"]) & (a["held"] >= 0) & (b["held"] >= 0)
            sim = spatial + (1 - bias) * visual - np.where(off, penalty, 0.0)
            fit = np.flatnonzero((sim >= threshold) & (size == b["size"]))
            det, obj, sim = a["id"][fit], b["id"][fit], sim[fit]
            order = np.lexsort((obj, -sim, det))
            first = order[np.concatenate(([True], det[order][1:] != det[order][:-1]))] if len(order) else order
            return {"det_id": det[first], "obj_id": obj[first], "sim": sim[first]}

        return take

    found = swept(*sides, corners(), corners(), measure, "det_id long, obj_id long, sim double")
    best = found.groupBy("det_id").agg(F.max(F.struct("sim", (-F.col("obj_id")).alias("last"))).alias("b"))
    return best.select("det_id", (-F.col("b.last")).alias("obj_id"), "b.sim")
