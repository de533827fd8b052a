"""Building the object map: matching detections to objects, fusing points and features, merging and cleaning."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes
from ..functions.relations import broadcast_blocks, norm, radius_join
from ..functions.trees import numbered
from ..functions.vectors import cosine, normalise
from ..storage import cut as _cut
from .overlaps import best_matches, box_overlaps


def match_detections(detections: DataFrame, objects: DataFrame, threshold: float = 1.2, bias: float = 0.0, penalty: float = 0.0, meeting: bool = False) -> DataFrame:
    """``det_id, obj_id, sim``: for each detection the best object by (1 + bias) * spatial + (1 - bias) * visual, null only below ``threshold``.

    Boxes that don't meet have no spatial similarity, and visual similarity is at most 1, so with a threshold above 1 - bias only
    boxes that meet can match: the pairs come from a sweep. With a lower one visual similarity
    alone can do, and each detection is held against every object, a counted block of them at a time. ``meeting`` asks for objects whose box meets the detection's only,
    whatever the threshold. ``penalty`` is taken off where just one of the two contains others.
    """
    if meeting or threshold > 1 - bias + 1e-9 and -1 <= bias <= 1 and penalty >= 0:
        best = best_matches(detections, objects, threshold, bias, penalty)
        return detections.select(F.col("obj_id").alias("det_id")).join(best, "det_id", "left")
    d = detections.select(F.col("obj_id").alias("det_id"), *(F.col(c).alias(f"d_{c}") for c in ("cx", "cy", "cz", "ex", "ey", "ez", "feat", "contained")))
    a = boxes.corners(tuple(F.col(f"d_{c}") for c in ("cx", "cy", "cz")), tuple(F.col(f"d_{c}") for c in ("ex", "ey", "ez")))
    b = boxes.corners(tuple(F.col(c) for c in ("cx", "cy", "cz")), tuple(F.col(c) for c in ("ex", "ey", "ez")))
    parts = [d.crossJoin(block) for block in broadcast_blocks(objects, "obj_id")]
    volumes = tuple(F.col(f"{side}ex") * F.col(f"{side}ey") * F.col(f"{side}ez") for side in ("d_", ""))
    sim = (1 + bias) * boxes.iou(a, b, volumes=volumes) + (1 - bias) * cosine(F.col("d_feat"), F.col("feat")) - F.when((F.col("d_contained") > 0) != (F.col("contained") > 0), penalty).otherwise(0.0)
    first = F.max(F.struct("sim", (-F.col("obj_id")).alias("last"))).alias("b")
    best = reduce(DataFrame.unionByName, [p.select("det_id", "obj_id", sim.alias("sim")).where(F.col("sim") >= threshold).groupBy("det_id").agg(first) for p in parts])
    best = (best if len(parts) == 1 else best.groupBy("det_id").agg(F.max("b").alias("b"))).select("det_id", (-F.col("b.last")).alias("obj_id"), "b.sim")
    return detections.select(F.col("obj_id").alias("det_id")).join(best, "det_id", "left")


def voxel_fusion(points: DataFrame, size: float, least: int = 2, values: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Weighted means (weight ``w``) of points by voxel ``floor(p / size)``, with at least ``least`` observations; partial sums meet in the shuffle."""
    keys = [F.floor(F.col(c) / size).cast("long").alias(f"v{c}") for c in ("x", "y", "z")]
    means = [(F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(c) for c in values]
    return points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *means).where(F.col("n") >= least)


def point_overlap(points: DataFrame, voxel: float) -> DataFrame:
    """``i, j, ratio``: the share of object i's points that have a point of j nearer than ``voxel``; not symmetric.

    A point's cell is part of what is told apart, so that pairs of points stay in the task that forms them and only counts of objects are shuffled.
    """
    a = points.select(F.col("obj_id").alias("i"), F.col("pt").alias("a"), "x", "y", "z")
    b = points.select(F.col("obj_id").alias("j"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("z").alias("bz"))
    near = radius_join(a, b, voxel, (F.col("i") != F.col("j")) & (norm(F.col("x") - F.col("bx"), F.col("y") - F.col("by"), F.col("z") - F.col("bz")) < voxel), ("x", "y"), ("bx", "by"), cells=True)
    hits = near.select("__g0", "__g1", "i", "j", "a").distinct().groupBy("i", "j").agg(F.count(F.lit(1)).alias("hits"))
    return hits.join(points.groupBy(F.col("obj_id").alias("i")).agg(F.count(F.lit(1)).alias("size")), "i").select("i", "j", (F.col("hits") / F.col("size")).alias("ratio"))


def box_pairs(detections: DataFrame, cell: float = 100.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """``view_id, det, other, inter, area, other_area``: pairs of different boxes of a view that meet, each both ways, and columns of the other one to ``carry``.

    Boxes are dealt to the grid cells that they cover, and a pair comes out of the cell that holds the corner where it begins to meet.
    """
    cols = ("x1", "y1", "x2", "y2")
    covered = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell).cast("int"), F.floor(F.col(hi) / cell).cast("int"))
    a = detections.where("x2 > x1 AND y2 > y1").select("view_id", "det", *cols, *carry).withColumn("gx", F.explode(covered("x1", "x2"))).withColumn("gy", F.explode(covered("y1", "y2")))
    b = a.select("view_id", "gx", "gy", F.col("det").alias("other"), *(F.col(c).alias(f"o{c}") for c in cols), *carry)
    a = a.drop(*carry)
    left, top = F.greatest("x1", "ox1"), F.greatest("y1", "oy1")
    w, h = F.least("x2", "ox2") - left, F.least("y2", "oy2") - top
    first = (F.floor(left / cell) == F.col("gx")) & (F.floor(top / cell) == F.col("gy"))
    pairs = a.join(b, ["view_id", "gx", "gy"]).where((F.col("det") != F.col("other")) & first & (w > 0) & (h > 0))
    return pairs.select("view_id", "det", "other", (w * h).alias("inter"), ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("area"), ((F.col("ox2") - F.col("ox1")) * (F.col("oy2") - F.col("oy1"))).alias("other_area"), *carry)


def contained_counts(detections: DataFrame, share: float = 0.95) -> DataFrame:
    """``view_id, det, n``: in each view, how many other boxes hold more than ``share`` of a box's area; rows of one ``det`` count together, and not each other.

    Equal boxes of a view are one kind of box with a count, and kinds are held against each other, so that repeated boxes form no pairs. What rows of
    the same ``det`` hold of each other, each itself included, is taken off.
    """
    box = ["x1", "y1", "x2", "y2"]
    rows = detections.select("view_id", "det", *box)
    kinds = _cut(rows.groupBy("view_id", *box).agg(F.count(F.lit(1)).alias("m")).select("view_id", *box, "m", F.monotonically_increasing_id().alias("det")), "kinds")
    held = box_pairs(kinds, carry=("m",)).where(F.col("inter") > share * F.col("area")).groupBy("view_id", "det").agg(F.sum("m").alias("held"))
    own = F.when((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")), F.col("m")).otherwise(0)
    told = kinds.join(held, ["view_id", "det"], "left").select("view_id", *box, (F.coalesce("held", F.lit(0)) + own).alias("held"))
    same = reduce(Column.__and__, [F.col(f"r.{c}").eqNullSafe(F.col(f"k.{c}")) for c in ("view_id", *box)])
    total = rows.alias("r").join(told.alias("k"), same).groupBy("r.view_id", "r.det").agg(F.sum("held").alias("all"))
    w, h = (F.greatest(F.lit(0.0), F.least(f"a.{c}2", f"b.{c}2") - F.greatest(f"a.{c}1", f"b.{c}1")) for c in "xy")
    mine = rows.alias("a").join(rows.alias("b"), (F.col("a.view_id") == F.col("b.view_id")) & (F.col("a.det") == F.col("b.det")))
    mine = mine.where(w * h > share * ((F.col("a.x2") - F.col("a.x1")) * (F.col("a.y2") - F.col("a.y1")))).groupBy("a.view_id", "a.det").agg(F.count(F.lit(1)).alias("mine"))
    n = total.join(mine, ["view_id", "det"], "left").select("view_id", "det", (F.col("all") - F.coalesce("mine", F.lit(0))).alias("n"))
    return detections.select("view_id", "det").join(n, ["view_id", "det"], "left").select("view_id", "det", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def holding_pairs(detections: DataFrame, largest_share: float = 0.7, least_share: float = 0.8) -> DataFrame:
    """``view_id, det, other``: box ``other`` lies in box ``det``, whose mask it is to be taken from."""
    inside = (F.col("inter") / F.col("area") < largest_share) & (F.col("inter") / F.col("other_area") > least_share)
    return box_pairs(detections).where(inside).select("view_id", "det", "other", "inter", "area")


def filter_detections(detections: DataFrame, background: tuple[str, ...] = ("wall", "floor", "ceiling"), least_area: float = 25.0, largest_share: float = 0.5, least_conf: float = 0.25, image_area: float = 1200.0 * 680.0) -> DataFrame:
    """Detections large enough, confident enough and, unless background, not larger than a share of the image: one conjunctive filter."""
    box = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return detections.where((F.col("pixel_area") >= max(least_area, 10.0)) & (F.col("category").isin(*background) | (box <= largest_share * image_area)) & (F.col("conf") >= least_conf))


def suppress(frame: pd.DataFrame, limit: float = 0.5) -> pd.DataFrame:
    """Greedy suppression in one frame: by confidence, boxes that overlap a kept one by more than ``limit`` go."""
    f = frame.sort_values(["conf", "det"], ascending=[False, True])
    x1, y1, x2, y2 = (f[c].to_numpy() for c in ("x1", "y1", "x2", "y2"))
    area = (x2 - x1) * (y2 - y1)
    alive = np.ones(len(f), dtype=bool)
    for k in range(len(f)):
        if alive[k]:
            w = np.maximum(0, np.minimum(x2[k], x2[k + 1 :]) - np.maximum(x1[k], x1[k + 1 :]))
            h = np.maximum(0, np.minimum(y2[k], y2[k + 1 :]) - np.maximum(y1[k], y1[k + 1 :]))
            inter = w * h
            alive[k + 1 :] &= inter / (area[k] + area[k + 1 :] - inter) <= limit
    return f[alive]


#: Boxes of the first batch of suppression, and how many times as many the next one asks for.
BATCH, GROWTH = 32768, 8
_PLACE = ["view_id", "__lx", "__ly", "__gx", "__gy"]


def _level(lo: str, hi: str, limit: float) -> Column:
    return F.floor(F.log(F.col(hi) - F.col(lo)) / F.log(F.lit(1 / limit))).cast("long")


def _placed(f: DataFrame, limit: float) -> DataFrame:
    """Boxes with the class of their width and height (``__lx, __ly``) and the cell of their centre (``__gx, __gy``), twice as wide as boxes of the class are at most."""
    f = f.withColumns({f"__l{c}": _level(f"{c}1", f"{c}2", limit) for c in "xy"})
    return f.withColumns({f"__g{c}": F.floor((F.col(f"{c}1") + F.col(f"{c}2")) / 2 / _cell_of(F.col(f"__l{c}"), limit)).cast("long") for c in "xy"})


def _cell_of(level: Column, limit: float) -> Column:
    return 2 * F.pow(F.lit(1 / limit), level + 1)


def _reached_cells(f: DataFrame, limit: float) -> DataFrame:
    """Placed boxes as ``s_<column>``, in each class and cell in which a box may overlap them by more than ``limit``.

    The sides of such boxes are in a proportion above ``limit``, and their centres less than the longer side times 1 - ``limit`` apart.
    """
    s = f.select("view_id", "number", "x1", "y1", "x2", "y2", "__lx", "__ly").withColumnsRenamed({c: f"s_{c}" for c in ("number", "x1", "y1", "x2", "y2")})
    for c in "xy":
        s = s.withColumn(f"__l{c}", F.explode(F.array(*[F.col(f"__l{c}") + k for k in (-1, 0, 1)])))
        size, centre = _cell_of(F.col(f"__l{c}"), limit), (F.col(f"s_{c}1") + F.col(f"s_{c}2")) / 2
        far = (1 - limit) * F.greatest(F.col(f"s_{c}2") - F.col(f"s_{c}1"), size / 2) * (1 + 1e-9)
        s = s.withColumn(f"__g{c}", F.explode(F.sequence(F.floor((centre - far) / size).cast("long"), F.floor((centre + far) / size).cast("long"))))
    return s


def _overlap_more(limit: float) -> Column:
    w, h = (F.greatest(F.lit(0.0), F.least(f"s_{c}2", f"{c}2") - F.greatest(f"s_{c}1", f"{c}1")) for c in "xy")
    area = (F.col("s_x2") - F.col("s_x1")) * (F.col("s_y2") - F.col("s_y1")) + (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return w * h / (area - w * h) > limit


def _kept_of(batch: DataFrame, limit: float) -> DataFrame:
    """The rows of a placed batch that greedy suppression keeps: in rounds over the pairs that overlap, a box without an undecided stronger one is kept and its neighbours go."""
    pairs = _cut(_reached_cells(batch, limit).join(batch, _PLACE).where((F.col("s_number") < F.col("number")) & _overlap_more(limit)).select(F.col("s_number").alias("s"), F.col("number").alias("w")))
    gone = pairs.limit(0).select(F.col("w").alias("number"))
    while not pairs.isEmpty():
        kept = pairs.select("s").distinct().join(pairs.select(F.col("w").alias("s")).distinct(), "s", "left_anti")
        out = _cut(pairs.join(kept, "s").select(F.col("w").alias("number")).distinct())
        gone = gone.unionByName(out)
        pairs = _cut(pairs.join(out.withColumnRenamed("number", "s"), "s", "left_anti").join(out.withColumnRenamed("number", "w"), "w", "left_anti").select("s", "w"))
    return batch.join(gone, "number", "left_anti")


def non_maximum_suppression(detections: DataFrame, limit: float = 0.5) -> DataFrame:
    """Greedy suppression frame by frame: by confidence, boxes that overlap a kept one by more than ``limit``, between 0 and 1, go.

    In batches of all frames in this order, each larger than the one before: what a batch keeps takes away all weaker boxes before the next batch is formed, so that
    pairs are formed only among boxes that no stronger batch covers, and no frame meets in one task. Of equal boxes of a frame the strongest alone can be kept. Boxes
    without area overlap nothing, and rows of them that are equal in all columns count as one.
    """
    if not 0 < limit < 1:
        raise ValueError(f"limit {limit} is not between 0 and 1")
    flat = ~F.coalesce((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")), F.lit(False))
    out, box = detections.where(flat).distinct(), ("view_id", "x1", "y1", "x2", "y2")
    others = [c for c in detections.columns if c not in (*box, "det")]
    first = F.min(F.struct(F.coalesce(-F.col("conf"), F.lit(float("inf"))).alias("__c"), "det", *others)).alias("__b")
    boxes_ = detections.where(~flat).groupBy(*box).agg(first).select(*box, "__b.*")
    rest = _cut(_placed(numbered(boxes_, "__c", "det", *box), limit).drop("__c"), "boxes")
    size, left = BATCH, rest.count()
    while left:
        end = None
        if left > 2 * size:  # about so many of the strongest that are left
            end = int(rest.approxQuantile("number", [size / left], min(0.01, size / left / 4))[0]) + 1
        kept = _cut(_kept_of(_cut(rest if end is None else rest.where(F.col("number") < end), "batch"), limit), "kept")
        out = out.unionByName(kept.select(*detections.columns))
        if end is None:
            break
        rest = _cut(_uncovered(rest.where(F.col("number") >= end), kept, limit), "boxes")
        size, left = size * GROWTH, rest.count()
    return out


def _uncovered(weaker: DataFrame, kept: DataFrame, limit: float) -> DataFrame:
    """Placed boxes that overlap none of the kept ones by more than ``limit``."""
    strong = _reached_cells(kept, limit).withColumnsRenamed({c: f"s_{c}" for c in _PLACE})
    same = reduce(Column.__and__, [F.col(c) == F.col(f"s_{c}") for c in _PLACE])
    return weaker.join(strong, same & _overlap_more(limit), "left_anti")


def merge_features(contributions: DataFrame) -> DataFrame:
    """``obj_id, n, feat``: feature vectors folded in the order of ``seq``, each step weighted by counts and normalised.

    The fold depends on its order, so an object's contributions pass through one task, sorted; it holds one vector, whatever their number.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, obj, total, vector = False, None, 0, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([obj], pa.int64()), pa.array([total], pa.int64()), pa.array([vector.tolist()], pa.list_(pa.float64()))], ["obj_id", "n", "feat"])

        for batch in batches:
            for o, n, v in zip(*(c.to_pylist() for c in batch.columns)):
                if seen and o != obj:
                    yield row()
                    total, vector = 0, None
                seen, obj = True, o
                v = np.asarray(v, dtype=float)
                vector = v if vector is None else (vector * total + v * n) / (total + n)
                vector = vector / max(np.linalg.norm(vector), 1e-8)
                total += n
        if seen:
            yield row()

    rows = contributions.select(F.col("obj_id").cast("long").alias("obj_id"), F.col("n").cast("long").alias("n"), F.col("feat").cast("array<double>").alias("feat"), "seq")
    return rows.repartition("obj_id").sortWithinPartitions("obj_id", "seq").select("obj_id", "n", "feat").mapInArrow(fold, "obj_id long, n long, feat array<double>")


def grid_regions(objects: DataFrame, k: int) -> DataFrame:
    """``obj_id, region``: cells of a grid with the cube root of ``k`` cells a side over the objects' bounds, numbered by cell."""
    g = int(np.ceil(round(k ** (1 / 3), 9)))
    bounds = objects.agg(*(f(c).alias(f"__{n}{c}") for c in ("cx", "cy", "cz") for n, f in (("lo", F.min), ("hi", F.max))))
    def cell(c: str) -> Column:
        return F.floor((F.col(c) - F.col(f"__lo{c}")) / F.greatest(F.col(f"__hi{c}") - F.col(f"__lo{c}"), F.lit(1e-8)) * (g - 0.01)).cast("long")
    marked = objects.crossJoin(F.broadcast(bounds)).select("obj_id", (cell("cx") * g * g + cell("cy") * g + cell("cz")).alias("cell"))  # one row
    numbered = marked.select("cell").distinct().withColumn("region", F.row_number().over(Window.orderBy("cell")) - 1)
    return marked.join(F.broadcast(numbered), "cell").select("obj_id", "region")  # a row for each cell of the grid


def point_overlap_between(new: DataFrame, old: DataFrame, voxel: float) -> DataFrame:
    """``i, j, ratio``: the share of a new object's points that have a point of map object j nearer than ``voxel``; objects whose bounds don't meet have none.

    Pairs of points stay in the task that forms them, as in ``point_overlap``.
    """
    a = new.select(F.col("obj_id").alias("i"), F.col("pt").alias("a"), "x", "y", "z")
    b = old.select(F.col("obj_id").alias("j"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("z").alias("bz"))
    near = radius_join(a, b, voxel, norm(F.col("x") - F.col("bx"), F.col("y") - F.col("by"), F.col("z") - F.col("bz")) < voxel, ("x", "y"), ("bx", "by"), cells=True)
    hits = near.select("__g0", "__g1", "i", "j", "a").distinct().groupBy("i", "j").agg(F.count(F.lit(1)).alias("hits"))
    hits = hits.join(new.groupBy(F.col("obj_id").alias("i")).agg(F.count(F.lit(1)).alias("size"), *_bounds("i")), "i")
    hits = hits.join(old.groupBy(F.col("obj_id").alias("j")).agg(*_bounds("j")), "j")
    meet = None
    for c in "xyz":
        apart = F.least(F.col(f"i_hi_{c}"), F.col(f"j_hi_{c}")) > F.greatest(F.col(f"i_lo_{c}"), F.col(f"j_lo_{c}"))
        meet = apart if meet is None else meet & apart
    return hits.where(meet).select("i", "j", (F.col("hits") / F.col("size")).alias("ratio"))


def _bounds(side: str) -> list[Column]:
    return [f(c).alias(f"{side}_{n}_{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]


def overlap_merges(pairs: DataFrame, threshold: float, visual: float, text: float) -> DataFrame:
    """``i, j, ratio``: which objects are merged into which, from pairs ``i, j, ratio, visual, text``.

    Pairs are taken by falling ratio, ties by identifiers: ``i`` goes into ``j`` if ratio and both similarities are above their thresholds and
    ``j`` hasn't gone itself; one that went may go again. In rounds: a pair waits while an earlier pair of its ``j`` is undecided.
    """
    order = F.struct((-F.col("ratio")).alias("r"), "i", "j")
    waiting = _cut(pairs.where((F.col("ratio") > threshold) & (F.col("visual") > visual) & (F.col("text") > text)).select("i", "j", "ratio", order.alias("at")))
    done = waiting.limit(0)
    while not waiting.isEmpty():
        gone = done.groupBy(F.col("i").alias("j")).agg(F.min("at").alias("gone"))
        unsure = waiting.groupBy(F.col("i").alias("j")).agg(F.min("at").alias("unsure"))
        seen = waiting.join(gone, "j", "left").join(unsure, "j", "left")
        state = F.when(F.col("gone") < F.col("at"), F.lit("no")).when(F.col("unsure") < F.col("at"), F.lit("wait")).otherwise(F.lit("yes"))
        seen = _cut(seen.select("i", "j", "ratio", "at", state.alias("state")))
        done = done.unionByName(seen.where("state = 'yes'").drop("state"))
        waiting = seen.where("state = 'wait'").drop("state")
    return done.select("i", "j", "ratio")


def spatial_similarities(detections: DataFrame, objects: DataFrame, kind: str, detection_points: DataFrame | None = None, object_points: DataFrame | None = None, voxel: float = 0.025) -> DataFrame:
    """``det_id, obj_id, sim`` of a kind: iou, giou, iou_accurate, giou_accurate (boxes with ``yaw``) or overlap (of points); another kind is a ValueError.

    Pairs whose boxes don't meet are left out: their similarity is 0, or below it for the two giou.
    """
    if kind == "overlap":
        if detection_points is None or object_points is None:
            raise ValueError("overlap needs the points of both sides")
        return point_overlap_between(detection_points, object_points, voxel).select(F.col("i").alias("det_id"), F.col("j").alias("obj_id"), F.col("ratio").alias("sim"))
    if kind in ("iou_accurate", "giou_accurate"):
        from .oriented import similarities

        found = similarities(detections, kind == "giou_accurate", objects).where("inter > 0")
        return found.select(F.col("i").alias("det_id"), F.col("j").alias("obj_id"), F.col(kind.removesuffix("_accurate")).alias("sim"))
    return spatial_similarities_of(detections, objects, (kind,)).drop("kind")


def spatial_similarities_of(detections: DataFrame, objects: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """``kind, det_id, obj_id, sim`` of several kinds, iou or giou; pairs are formed once."""
    for kind in kinds:
        if kind not in ("iou", "giou"):
            raise ValueError(f"unknown spatial similarity {kind!r}")
    met = box_overlaps(detections, "va", "vb", *(["hull"] if "giou" in kinds else []), others=objects, least=0.0)
    inter, union = F.col("inter"), F.col("va") + F.col("vb") - F.col("inter")
    sims = {"iou": inter / (union + 1e-10)} | ({"giou": inter / (union + 1e-10) - (F.col("hull") - union) / (F.col("hull") + 1e-10)} if "giou" in kinds else {})
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), sims[k].alias("sim")) for k in kinds)))
    return met.select(F.col("i").alias("det_id"), F.col("j").alias("obj_id"), each.alias("e")).select("e.kind", "det_id", "obj_id", "e.sim")


def merge_objects(pairs: DataFrame, features: DataFrame, text_features: DataFrame, threshold: float, visual: float = 0.7, text: float = 0.7) -> DataFrame:
    """``i, j, ratio``: the merges of ``overlap_merges``, from pairs ``i, j, ratio`` and the vectors of objects; none if the threshold isn't above 0."""
    if threshold <= 0:
        return pairs.limit(0).select("i", "j", "ratio")
    near = pairs.where(F.col("ratio") > threshold).select("i", "j", "ratio")
    for name, table in (("visual", features), ("text", text_features)):
        one = lambda side: table.select(F.col("obj_id").alias(side), F.col("feat").alias(f"__{side}"))  # noqa: B023, E731
        near = near.join(one("i"), "i").join(one("j"), "j").withColumn(name, F.round(cosine(F.col("__i"), F.col("__j")), 9)).drop("__i", "__j")
    return overlap_merges(near, threshold, visual, text)


def object_filter(points: DataFrame, detections: DataFrame, least_points: int, least_detections: int) -> DataFrame:
    """``obj_id, points, detections`` of objects with enough of both."""
    n = points.groupBy("obj_id").agg(F.count(F.lit(1)).alias("points")).where(F.col("points") >= least_points)
    m = detections.groupBy("obj_id").agg(F.count(F.lit(1)).alias("detections")).where(F.col("detections") >= least_detections)
    return n.join(m, "obj_id")


def multiview_mean(rows: DataFrame, key: str, feature: str = "feat") -> DataFrame:
    """``key, feat``: the sum of what views say about a point over their number, which counts as 1e-5 where it is 0."""
    dims = rows.select(key, F.posexplode(feature).alias("k", "v")).groupBy(key, "k").agg((F.sum("v") / F.greatest(F.count("v").cast("double"), F.lit(1e-5))).alias("v"))
    return dims.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("feat"))


def voxel_features(points: DataFrame, size: float, least: int = 2) -> DataFrame:
    """``vx, vy, vz, n, feat``: weighted mean features (weight ``w``) of voxels with ``least`` observations, to unit length; sums of each dimension meet in the shuffle."""
    keys = [F.floor(F.col(c) / size).cast("long").alias(f"v{c}") for c in "xyz"]
    dims = points.select(*keys, "w", F.posexplode("feat").alias("k", "f")).groupBy("vx", "vy", "vz", "k").agg((F.sum(F.col("w") * F.col("f")) / F.sum("w")).alias("f"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    whole = dims.groupBy("vx", "vy", "vz").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("k", "f"))), lambda x: x["f"]).alias("feat"))
    return whole.withColumn("feat", normalise(F.col("feat")))
