"""Which camera views show an object: scores, rankings, and views that cover objects together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.relations import BROADCAST_ROWS, norm, radius_join
from ..storage import cut

MAX_DISTANCE = 5.0
IMAGE_WIDTH, IMAGE_HEIGHT, FOCAL = 1200.0, 680.0, 600.0


# What each part of a view's score weighs.
WEIGHTS = {"visibility": 0.25, "quality": 0.15, "resolution": 0.20, "occlusion": 0.15, "semantic": 0.25}


def composite_score(visible: Column, quality: Column, resolution: Column, occlusion: Column, semantic: Column, weights: dict[str, float] | None = None) -> Column:
    """A view's score; ``weights`` replace some of ``WEIGHTS``."""
    if unknown := {*(weights or {})} - {*WEIGHTS}:
        raise ValueError(f"unknown parts of a score: {sorted(unknown)}")
    w = WEIGHTS | (weights or {})
    return w["visibility"] * visible + w["quality"] * quality + w["resolution"] * F.least(resolution / 100, F.lit(1.0)) + w["occlusion"] * (1 - occlusion) + w["semantic"] * semantic


def _in_reach(objects: DataFrame, poses: DataFrame, name: str) -> DataFrame:
    """Objects and the views within reach, with their distance ``name``. Views that are few enough, which are counted, are broadcast, so that all tasks share the work however few cells there are."""
    views = cut(poses, "views")
    dist = norm(F.col("cx") - F.col("px"), F.col("cy") - F.col("py"), F.col("cz") - F.col("pz"))
    dealt = objects.select("obj_id", "cx", "cy", "cz").repartition(int(objects.sparkSession.conf.get("spark.sql.shuffle.partitions")), "obj_id")
    return radius_join(dealt, views, MAX_DISTANCE, dist <= MAX_DISTANCE, ("cx", "cy"), ("px", "py"), few=views.count() <= BROADCAST_ROWS).withColumn(name, dist)


def visibility(objects: DataFrame, poses: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``obj_id, view_id, distance, score`` of views within reach, found on a grid."""
    pairs = _in_reach(objects, poses, "distance")
    visible = F.greatest(F.lit(0.0), 1 - F.col("distance") / MAX_DISTANCE)
    ahead = ((F.col("cx") - F.col("px")) * F.col("fwx") + (F.col("cy") - F.col("py")) * F.col("fwy") + (F.col("cz") - F.col("pz")) * F.col("fwz")) / F.greatest(F.col("distance"), F.lit(1e-8))
    score = composite_score(visible, F.greatest(F.lit(0.0), ahead), FOCAL / F.greatest(F.col("distance"), F.lit(0.1)), F.lit(0.0), F.lit(0.0), weights)
    return pairs.where(visible >= 0.1).select("obj_id", "view_id", "distance", score.alias("score"))


def detection_visibility(detections: DataFrame, objects: DataFrame, poses: DataFrame) -> DataFrame:
    """``obj_id, view_id, n, score`` from detections: how complete, how well placed and how large an object is in a view."""
    area = IMAGE_WIDTH * IMAGE_HEIGHT
    clipped = ((F.col("x1") < 10) | (F.col("y1") < 10) | (F.col("x2") > IMAGE_WIDTH - 10) | (F.col("y2") > IMAGE_HEIGHT - 10)).cast("double")
    complete = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) / (0.3 * area)) - 0.3 * clipped)
    per = detections.groupBy("obj_id", "view_id").agg(F.max(complete).alias("complete"), F.max(F.least(F.lit(1.0), F.col("pixel_area") / (0.2 * area))).alias("quality"), F.count(F.lit(1)).alias("n"))
    quality = F.when(F.col("quality") > 0, F.col("quality")).otherwise(F.least(F.lit(1.0), F.col("n") / 3))
    joined = per.join(objects.select("obj_id", "cx", "cy", "cz"), "obj_id").join(poses, "view_id")
    d = norm(F.col("cx") - F.col("px"), F.col("cy") - F.col("py"), F.col("cz") - F.col("pz"))
    behind = -((F.col("cx") - F.col("px")) * F.col("fwx") + (F.col("cy") - F.col("py")) * F.col("fwy") + (F.col("cz") - F.col("pz")) * F.col("fwz")) / F.greatest(d, F.lit(1e-8))
    geo = F.when(d > MAX_DISTANCE, 0.0).otherwise(0.6 * F.greatest(F.lit(0.0), 1 - d / MAX_DISTANCE) + 0.4 * F.greatest(F.lit(0.0), behind))
    return joined.select("obj_id", "view_id", "n", (0.5 * F.col("complete") + 0.3 * geo + 0.2 * quality).alias("score"))


def top_per(rows: DataFrame, key: str, k: int, tie: str, min_score: float | None = None) -> DataFrame:
    """The ``k`` best rows of each key, with their ``rank``; Spark keeps ``k`` rows a task before it shuffles."""
    rows = rows if min_score is None else rows.where(F.col("score") >= min_score)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.col("score").desc(), tie))).where(F.col("rank") <= k)


def top_of_many(rows: DataFrame, key: str, k: int, tie: str, min_score: float | None = None) -> DataFrame:
    """``top_per`` for keys of very many rows each, which aren't sorted: of the best scores of parts of a key's rows, the k-th says what a row of its first ``k`` scores at least."""
    rows = rows if min_score is None else rows.where(F.col("score") >= min_score)
    parts = rows.groupBy(key, F.pmod(F.xxhash64(tie), F.lit(8 * k)).alias("__part")).agg(F.max("score").alias("__best"))
    least = cut(parts.groupBy(key).agg(F.try_element_at(F.sort_array(F.collect_list("__best"), asc=False), F.lit(k)).alias("__least")), "least")
    return top_per(rows.join(least, key).where("__least IS NULL OR score >= __least").drop("__least"), key, k, tie)


def joint_coverage(scores: DataFrame, k: int) -> DataFrame:
    """``round, view_id, gain``: ``k`` views chosen one after another, each the one that adds most to what objects are covered by.

    A round is a join with the cover so far and a top-1; a round without gain ends the list. Ties go to the lowest view. The scores and each round's view and
    cover are written, so that the work grows with the rounds.
    """
    scores = cut(scores.select("obj_id", "view_id", "score"), "scores")
    chosen: list[DataFrame] = []
    cover = scores.select("obj_id").distinct().withColumn("covered", F.lit(0.0))
    for n in range(1, k + 1):
        gains = scores.join(cover, "obj_id").groupBy("view_id").agg(F.sum(F.greatest(F.lit(0.0), F.col("score") - F.col("covered"))).alias("gain"))
        best = cut(gains.where("gain > 0").orderBy(F.col("gain").desc(), "view_id").limit(1).withColumn("round", F.lit(n)).select("round", "view_id", "gain"), "view")
        chosen.append(best)
        added = scores.join(F.broadcast(best.select("view_id")), "view_id").select("obj_id", F.col("score").alias("added"))  # one view
        if n < k:
            cover = cut(cover.join(added, "obj_id", "left").select("obj_id", F.greatest("covered", F.coalesce("added", F.lit(0.0))).alias("covered")), "cover")
    return reduce(DataFrame.unionByName, chosen)


def _geometric(objects: DataFrame, poses: DataFrame) -> DataFrame:
    """``obj_id, view_id, geo`` of views within reach: how near an object is and how far it is ahead."""
    return _in_reach(objects, poses, "d").select("obj_id", "view_id", _geo().alias("geo"))


def _geo() -> Column:
    """What a view at the distance ``d`` scores by that alone and by how far an object is ahead."""
    ahead = -((F.col("cx") - F.col("px")) * F.col("fwx") + (F.col("cy") - F.col("py")) * F.col("fwy") + (F.col("cz") - F.col("pz")) * F.col("fwz")) / (F.col("d") + 1e-8)
    return 0.6 * F.greatest(F.lit(0.0), 1 - F.col("d") / MAX_DISTANCE) + 0.4 * F.greatest(F.lit(0.0), ahead)


def geometric_visibility(objects: DataFrame, poses: DataFrame) -> DataFrame:
    """``obj_id, view_id, score`` above 0.1, for objects without detections."""
    return _geometric(objects, poses).where("geo > 0.1").select("obj_id", "view_id", F.col("geo").alias("score"))


def online_visibility(detections: DataFrame, objects: DataFrame, poses: DataFrame) -> DataFrame:
    """``obj_id, view_id, score`` as ``detection_visibility`` has it, the quality from the number of detections alone."""
    area = IMAGE_WIDTH * IMAGE_HEIGHT
    clipped = ((F.col("x1") < 10) | (F.col("y1") < 10) | (F.col("x2") > IMAGE_WIDTH - 10) | (F.col("y2") > IMAGE_HEIGHT - 10)).cast("double")
    complete = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) / (0.3 * area)) - 0.3 * clipped)
    per = detections.groupBy("obj_id", "view_id").agg(F.max(complete).alias("complete"), F.count(F.lit(1)).alias("n"))
    d = norm(F.col("cx") - F.col("px"), F.col("cy") - F.col("py"), F.col("cz") - F.col("pz"))
    known = per.join(objects.select("obj_id", "cx", "cy", "cz"), "obj_id").join(poses, "view_id").withColumn("d", d).withColumn("geo", F.when(F.col("d") <= MAX_DISTANCE, _geo()))
    return known.select("obj_id", "view_id", (0.5 * F.col("complete") + 0.3 * F.coalesce("geo", F.lit(0.0)) + 0.2 * F.least(F.lit(1.0), F.col("n") / 3)).alias("score"))
