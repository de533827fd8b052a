"""Vector search, regions, classification and its metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.relations import broadcast_blocks
from ..functions.vectors import cosine, normalise
from ..storage import cut
from .kmeans import kmeans


def vector_top_k(features: DataFrame, query: Column, k: int) -> DataFrame:
    """``obj_id, sim``, the ``k`` closest by cosine; every task keeps its ``k`` best. Null vectors are skipped."""
    return features.where("feat IS NOT NULL").select("obj_id", cosine(F.col("feat"), query).alias("sim")).orderBy(F.col("sim").desc(), "obj_id").limit(k)


def region_features(features: DataFrame) -> DataFrame:
    """``region, n, feat``: the mean vector of each region, by sums of each dimension, so that partial sums meet in the shuffle."""
    dims = features.select("region", F.posexplode("feat").alias("k", "v")).groupBy("region", "k").agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("n"))
    return dims.groupBy("region").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("feat"))


def explicit_regions(members: DataFrame, features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``obj_id, region`` and ``region, n, feat`` (unit vectors) from regions as lists of objects (``region, obj_ids``); an object in several is in the lowest."""
    own = members.select("region", F.explode("obj_ids").alias("obj_id")).groupBy("obj_id").agg(F.min("region").alias("region"))
    means = region_features(own.join(features.where("feat IS NOT NULL").select("obj_id", "feat"), "obj_id"))
    return own, means.withColumn("feat", normalise(F.col("feat")))


def hierarchical_search(features: DataFrame, query: Column, regions: int, k: int) -> DataFrame:
    """The ``k`` closest objects of the ``regions`` closest regions; of all regions if those hold fewer than ``k`` objects."""
    best = region_features(features).select("region", cosine(F.col("feat"), query).alias("rsim")).orderBy(F.col("rsim").desc(), "region").limit(regions).select("region")
    inside = vector_top_k(features.join(F.broadcast(best), "region", "left_semi"), query, k)
    enough = inside.agg((F.count(F.lit(1)) >= k).alias("enough"))
    both = inside.withColumn("of", F.lit(True)).unionByName(vector_top_k(features, query, k).withColumn("of", F.lit(False)))
    return both.crossJoin(F.broadcast(enough)).where(F.col("of") == F.col("enough")).select("obj_id", "sim")  # one row


def classify(features: DataFrame, classes: DataFrame, ignored: tuple[int, ...] = ()) -> DataFrame:
    """``obj_id, pred, sim``: the class whose vector is closest, ignored ones last; ties go to the lowest class. Classes are broadcast, a counted block at a time."""
    sim = cosine(F.col("feat"), F.col("cfeat"))
    sim = F.when(F.col("class_id").isin(*ignored), -1e10).otherwise(sim) if ignored else sim
    best = F.max(F.struct(sim.alias("sim"), (-F.col("class_id")).alias("minus"))).alias("b")
    each = [features.select("obj_id", "feat").crossJoin(block).groupBy("obj_id").agg(best) for block in broadcast_blocks(classes, "class_id")]
    whole = each[0] if len(each) == 1 else reduce(DataFrame.unionByName, each).groupBy("obj_id").agg(F.max("b").alias("b"))
    return whole.select("obj_id", (-F.col("b.minus")).alias("pred"), F.col("b.sim").alias("sim"))


def confusion(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("gt", "pred").agg(F.count(F.lit(1)).alias("n"))


def segmentation_metrics(matrix: DataFrame) -> DataFrame:
    """``class_id, iou, precision, recall, f1`` from ``gt, pred, n``, with denominators of at least 1, as the metric defines them."""
    gt = matrix.groupBy(F.col("gt").alias("class_id")).agg(F.sum("n").alias("g"), F.sum(F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    pred = matrix.groupBy(F.col("pred").alias("class_id")).agg(F.sum("n").alias("p"))
    m = gt.join(pred, "class_id", "full_outer").select("class_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("g", "tp", "p")))
    one = lambda c: F.greatest(F.lit(1.0), c)
    m = m.withColumn("iou", F.col("tp") / one(F.col("g") + F.col("p") - F.col("tp"))).withColumn("precision", F.col("tp") / one(F.col("p").cast("double"))).withColumn("recall", F.col("tp") / one(F.col("g").cast("double")))
    return m.select("class_id", "iou", "precision", "recall", (2 * F.col("precision") * F.col("recall") / one(F.col("precision") + F.col("recall"))).alias("f1"))


def min_max_scaled(rows: DataFrame, column: str) -> DataFrame:
    """``scaled``: a column mapped to 0..1 over all rows; the two bounds are one row, joined."""
    bounds = rows.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    return rows.crossJoin(F.broadcast(bounds)).withColumn("scaled", (F.col(column) - F.col("__lo")) / F.greatest(F.col("__hi") - F.col("__lo"), F.lit(1e-8))).drop("__lo", "__hi")


def mode_per(rows: DataFrame, key: str, value: str, *ties: str) -> DataFrame:
    """``key, value, n``: the most frequent value of each key; ties by the smallest of ``ties`` (or the value)."""
    first = [F.min(t).alias(f"__{t}") for t in ties]
    counts = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), *first)
    order = Window.partitionBy(key).orderBy(F.col("n").desc(), *(f"__{t}" for t in ties), value)
    return counts.withColumn("__r", F.row_number().over(order)).where("__r = 1").select(key, value, "n")


def metrics_summary(matrix: DataFrame, by: str | None = None) -> DataFrame:
    """One row (or one for each ``by``): ``classes, miou, fmiou`` and how many classes have an IoU above 0.15, 0.25, 0.5 and 0.75."""
    keys = [by] if by else []
    gt = matrix.groupBy(*keys, F.col("gt").alias("class_id")).agg(F.sum("n").alias("g"), F.sum(F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    pred = matrix.groupBy(*keys, F.col("pred").alias("class_id")).agg(F.sum("n").alias("p"))
    m = gt.join(pred, [*keys, "class_id"], "full_outer").select(*keys, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("g", "tp", "p")))
    m = m.withColumn("iou", F.col("tp") / F.greatest(F.lit(1.0), F.col("g") + F.col("p") - F.col("tp")))
    above = [F.sum((F.col("iou") > t).cast("long")).alias(f"acc_{int(t * 100)}") for t in (0.15, 0.25, 0.5, 0.75)]
    return m.groupBy(*keys).agg(F.count(F.lit(1)).alias("classes"), F.avg("iou").alias("miou"), (F.sum(F.col("iou") * F.col("g")) / F.sum("g")).alias("fmiou"), *above)


def softmax(rows: DataFrame, column: str) -> DataFrame:
    """``share``: exp of a column over its sum in all rows, after the largest value is taken off; the bounds are one row, joined."""
    top = rows.agg(F.max(column).alias("__top"))
    shifted = rows.crossJoin(F.broadcast(top)).withColumn("__e", F.exp(F.col(column) - F.col("__top")))
    return shifted.crossJoin(F.broadcast(shifted.agg(F.sum("__e").alias("__sum")))).withColumn("share", F.col("__e") / F.col("__sum")).drop("__e", "__sum", "__top")  # one row each


def closeness(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Mean and largest absolute difference of two vectors, and the mean difference against the second one's parts."""
    diff = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x) / F.size(v)
    return mean(diff), F.array_max(diff), mean(F.zip_with(diff, b, lambda d, y: d / (F.abs(y) + 1e-8)))


def mode_name(rows: DataFrame, key: str, name: str, order: str, stop: tuple[str, ...] = ()) -> DataFrame:
    """``key, name``: the most frequent name of each key, ties to the first in ``order``; the first one where all are stop-words."""
    counts = rows.groupBy(key, F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    stopped = F.col("name").isin(*stop)
    best = Window.partitionBy(key).orderBy(stopped, F.when(stopped, 0).otherwise(F.col("n")).desc(), "first")
    return counts.withColumn("r", F.row_number().over(best)).where("r = 1").select(key, "name")


def kmeans_regions(objects: DataFrame, regions: int | None = None, weight: float = 0.3, seed: int = 42, starts: int = 10) -> DataFrame:
    """``obj_id, region`` by k-means on places scaled to 0..1 and features to length ``weight``; objects without a place have no region.

    The number of regions is the root of that of objects, from 2 to 10. There is one region, of all, if there are fewer than 3 objects, or fewer with
    a place than regions. A null feature counts as zeros.
    """
    one = objects.select("obj_id", F.lit(0).alias("region"))
    placed = objects.where("cx IS NOT NULL AND cy IS NOT NULL AND cz IS NOT NULL")
    row = placed.agg(*(f(f"c{a}") for a in "xyz" for f in (F.min, F.max)), F.max(F.size("feat")), F.count(F.lit(1))).first()
    n, valid = objects.count(), row[-1]
    k = regions or max(2, min(10, int(n**0.5)))
    if n < 3 or valid < k:
        return one
    place = [(F.col(f"c{a}") - low) / (high - low + 1e-8) for a, low, high in zip("xyz", row[:-2:2], row[1:-2:2])]
    zeros = F.array_repeat(F.lit(0.0), max(row[-2] or 0, 0))
    x = F.concat(F.array(*place), F.coalesce(F.transform(normalise(F.col("feat")), lambda v: v * weight), zeros))
    rows = cut(placed.select(F.col("obj_id").cast("long").alias("id"), x.alias("x")), "places")
    return kmeans(rows, k, starts, seed=seed).select(F.col("id").alias("obj_id"), F.col("cluster").alias("region"))
