"""All indices of a scene, built under one path and opened again: features, visibility both ways, places, regions, points."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import normalise
from ..operators.retrieval import kmeans_regions, region_features
from ..operators.views import top_of_many, top_per, visibility
from . import spatial_index


@dataclass
class Indices:
    #: Unit vectors by object; null ones are left out.
    features: DataFrame
    #: The best views of each object, and the best objects of each view, by rank.
    views_of: DataFrame
    objects_in: DataFrame
    #: The region of each object, and the mean vector of each region.
    regions: DataFrame
    region_features: DataFrame
    #: Objects' places and points, in files by place.
    places: spatial_index.SpatialIndex
    points: spatial_index.SpatialIndex


def build_indices(objects: DataFrame, poses: DataFrame, features: DataFrame, points: DataFrame, path: str, regions: DataFrame | None = None, most_views: int = 50, rows_per_file: int = 1_000_000) -> Indices:
    """Write all indices. Regions are those given (``obj_id, region``), or come from k-means over places and features."""
    features.where("feat IS NOT NULL").select("obj_id", normalise(F.col("feat")).alias("feat")).write.parquet(f"{path}/features")
    seen = visibility(objects, poses)
    seen.write.parquet(f"{path}/visibility")
    seen = objects.sparkSession.read.parquet(f"{path}/visibility")
    top_per(seen, "obj_id", most_views, "view_id").write.parquet(f"{path}/views_of")
    top_of_many(seen, "view_id", most_views, "obj_id").write.parquet(f"{path}/objects_in")
    own = regions if regions is not None else kmeans_regions(objects.join(features.select("obj_id", "feat"), "obj_id", "left"))
    own.select("obj_id", F.col("region").cast("int").alias("region")).write.parquet(f"{path}/regions")
    assigned = objects.sparkSession.read.parquet(f"{path}/regions")
    region_features(assigned.join(features.where("feat IS NOT NULL").select("obj_id", "feat"), "obj_id")).write.parquet(f"{path}/region_features")
    spatial_index.build(objects.select(F.col("obj_id").alias("pt"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z")), f"{path}/places", rows_per_file)
    spatial_index.build(points, f"{path}/points", rows_per_file)
    return open_indices(objects.sparkSession, path)


def open_indices(spark: SparkSession, path: str) -> Indices:
    """The indices that ``build_indices`` has written."""
    tables = (spark.read.parquet(f"{path}/{name}") for name in ("features", "views_of", "objects_in", "regions", "region_features"))
    return Indices(*tables, *(spatial_index.SpatialIndex(spark, f"{path}/{name}") for name in ("places", "points")))
