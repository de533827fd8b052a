"""Sinks for scene tables and their readers, and small dimension tables."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def enriched(objects: DataFrame, told: DataFrame, defaults: dict[str, object], key: str = "obj_id") -> DataFrame:
    """Objects with columns of another table, and ``defaults`` where it has none."""
    j = objects.join(told, key, "left")
    return j.select(*objects.columns, *(F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in defaults.items()))


def class_colours(classes: DataFrame) -> DataFrame:
    """``category, r, g, b`` from 0 to 1 by the hash of the name, so that they needn't be stored; -1 is black."""
    part = lambda k: F.conv(F.substring(F.md5("category"), 1 + 2 * k, 2), 16, 10).cast("int") / 255
    coloured = classes.select("category", *(part(k).alias(c) for k, c in enumerate("rgb")))
    none = classes.sparkSession.createDataFrame([("-1", 0.0, 0.0, 0.0)], "category string, r double, g double, b double")
    return coloured.unionByName(none)


def read_class_names(spark: SparkSession, path: str, background: tuple[str, ...] = ()) -> DataFrame:
    """``category`` from one name a line, without the background."""
    return spark.read.text(path).select(F.trim("value").alias("category")).where((F.col("category") != "") & ~F.col("category").isin(*background))


def spaced_camel(name: Column) -> Column:
    """The words of a name in camel case; TV is one word."""
    return F.array_join(F.regexp_extract_all(F.replace(name, F.lit("TV"), F.lit("Tv")), F.lit("[A-Z][^A-Z]*"), F.lit(0)), " ")


def write_map(objects: DataFrame, root: str, name: str) -> None:
    objects.write.parquet(f"{root}/{name}")


def read_map(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}")


def first_by_priority(names: DataFrame, patterns: tuple[str, ...]) -> str | None:
    """The name that fits the earliest of some LIKE patterns, ties by name."""
    rank = None
    for k, p in enumerate(patterns):
        rank = F.when(F.col("name").like(p), k) if rank is None else rank.when(F.col("name").like(p), k)
    row = names.withColumn("rank", rank).where("rank IS NOT NULL").orderBy("rank", "name").limit(1).first()
    return row["name"] if row else None


def write_snapshots(objects: DataFrame, path: str, columns: tuple[str, ...]) -> None:
    """Snapshots of the map with some columns only, a folder for each frame."""
    objects.select("frame_id", *columns).write.mode("append").partitionBy("frame_id").parquet(path)


def write_scene(path: str, objects: DataFrame, regions: DataFrame, members: DataFrame, edges: DataFrame) -> None:
    """A whole scene: objects, regions (``region, feat`` and more), which objects are in them (``obj_id, region``), and the edges of its graph (``i, j, relation``), each as JSON or, with vectors, as Parquet; edges are many, and zipped."""
    objects.write.parquet(f"{path}/objects")
    regions.write.parquet(f"{path}/regions")
    members.select("obj_id", "region").write.json(f"{path}/members")
    edges.select("i", "j", "relation").write.json(f"{path}/edges", compression="gzip")


def read_scene(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``objects, regions, members, edges`` of a scene that ``write_scene`` has written."""
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in ("objects", "regions")}
    tables["members"] = spark.read.schema("obj_id long, region long").json(f"{path}/members")
    tables["edges"] = spark.read.schema("i long, j long, relation string").json(f"{path}/edges")
    return tables


def write_cloud(points: DataFrame, features: DataFrame, path: str) -> None:
    """A dense cloud: the vectors of the points that have one, in single precision, and for every point whether it has one."""
    seen = points.select("pt", "obj_id", "x", "y", "z").join(features.where("feat IS NOT NULL").select("obj_id", F.col("feat").cast("array<float>").alias("feat")), "obj_id", "left")
    seen.select("pt", "obj_id", "x", "y", "z", F.col("feat").isNotNull().alias("has_feat"), "feat").write.parquet(path)


def read_cloud(spark: SparkSession, path: str, dense: bool = True) -> DataFrame:
    """The points of a cloud with their vectors, or all of them with the mask alone."""
    cloud = spark.read.parquet(path)
    return cloud.where("has_feat").drop("has_feat") if dense else cloud.drop("feat")


def write_visibility(index: DataFrame, path: str, stride: int) -> None:
    """Both directions of the index are one table; what it was built by is a table of one row."""
    index.write.parquet(f"{path}/index")
    index.sparkSession.createDataFrame([(stride,)], "stride int").write.json(f"{path}/metadata")


def read_visibility(spark: SparkSession, path: str, stride: int | None = None) -> DataFrame:
    """The index with the stride it was built by; another stride than the wanted one is warned of."""
    built = spark.read.schema("stride int").json(f"{path}/metadata").first()["stride"]
    if stride is not None and built != stride:
        warnings.warn(f"the index was built with a stride of {built}, not {stride}", stacklevel=2)
    return spark.read.parquet(f"{path}/index").withColumn("stride", F.lit(built))
