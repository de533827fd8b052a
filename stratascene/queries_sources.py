"""Queries on sources, sinks and small dimension tables; what is written is read back."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.sweeps import Side, near_pairs
from .operators.graph import label as edge_label
from .operators.retrieval import region_features
from .registry import query
from .registry import rounded as _r
from .sources import indices, sinks, spatial_index
from .sources.adapters import scene
from .sources.frames import register_frames
from .sources.poses import write_trajectory
from .storage import shared_path


@query("affordances", "SELECT obj_id, coalesce(s_name, '') AS object_tag, coalesce(s_nationkey, -1) AS use FROM objects LEFT JOIN supplier ON s_suppkey = obj_id", "objects")
def affordances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects with what is told about some of them, and defaults for the others."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("obj_id"), F.col("s_name").alias("object_tag"), F.col("s_nationkey").alias("use"))
    return sinks.enriched(scene(spark, sf_dir, "objects").select("obj_id"), s, {"object_tag": "", "use": -1})


@query("class_colours", "SELECT category, CAST(('0x' || substr(md5(category), 1, 2)) AS INT) / 255 AS r, CAST(('0x' || substr(md5(category), 3, 2)) AS INT) / 255 AS g, CAST(('0x' || substr(md5(category), 5, 2)) AS INT) / 255 AS b FROM (SELECT DISTINCT category FROM objects) UNION ALL SELECT '-1', 0.0, 0.0, 0.0", "objects")
def class_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.class_colours(scene(spark, sf_dir, "objects").select("category").distinct())


@query("class_names", "SELECT DISTINCT category FROM objects WHERE category NOT IN ('rod', 'pipe', 'plate')", "objects")
def class_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class list, one name a line, written, read back, and without the background."""
    path = shared_path(spark, "classes")
    scene(spark, sf_dir, "objects").select("category").distinct().write.text(path)
    return sinks.read_class_names(spark, path, ("rod", "pipe", "plate"))


@query("camel_classes", "SELECT category, array_to_string(regexp_extract_all(replace(upper(attr[1]) || attr[2:] || upper(category[1]) || category[2:], 'TV', 'Tv'), '[A-Z][^A-Z]*'), ' ') AS name FROM (SELECT DISTINCT attr, category FROM objects)", "objects")
def camel_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = scene(spark, sf_dir, "objects").select("attr", "category").distinct()
    return o.select("category", sinks.spaced_camel(F.concat(F.initcap("attr"), F.initcap("category"))).alias("name"))


@query("map_round_trip", "SELECT obj_id, category, round(cx, 6) AS cx FROM objects WHERE category <> 'rod'", "objects")
def map_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map that is written raw and cleaned, found again by its name, the cleaned one first."""
    root = shared_path(spark, "maps")
    o = scene(spark, sf_dir, "objects")
    sinks.write_map(o, root, "full_scene")
    sinks.write_map(o.where("category <> 'rod'"), root, "full_scene_post")
    found = sinks.first_by_priority(spark.createDataFrame([("full_scene",), ("full_scene_post",)], "name string"), ("%ram%_post", "%_post", "%"))
    return sinks.read_map(spark, root, found).select("obj_id", "category", _r("cx", "cx"))


@query("snapshot_round_trip", "SELECT view_id AS frame_id, obj_id, count(*) AS n FROM detections WHERE view_id IN (3, 5) GROUP BY ALL", "detections")
def snapshot_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of each frame with few columns, of which two frames are read."""
    path = shared_path(spark, "snapshots")
    d = scene(spark, sf_dir, "detections").groupBy(F.col("view_id").alias("frame_id"), "obj_id").agg(F.count(F.lit(1)).alias("n"), F.max("conf").alias("conf"))
    sinks.write_snapshots(d, path, ("obj_id", "n"))
    return spark.read.parquet(path).where("frame_id IN (3, 5)").select(F.col("frame_id").cast("long").alias("frame_id"), "obj_id", "n")


@query("visibility_round_trip", "SELECT obj_id, view_id, count(*) AS n, 5 AS stride FROM detections GROUP BY ALL", "detections")
def visibility_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A visibility index with what it was built by."""
    path = shared_path(spark, "visibility")
    sinks.write_visibility(scene(spark, sf_dir, "detections").groupBy("obj_id", "view_id").agg(F.count(F.lit(1)).alias("n")), path, stride=5)
    return sinks.read_visibility(spark, path, stride=5)


@query("graph_json_round_trip", "SELECT obj_id, category, round(ex * ey * ez, 6) AS volume FROM objects", "objects")
def graph_json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "graph")
    scene(spark, sf_dir, "objects").select("obj_id", "category", F.round(F.col("ex") * F.col("ey") * F.col("ez"), 6).alias("volume")).write.json(path)
    return spark.read.schema("obj_id long, category string, volume double").json(path)


@query("metrics_csv_round_trip", "SELECT category, count(*) AS n, round(avg(ex), 6) AS mean FROM objects GROUP BY category", "objects")
def metrics_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "metrics")
    scene(spark, sf_dir, "objects").groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ex"), 6).alias("mean")).write.option("header", True).csv(path)
    return spark.read.schema("category string, n long, mean double").option("header", True).csv(path)


@query("ply_round_trip", "SELECT round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, CAST(obj_id % 256 AS INT) AS r FROM points", "points")
def ply_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coloured points as one PLY file for each part, each with its own header, read back."""
    from .sources.poses import read_ply, write_ply

    path = shared_path(spark, "ply")
    write_ply(scene(spark, sf_dir, "points").select("x", "y", "z", (F.col("obj_id") % 256).alias("r"), F.lit(7).alias("g"), F.lit(9).alias("b")), path)
    return read_ply(spark, path).select("x", "y", "z", "r")


@query("image_listing", "SELECT user_id AS scene, 'frame' || lpad(CAST(event_id AS VARCHAR), 8, '0') AS path, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS view_id FROM events QUALIFY (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) % 5 = 0")
def image_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth image of each scene by the order of its path, numbered."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("scene"), F.concat(F.lit("frame"), F.lpad(F.col("event_id").cast("string"), 8, "0")).alias("path"))
    return e.withColumn("view_id", F.row_number().over(Window.partitionBy("scene").orderBy("path")) - 1).where("view_id % 5 = 0")


@query("newest_files", "SELECT user_id, max_by(event_id, struct_pack(a := ts, b := event_id)) AS event_id FROM events GROUP BY user_id")
def newest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest file of each scene."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("sampled_points", "SELECT pt, CAST(('0x' || substr(md5(CAST(pt AS VARCHAR)), 1, 4)) AS INT) AS key FROM points WHERE CAST(('0x' || substr(md5(CAST(pt AS VARCHAR)), 1, 4)) AS INT) % 10 = 3", "points")
def sampled_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the points, the same in every run: the subset is a feature here."""
    key = F.conv(F.substring(F.md5(F.col("pt").cast("string")), 1, 4), 16, 10).cast("int")
    return scene(spark, sf_dir, "points").select("pt", key.alias("key")).where("key % 10 = 3")


_SEEN = "v AS (SELECT obj_id, view_id FROM objects, poses WHERE 1 - sqrt((cx - px) * (cx - px) + (cy - py) * (cy - py) + (cz - pz) * (cz - pz)) / 5.0 >= 0.1)"


@query("indices", f", {_SEEN} SELECT 'features' AS name, count(*) AS n FROM features UNION ALL SELECT 'points', count(*) FROM points UNION ALL SELECT 'places', count(*) FROM objects UNION ALL SELECT 'regions', count(DISTINCT region) FROM features UNION ALL SELECT 'views_of', sum(least(n, 50))::BIGINT FROM (SELECT count(*) AS n FROM v GROUP BY obj_id) UNION ALL SELECT 'objects_in', sum(least(n, 50))::BIGINT FROM (SELECT count(*) AS n FROM v GROUP BY view_id)", "objects", "poses", "features", "points")
def all_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All indices of a scene, built, opened again, and their sizes."""
    path = shared_path(spark, "indices")
    objects, poses, features, points = (scene(spark, sf_dir, n) for n in ("objects", "poses", "features", "points"))
    indices.build_indices(objects, poses, features, points, path, regions=features.select("obj_id", "region"), rows_per_file=10_000)
    i = indices.open_indices(spark, path)
    tables = {"features": i.features, "points": i.points.files, "places": i.places.files, "regions": i.region_features, "views_of": i.views_of, "objects_in": i.objects_in}
    out = None
    for name, df in tables.items():
        one = df.agg((F.sum("n") if "file" in df.columns else F.count(F.lit(1))).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


_AT = "sqrt((x - 5.0) * (x - 5.0) + (y - 5.0) * (y - 5.0) + (z - 1.0) * (z - 1.0))"


def _points_index(spark: SparkSession, sf_dir: str) -> spatial_index.SpatialIndex:
    return spatial_index.build(scene(spark, sf_dir, "points"), shared_path(spark, "points"), rows_per_file=4000)


@query("indexed_ball", f"SELECT obj_id, pt, round({_AT}, 6) AS distance FROM points WHERE {_AT} <= 1.5", "points")
def indexed_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an index that is built of all points has within reach of a place."""
    return _points_index(spark, sf_dir).ball((5.0, 5.0, 1.0), 1.5).select("obj_id", "pt", F.round("distance", 6).alias("distance"))


@query("indexed_nearest", f"SELECT round({_AT}, 6) AS distance FROM points ORDER BY {_AT} LIMIT 30", "points")
def indexed_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirty points of an index that are nearest to a place."""
    return _points_index(spark, sf_dir).nearest((5.0, 5.0, 1.0), 30).select(F.round("distance", 6).alias("distance"))


@query("frames_round_trip", "SELECT n AS frame_id, view_id::DOUBLE AS view, px AS x, py AS y FROM (SELECT *, row_number() OVER (ORDER BY view_id) - 1 AS n FROM poses) WHERE n >= 10 AND n < 350 AND (n - 10) % 7 = 0 AND n >= 30", "poses")
def frames_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poses written as a scene's folder and read by its format: from the tenth to the 350th frame, every seventh, none before the thirtieth."""
    path = shared_path(spark, "scene")
    zero = F.lit(0.0)
    m = F.array(F.lit(1.0), zero, zero, F.col("px"), zero, F.lit(1.0), zero, F.col("py"), zero, zero, F.lit(1.0), F.col("view_id").cast("double"), zero, zero, zero, F.lit(1.0))
    write_trajectory(scene(spark, sf_dir, "poses").select("view_id", m.alias("m")), f"{path}/traj.txt", "view_id")
    register_frames(spark)
    found = spark.read.format("scene_frames").options(layout="replica", start=10, end=350, stride=7, frames=10).load(path).where("frame_id >= 30")
    return found.select("frame_id", F.col("pose")[11].alias("view"), F.col("pose")[3].alias("x"), F.col("pose")[7].alias("y"))


@query(
    "scene_round_trip",
    """, e AS (SELECT a.obj_id AS i, b.obj_id AS j, CASE WHEN a.cz - b.cz > (a.ez + b.ez) / 4 THEN 'a on b' WHEN a.cz - b.cz < -(a.ez + b.ez) / 4 THEN 'b on a' ELSE 'none of these' END AS relation FROM objects a, objects b WHERE a.obj_id < b.obj_id AND sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2) <= 0.3)
SELECT 'object' AS kind, obj_id AS a, NULL::BIGINT AS b, category AS label FROM objects UNION ALL SELECT 'region', region, count(*), NULL FROM features GROUP BY region UNION ALL SELECT 'member', obj_id, region, NULL FROM features UNION ALL SELECT 'edge', i, j, relation FROM e""",
    "objects", "features",
)
def scene_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scene with its regions and the edges of its graph, written and read."""
    path = shared_path(spark, "scene")
    o, f = scene(spark, sf_dir, "objects"), scene(spark, sf_dir, "features")

    def edges(a: Side, b: Side, far: np.ndarray) -> dict[str, np.ndarray]:
        ways = [(x.only(k), y.only(k)) for x, y in ((a, b), (b, a)) for k in [x["obj_id"] < y["obj_id"]]]
        told = {"i": lambda x, y: x["obj_id"], "j": lambda x, y: y["obj_id"], "rise": lambda x, y: x["cz"] - y["cz"], "tall": lambda x, y: x["ez"] + y["ez"]}
        return {name: np.concatenate([of(x, y) for x, y in ways]) for name, of in told.items()}

    near = near_pairs(o.select("obj_id", "cx", "cy", "cz", "ez"), ("cx", "cy"), 0.3, edges, "i long, j long, rise double, tall double")
    sinks.write_scene(path, o, region_features(f), f.select("obj_id", "region"), near.select("i", "j", edge_label(F.col("rise"), F.col("tall")).alias("relation")))
    s = sinks.read_scene(spark, path)
    rows = lambda kind, table, a, b, label: table.select(F.lit(kind).alias("kind"), F.col(a).cast("long").alias("a"), (F.col(b) if b else F.lit(None)).cast("long").alias("b"), (F.col(label) if label else F.lit(None)).cast("string").alias("label"))
    parts = [rows("object", s["objects"], "obj_id", None, "category"), rows("region", s["regions"], "region", "n", None), rows("member", s["members"], "obj_id", "region", None), rows("edge", s["edges"], "i", "j", "relation")]
    return reduce(DataFrame.unionByName, parts)


@query("cloud_round_trip", "SELECT pt, p.obj_id, round(list_sum(list_transform(feat, lambda v: v::FLOAT::DOUBLE)), 6) AS total FROM points p JOIN features USING (obj_id)", "points", "features")
def cloud_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with the vectors of their objects, as a dense cloud."""
    path = shared_path(spark, "cloud")
    sinks.write_cloud(scene(spark, sf_dir, "points"), scene(spark, sf_dir, "features"), path)
    return sinks.read_cloud(spark, path).select("pt", "obj_id", F.round(F.aggregate("feat", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))
