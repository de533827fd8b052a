"""Queries on the point index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.relations import nearest_join
from .functions.vectors import literal
from .operators import points as P
from .registry import query
from .registry import rounded as _r
from .sources.adapters import scene

_PLACE = (5.0, 5.0, 1.0)
_DP = "sqrt((x - 5) * (x - 5) + (y - 5) * (y - 5) + (z - 1) * (z - 1))"
_Q = [((k * 29) % 13 - 6) / 10 for k in range(64)]
_QL = "CAST([" + ", ".join(map(str, _Q)) + "] AS DOUBLE[])"
_SIM = f"list_dot_product(feat, {_QL}) / (sqrt(list_dot_product(feat, feat)) * sqrt(list_dot_product({_QL}, {_QL})))"
_D3 = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"


@query("point_ranges", "SELECT obj_id, n, CAST(sum(n) OVER (ORDER BY obj_id) - n AS BIGINT) AS start, CAST(sum(n) OVER (ORDER BY obj_id) AS BIGINT) AS stop FROM (SELECT obj_id, count(*) AS n FROM points GROUP BY obj_id)", "points")
def point_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each object's points start and stop in the table of all points."""
    per = scene(spark, sf_dir, "points").groupBy("obj_id").agg(F.count(F.lit(1)).alias("n"))
    return P.offsets(per, "obj_id", "n").select("obj_id", "n", "start", "stop")


@query("points_in_radius", f"SELECT pt, obj_id, round({_DP}, 6) AS distance FROM points WHERE {_DP} <= 0.8", "points")
def points_in_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.within(scene(spark, sf_dir, "points"), _PLACE, 0.8).select("pt", "obj_id", _r("distance", "distance"))


@query("objects_in_radius", "SELECT obj_id, round(sqrt((cx - 5) * (cx - 5) + (cy - 5) * (cy - 5) + (cz - 1) * (cz - 1)), 6) AS distance FROM objects WHERE sqrt((cx - 5) * (cx - 5) + (cy - 5) * (cy - 5) + (cz - 1) * (cz - 1)) <= 1.5", "objects")
def objects_in_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = scene(spark, sf_dir, "objects").select("obj_id", F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"))
    return P.within(o, _PLACE, 1.5).select("obj_id", _r("distance", "distance"))


def _located(radius: float) -> str:
    return f""", b AS (SELECT *, {_DP} AS d FROM points), k AS (SELECT * FROM b ORDER BY d, pt LIMIT 20)
SELECT pt, obj_id, round(d, 6) AS distance FROM b WHERE d <= {radius} UNION ALL SELECT pt, obj_id, round(d, 6) FROM k WHERE NOT EXISTS (SELECT 1 FROM b WHERE d <= {radius})"""


@query("location_search", _located(0.5), "points")
def location_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.at_location(scene(spark, sf_dir, "points"), _PLACE, 0.5, 20).select("pt", "obj_id", _r("distance", "distance"))


@query("location_search_empty_ball", _located(0.000001), "points")
def location_search_empty_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing is so close, so the nearest points come instead."""
    return P.at_location(scene(spark, sf_dir, "points"), _PLACE, 0.000001, 20).select("pt", "obj_id", _r("distance", "distance"))


@query(
    "point_hybrid_score",
    f""", b AS (SELECT *, {_DP} AS d FROM points WHERE {_DP} <= 1.0), s AS (SELECT pt, b.obj_id, d, 0.4 * (1 - least(d / 1.0, 1.0)) + 0.6 * greatest(coalesce({_SIM}, 0.5), 0.0) AS score FROM b LEFT JOIN features f ON f.obj_id = b.obj_id)
SELECT pt, obj_id, round(d, 6) AS distance, round(score, 6) AS score FROM s ORDER BY round(score, 9) DESC, pt LIMIT 15""",
    "points", "features",
)
def point_hybrid_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = P.scored_search(scene(spark, sf_dir, "points"), scene(spark, sf_dir, "features"), _PLACE, literal(_Q), 1.0, 15)
    return s.select("pt", "obj_id", _r("distance", "distance"), _r("score", "score"))


@query("points_within_object", f"SELECT pt, round({_DP}, 6) AS distance FROM points WHERE obj_id = 7 ORDER BY {_DP}, pt LIMIT 5", "points")
def points_within_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.within_object(scene(spark, sf_dir, "points"), 7, _PLACE, 5).select("pt", _r("distance", "distance"))


@query("local_neighbourhood", f"SELECT a.pt, b.pt AS other, b.obj_id AS other_obj FROM points a, points b WHERE a.obj_id % 20 = 0 AND {_D3} <= 0.3", "points")
def local_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = scene(spark, sf_dir, "points")
    return P.neighbourhoods(p, p.where("obj_id % 20 = 0"), 0.3)


@query("point_features_propagated", "SELECT pt, round(list_sum(feat), 6) AS total FROM points JOIN features USING (obj_id)", "points", "features")
def point_features_propagated(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = P.propagated_features(scene(spark, sf_dir, "points"), scene(spark, sf_dir, "features"))
    return f.select("pt", _r(F.aggregate("feat", F.lit(0.0), lambda a, x: a + x), "total"))


@query(
    "point_features_blended",
    f""", n AS (SELECT a.pt, b.obj_id, count(*) AS w FROM points a, points b WHERE a.obj_id % 20 = 0 AND {_D3} <= 0.3 GROUP BY ALL),
d AS (SELECT pt, k, sum(w * v) / sum(w) AS v FROM (SELECT pt, w, unnest(feat) AS v, generate_subscripts(feat, 1) AS k FROM n JOIN features USING (obj_id)) GROUP BY pt, k) SELECT pt, round(sum(v), 6) AS total, round(sum(v * k), 5) AS moment FROM d GROUP BY pt""",
    "points", "features",
)
def point_features_blended(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = scene(spark, sf_dir, "points")
    f = P.blended_features(p, p.where("obj_id % 20 = 0"), scene(spark, sf_dir, "features"), 0.3)
    moment = F.aggregate(F.transform("feat", lambda x, k: x * (k + 1)), F.lit(0.0), lambda a, x: a + x)
    return f.select("pt", _r(F.aggregate("feat", F.lit(0.0), lambda a, x: a + x), "total"), _r(moment, "moment", 5))


@query(
    "points_to_nearest_object",
    """, d AS (SELECT p.pt, o.obj_id AS nearest, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz)) AS d FROM points p, objects o WHERE p.obj_id % 20 = 0)
SELECT pt, nearest, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY pt ORDER BY d, nearest) AS r FROM d) WHERE r = 1""",
    "points", "objects",
)
def points_to_nearest_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = nearest_join(scene(spark, sf_dir, "points").where("obj_id % 20 = 0"), scene(spark, sf_dir, "objects").withColumnRenamed("obj_id", "nearest"), "pt", "nearest", ("x", "y", "z"), ("cx", "cy", "cz"))
    return near.select("pt", "nearest", _r("distance", "distance"))


@query(
    "cloud_association",
    """, d AS (SELECT a.pt AS pred, b.pt AS gt, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d FROM points a, points b WHERE a.obj_id % 20 = 0 AND b.obj_id % 20 <> 0)
SELECT pred, gt FROM (SELECT *, row_number() OVER (PARTITION BY pred ORDER BY sqrt(d), gt) AS r FROM d) WHERE r = 1""",
    "points",
)
def cloud_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each predicted point's nearest point of the ground truth."""
    p = scene(spark, sf_dir, "points")
    pred, gt = p.where("obj_id % 20 = 0").withColumnRenamed("pt", "pred"), p.where("obj_id % 20 <> 0").withColumnRenamed("pt", "gt")
    return nearest_join(pred, gt, "pred", "gt", ("x", "y", "z"), ("x", "y", "z")).select("pred", "gt")


@query("point_index_summary", "SELECT count(*) AS n_points, count(DISTINCT obj_id) AS n_objects, (SELECT count(DISTINCT obj_id) FROM features) AS n_features, (SELECT CAST(max(len(feat)) AS INT) FROM features) AS feature_dim FROM points", "points", "features")
def point_index_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.summary(scene(spark, sf_dir, "points"), scene(spark, sf_dir, "features"))


@query("point_text_search", f"SELECT pt, round({_SIM}, 6) AS sim FROM points JOIN features USING (obj_id) ORDER BY {_SIM} DESC, pt LIMIT 25", "points", "features")
def point_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points whose features are closest to a query vector."""
    from .operators.retrieval import vector_top_k

    f = P.propagated_features(scene(spark, sf_dir, "points"), scene(spark, sf_dir, "features")).withColumnRenamed("pt", "obj_id")
    return vector_top_k(f, literal(_Q), 25).select(F.col("obj_id").alias("pt"), _r("sim", "sim"))


@query("object_lookup", "SELECT p.obj_id, o.category, pt FROM points p JOIN objects o USING (obj_id) WHERE p.obj_id IN (3, 11)", "points", "objects")
def object_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects by identifier, and their points."""
    wanted = F.col("obj_id").isin(3, 11)
    return scene(spark, sf_dir, "points").where(wanted).join(scene(spark, sf_dir, "objects").where(wanted).select("obj_id", "category"), "obj_id").select("obj_id", "category", "pt")
