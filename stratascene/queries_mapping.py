"""Queries on building and cleaning the object map."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.relations import norm
from .functions.trees import numbered
from .operators import graph, mapping
from .operators.overlaps import box_overlaps, most_overlapping
from .operators.vector_join import top_k_join
from .registry import query
from .registry import rounded as _r
from .sources.adapters import scene

_DET = "d AS (SELECT *, seq_major * 10 + seq_minor AS det FROM detections)"
_W, _H = "greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1))", "greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"


@query("holding_pairs", f", {_DET}, p AS (SELECT a.view_id, a.det, b.det AS other, {_W} * {_H} AS inter, (a.x2 - a.x1) * (a.y2 - a.y1) AS area, (b.x2 - b.x1) * (b.y2 - b.y1) AS small FROM d a JOIN d b ON a.view_id = b.view_id AND a.det <> b.det) SELECT view_id, det, other, round(area - inter, 4) AS rest FROM p WHERE inter / area < 0.7 AND inter / small > 0.8", "detections")
def holding_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that hold others, and the area that is left without one."""
    d = scene(spark, sf_dir, "detections").withColumn("det", F.col("seq_major") * 10 + F.col("seq_minor"))
    return mapping.holding_pairs(d).select("view_id", "det", "other", _r(F.col("area") - F.col("inter"), "rest", 4))


_NEW_OLD = """n AS (SELECT * FROM points WHERE obj_id % 4 = 1), m AS (SELECT * FROM points WHERE obj_id % 4 = 2)"""


@query(
    "overlap_with_map",
    f""", {_NEW_OLD}, h AS (SELECT n.obj_id AS i, m.obj_id AS j, count(DISTINCT n.pt) AS hits FROM n, m WHERE sqrt((n.x - m.x) * (n.x - m.x) + (n.y - m.y) * (n.y - m.y) + (n.z - m.z) * (n.z - m.z)) < 0.1 GROUP BY ALL),
s AS (SELECT obj_id, count(*) AS size, min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d, min(z) AS e, max(z) AS f FROM points GROUP BY obj_id)
SELECT i, j, round(hits / p.size, 6) AS ratio FROM h JOIN s p ON p.obj_id = i JOIN s q ON q.obj_id = j WHERE least(p.b, q.b) > greatest(p.a, q.a) AND least(p.d, q.d) > greatest(p.c, q.c) AND least(p.f, q.f) > greatest(p.e, q.e)""",
    "points",
)
def overlap_with_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each new object's points that are close to points of an object of the map."""
    p = scene(spark, sf_dir, "points")
    return mapping.point_overlap_between(p.where("obj_id % 4 = 1"), p.where("obj_id % 4 = 2"), 0.1).select("i", "j", _r("ratio", "ratio"))


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of objects whose boxes meet, both ways, with how much of the first is in the second."""
    met = box_overlaps(scene(spark, sf_dir, "objects"), "va", "vb", both=True)
    return met.select("i", "j", F.round(F.col("inter") / F.col("va"), 9).alias("ratio"), F.round(F.col("inter") / (F.col("va") + F.col("vb") - F.col("inter") + 1e-10), 9).alias("iou"))


_AX = " * ".join(f"greatest(0.0, least(a.c{x} + a.e{x} / 2, b.c{x} + b.e{x} / 2) - greatest(a.c{x} - a.e{x} / 2, b.c{x} - b.e{x} / 2))" for x in "xyz")
_AH = " * ".join(f"(greatest(a.c{x} + a.e{x} / 2, b.c{x} + b.e{x} / 2) - least(a.c{x} - a.e{x} / 2, b.c{x} - b.e{x} / 2))" for x in "xyz")
_PAIRS = f"p AS (SELECT a.obj_id AS i, b.obj_id AS j, round(({_AX}) / (a.ex * a.ey * a.ez), 9) AS ratio FROM objects a, objects b WHERE a.obj_id <> b.obj_id AND ({_AX}) > 1e-9)"


_LOOK = "round(list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1}))), 9)"


@query(
    "overlap_merges",
    f"""RECURSIVE, {_PAIRS}, r AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY ratio DESC, i, j) AS k FROM (SELECT p.*, {_LOOK.format('f.feat', 'g.feat')} AS visual, {_LOOK.format('f.feat[1:16]', 'g.feat[1:16]')} AS text FROM p JOIN features f ON f.obj_id = i % 500 JOIN features g ON g.obj_id = j % 500) WHERE ratio > 0.1 AND visual > 0.0 AND text > -0.1),
s AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS gone UNION ALL SELECT r.k, CASE WHEN list_contains(gone, r.j) THEN gone ELSE list_append(gone, r.i) END FROM s JOIN r ON r.k = s.k + 1)
SELECT r.i, r.j, round(r.ratio, 6) AS ratio FROM r JOIN s ON s.k = r.k - 1 WHERE NOT list_contains(gone, r.j)""",
    "objects", "features",
)
def overlap_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which objects go into which, one pair after another by how much they overlap, if they are alike in look and name."""
    looks = scene(spark, sf_dir, "features").select(F.col("obj_id").alias("look"), "feat")
    f = scene(spark, sf_dir, "objects").join(looks, F.col("look") == F.col("obj_id") % 500).select("obj_id", "feat")
    return mapping.merge_objects(_overlaps(spark, sf_dir), f, f.withColumn("feat", F.slice("feat", 1, 16)), 0.1, 0.0, -0.1).select("i", "j", _r("ratio", "ratio"))


_KINDS = " UNION ALL ".join(f"SELECT '{k}' AS kind, a.obj_id AS det_id, b.obj_id, round({e}, 6) AS sim FROM objects a, objects b WHERE a.obj_id % 2 = 0 AND b.obj_id % 2 = 1 AND ({_AX}) > 0" for k, e in (("iou", f"({_AX}) / (a.ex * a.ey * a.ez + b.ex * b.ey * b.ez - ({_AX}) + 1e-10)"), ("giou", f"({_AX}) / (a.ex * a.ey * a.ez + b.ex * b.ey * b.ez - ({_AX}) + 1e-10) - (({_AH}) - (a.ex * a.ey * a.ez + b.ex * b.ey * b.ez - ({_AX}))) / (({_AH}) + 1e-10)")))


@query("spatial_kinds", _KINDS, "objects")
def spatial_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarities of detections' and objects' boxes by the name of their kind."""
    o = scene(spark, sf_dir, "objects")
    both = mapping.spatial_similarities_of(o.where("obj_id % 2 = 0"), o.where("obj_id % 2 = 1"), ("iou", "giou"))
    return both.select("kind", "det_id", "obj_id", _r("sim", "sim"))


@query("overlap_pairs_sorted", f", {_PAIRS} SELECT i, j, round(ratio, 6) AS ratio FROM p ORDER BY ratio DESC, i, j LIMIT 40", "objects")
def overlap_pairs_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return most_overlapping(scene(spark, sf_dir, "objects"), 40).select("i", "j", _r("ratio", "ratio"))


@query("spatial_similarity", f", {_PAIRS}, q AS (SELECT a.obj_id AS i, b.obj_id AS j, ({_AX}) / (a.ex * a.ey * a.ez + b.ex * b.ey * b.ez - ({_AX}) + 1e-10) AS iou FROM objects a, objects b WHERE a.obj_id <> b.obj_id AND ({_AX}) > 1e-9) SELECT i, j, round(round(iou, 9) + 1e-9, 6) AS iou, round(ratio + 1e-9, 6) AS overlap FROM q JOIN p USING (i, j)", "objects")
def spatial_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlaps(spark, sf_dir).select("i", "j", _r(F.col("iou") + 1e-9, "iou"), _r(F.col("ratio") + 1e-9, "overlap"))


_COS = "round(list_dot_product(a.feat, b.feat) / (sqrt(list_dot_product(a.feat, a.feat)) * sqrt(list_dot_product(b.feat, b.feat))), 9)"


@query("visual_similarity", f" SELECT a.obj_id AS det_id, b.obj_id, round({_COS}, 6) AS sim, (row_number() OVER w)::INTEGER AS rank FROM features a, features b WHERE a.obj_id % 2 = 0 AND b.obj_id % 2 = 1 WINDOW w AS (PARTITION BY a.obj_id ORDER BY {_COS} DESC, b.obj_id) QUALIFY rank <= 5", "features")
def visual_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five objects that look most like each detection."""
    f = scene(spark, sf_dir, "features")
    return top_k_join(f.where("obj_id % 2 = 0").withColumnRenamed("obj_id", "det_id"), f.where("obj_id % 2 = 1"), 5).select("det_id", "obj_id", _r("sim", "sim"), "rank")


@query("graph_relations", f", {_PAIRS} SELECT i, j, CASE WHEN a.cz - b.cz > (a.ez + b.ez) / 4 THEN 'a on b' ELSE 'b on a' END AS relation FROM p JOIN objects a ON a.obj_id = i JOIN objects b ON b.obj_id = j WHERE abs(a.cz - b.cz) > (a.ez + b.ez) / 4", "objects")
def graph_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the graph's edges, those without a relation left out."""
    met = box_overlaps(scene(spark, sf_dir, "objects"), "rise", "tall", both=True)
    return met.select("i", "j", graph.label(F.col("rise"), F.col("tall")).alias("relation")).where("relation <> 'none of these'")


@query("object_filter", ", n AS (SELECT obj_id, count(*) AS points FROM points GROUP BY obj_id HAVING count(*) >= 30), m AS (SELECT obj_id, count(*) AS detections FROM detections GROUP BY obj_id HAVING count(*) >= 15) SELECT * FROM n JOIN m USING (obj_id)", "points", "detections")
def object_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.object_filter(scene(spark, sf_dir, "points"), scene(spark, sf_dir, "detections"), 30, 15)


@query("foreground_split", "SELECT obj_id, category IN ('rod', 'pipe', 'plate') AS background, ex * ey * ez >= 0.001 AS solid FROM objects", "objects")
def foreground_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Background classes, and boxes that aren't degenerate."""
    o = scene(spark, sf_dir, "objects")
    return o.select("obj_id", F.col("category").isin("rod", "pipe", "plate").alias("background"), (F.col("ex") * F.col("ey") * F.col("ez") >= 0.001).alias("solid"))


@query("small_clouds", "SELECT obj_id, view_id, count(*) AS n FROM points GROUP BY ALL HAVING count(*) >= 2", "points")
def small_clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections that have points enough."""
    return scene(spark, sf_dir, "points").groupBy("obj_id", "view_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@query("pruned_nodes", ", v AS (SELECT obj_id, count(DISTINCT view_id) AS views FROM detections GROUP BY obj_id) SELECT obj_id, views FROM objects JOIN v USING (obj_id) WHERE views >= 25 AND lower(attr) NOT IN ('red', 'small') AND obj_id NOT IN (SELECT obj_id FROM features WHERE region = 3)", "objects", "detections", "features")
def pruned_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with views enough, without a tag that says failed, and not among those without an answer."""
    o, v = scene(spark, sf_dir, "objects"), scene(spark, sf_dir, "detections").groupBy("obj_id").agg(F.countDistinct("view_id").alias("views"))
    silent = scene(spark, sf_dir, "features").where("region = 3").select("obj_id")
    return o.where(~F.lower("attr").isin("red", "small")).join(v.where("views >= 25"), "obj_id").join(silent, "obj_id", "left_anti").select("obj_id", "views")


@query("voxel_downsample", "SELECT CAST(floor(x / 0.5) AS BIGINT) AS vx, CAST(floor(y / 0.5) AS BIGINT) AS vy, CAST(floor(z / 0.5) AS BIGINT) AS vz, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM points GROUP BY ALL", "points")
def voxel_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = mapping.voxel_fusion(scene(spark, sf_dir, "points").withColumn("w", F.lit(1.0)), 0.5, 1)
    return v.select("vx", "vy", "vz", "n", _r("x", "x"), _r("y", "y"), _r("z", "z"))


@query(
    "voxel_features",
    """, p AS (SELECT floor(x / 1.5) AS vx, floor(y / 1.5) AS vy, floor(z / 1.5) AS vz, 1 / (1 + depth / 5) AS w, feat FROM points JOIN features USING (obj_id)),
d AS (SELECT vx, vy, vz, k, sum(w * f) / sum(w) AS f, count(*) AS n FROM (SELECT vx, vy, vz, w, unnest(feat) AS f, generate_subscripts(feat, 1) AS k FROM p) GROUP BY vx, vy, vz, k HAVING count(*) >= 2)
SELECT CAST(vx AS BIGINT) AS vx, CAST(vy AS BIGINT) AS vy, CAST(vz AS BIGINT) AS vz, max(n) AS n, round(sum(f) / greatest(sqrt(sum(f * f)), 1e-8), 5) AS total FROM d GROUP BY vx, vy, vz""",
    "points", "features",
)
def voxel_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = scene(spark, sf_dir, "points").join(scene(spark, sf_dir, "features").select("obj_id", "feat"), "obj_id").withColumn("w", 1 / (1 + F.col("depth") / 5))
    return mapping.voxel_features(p, 1.5).select("vx", "vy", "vz", "n", _r(F.aggregate("feat", F.lit(0.0), lambda a, x: a + x), "total", 5))


@query("multiview_mean", ", d AS (SELECT obj_id % 50 AS point, k, sum(v) / greatest(count(v), 1e-5) AS v FROM (SELECT obj_id, unnest(feat) AS v, generate_subscripts(feat, 1) AS k FROM features) GROUP BY ALL) SELECT point, round(sum(v), 6) AS total FROM d GROUP BY point", "features")
def multiview_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mapping.multiview_mean(scene(spark, sf_dir, "features").withColumn("point", F.col("obj_id") % 50), "point")
    return m.select("point", _r(F.aggregate("feat", F.lit(0.0), lambda a, x: a + x), "total"))


@query(
    "object_geometry",
    """, g AS (SELECT obj_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM points WHERE obj_id % 3 <> 0 GROUP BY obj_id)
SELECT o.obj_id, round(coalesce(mx, cx, 0.0) + 1e-9, 4) AS x, round(coalesce(my, cy, 0.0) + 1e-9, 4) AS y, round(coalesce(mz, cz, 0.0) + 1e-9, 4) AS z, round(coalesce(x1 - x0, ex), 6) AS width FROM objects o LEFT JOIN g ON g.obj_id = o.obj_id""",
    "objects", "points",
)
def object_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroid and bounds from an object's points, else from its box, else the origin."""
    p = scene(spark, sf_dir, "points").where("obj_id % 3 <> 0").groupBy("obj_id").agg(*(F.avg(a).alias(f"m{a}") for a in "xyz"), *(f(a).alias(f"{a}{k}") for a in "xyz" for k, f in enumerate((F.min, F.max))))
    j = scene(spark, sf_dir, "objects").join(p, "obj_id", "left")
    return j.select("obj_id", *(_r(F.coalesce(f"m{a}", f"c{a}", F.lit(0.0)) + 1e-9, a, 4) for a in "xyz"), _r(F.coalesce(F.col("x1") - F.col("x0"), F.col("ex")), "width"))


@query("merged_lists", "SELECT category, list_sort(flatten(list([view_id, obj_id]))) AS members, sum(n) AS n FROM (SELECT obj_id, view_id, count(*)::BIGINT AS n FROM detections GROUP BY ALL) JOIN objects USING (obj_id) GROUP BY category", "detections", "objects")
def merged_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of merged objects put together, and numbers added up."""
    d = scene(spark, sf_dir, "detections").groupBy("obj_id", "view_id").agg(F.count(F.lit(1)).alias("n")).join(scene(spark, sf_dir, "objects").select("obj_id", "category"), "obj_id")
    return d.groupBy("category").agg(F.array_sort(F.flatten(F.collect_list(F.array("view_id", "obj_id")))).alias("members"), F.sum("n").alias("n"))


@query("rekeyed_maps", ", m AS (SELECT obj_id, view_id + 1000 AS k, count(*) AS n FROM detections GROUP BY ALL) SELECT obj_id, max(CASE WHEN k = 1007 THEN n ELSE 0 END) AS at_7, count(*) AS keys FROM m GROUP BY obj_id", "detections")
def rekeyed_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of counts by view, moved by an offset and read with a default."""
    d = scene(spark, sf_dir, "detections").groupBy("obj_id", "view_id").agg(F.count(F.lit(1)).alias("n"))
    m = d.groupBy("obj_id").agg(F.map_from_entries(F.collect_list(F.struct("view_id", "n"))).alias("m")).withColumn("m", F.transform_keys("m", lambda k, v: k + 1000))
    return m.select("obj_id", F.coalesce(F.try_element_at("m", F.lit(1007).cast("long")), F.lit(0)).alias("at_7"), F.size("m").cast("long").alias("keys"))


@query(
    "trajectory_signal",
    """, s AS (SELECT seq_id, frame_id, px - lag(px) OVER w AS dx, py - lag(py) OVER w AS dy FROM trajectory WINDOW w AS (PARTITION BY seq_id ORDER BY frame_id)), r AS (SELECT seq_id, frame_id, sqrt(dx * dx + dy * dy) AS pos, abs(atan2(dy, dx)) AS angle FROM s WHERE dx IS NOT NULL AND (dx <> 0 OR dy <> 0)),
m AS (SELECT seq_id, max(pos) AS mp, max(angle) AS ma FROM r GROUP BY seq_id) SELECT r.seq_id, frame_id, round(0.6 * pos / greatest(mp, 1e-8) + 0.4 * angle / greatest(ma, 1e-8), 6) AS signal FROM r JOIN m ON r.seq_id = m.seq_id""",
    "trajectory",
)
def trajectory_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much a camera moves and turns from frame to frame, against its largest moves."""
    w = Window.partitionBy("seq_id").orderBy("frame_id")
    dx, dy = (F.col(c) - F.lag(c).over(w) for c in ("px", "py"))
    r = scene(spark, sf_dir, "trajectory").select("seq_id", "frame_id", dx.alias("dx"), dy.alias("dy")).where("dx IS NOT NULL AND (dx <> 0 OR dy <> 0)")
    r = r.select("seq_id", "frame_id", norm(F.col("dx"), F.col("dy")).alias("pos"), F.abs(F.atan2("dy", "dx")).alias("angle"))
    m = r.groupBy("seq_id").agg(F.max("pos").alias("mp"), F.max("angle").alias("ma"))
    return r.join(m, "seq_id").select("seq_id", "frame_id", _r(0.6 * F.col("pos") / F.greatest("mp", F.lit(1e-8)) + 0.4 * F.col("angle") / F.greatest("ma", F.lit(1e-8)), "signal"))


_LAGS = (3, 8, 15)


@query("visibility_jaccard", ", v AS (SELECT view_id, list(DISTINCT obj_id) AS objs, row_number() OVER (ORDER BY view_id) AS n FROM detections GROUP BY view_id) SELECT a.view_id, k AS lag, round(len(list_intersect(a.objs, b.objs)) / greatest(len(list_distinct(list_concat(a.objs, b.objs))), 1), 6) AS jaccard FROM v a, (VALUES (3), (8), (15)) l(k), v b WHERE b.n = a.n - k", "detections")
def visibility_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a view shows the same objects as the third, eighth and fifteenth before it."""
    v = numbered(scene(spark, sf_dir, "detections").groupBy("view_id").agg(F.collect_set("obj_id").alias("objs")), "view_id")
    before = v.select(F.col("number").alias("n"), F.col("objs").alias("before"))
    later = v.withColumn("lag", F.explode(F.array(*[F.lit(k) for k in _LAGS]))).withColumn("n", F.col("number") - F.col("lag"))
    j = later.join(before, "n")
    return j.select("view_id", "lag", _r(F.size(F.array_intersect("objs", "before")) / F.greatest(F.size(F.array_union("objs", "before")), F.lit(1)), "jaccard"))
