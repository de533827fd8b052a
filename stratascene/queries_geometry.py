"""Queries on cameras, poses, projections and oriented boxes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import camera, matrices
from .functions.relations import broadcast_blocks
from .functions.relations import norm
from .operators import oriented
from .registry import query
from .registry import rounded as _r
from .sources.adapters import scene


def _poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = scene(spark, sf_dir, "poses")
    return p.select("view_id", "px", "py", "pz", "fwx", "fwy", matrices.heading_pose(*(F.col(c) for c in ("px", "py", "pz", "fwx", "fwy"))).alias("m"))


@query(
    "relative_poses",
    """, f AS (SELECT * FROM poses ORDER BY view_id LIMIT 1) SELECT p.view_id, round(f.fwx * (p.px - f.px) + f.fwy * (p.py - f.py), 6) AS x, round(-f.fwy * (p.px - f.px) + f.fwx * (p.py - f.py), 6) AS y, round(p.pz - f.pz, 6) AS z,
round(f.fwx * p.fwx + f.fwy * p.fwy, 6) AS cosine, round(f.fwx * p.fwy - f.fwy * p.fwx, 6) AS sine FROM poses p, f""",
    "poses",
)
def relative_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pose as seen from the first."""
    p = _poses(spark, sf_dir)
    first = p.orderBy("view_id").limit(1).select(matrices.rigid_inverse(F.col("m")).alias("back"))
    m = p.crossJoin(F.broadcast(first)).select("view_id", matrices.product(F.col("back"), F.col("m")).alias("m"))  # one row
    return m.select("view_id", *(_r(F.col("m")[k], n) for k, n in ((3, "x"), (7, "y"), (11, "z"), (0, "cosine"), (4, "sine"))))


@query("flipped_poses", "SELECT view_id, round(fwx, 6) AS a, round(fwy, 6) AS b, round(px, 6) AS x, round(-pz, 6) AS y, round(py, 6) AS z FROM poses", "poses")
def flipped_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poses in axes with another one up."""
    m = _poses(spark, sf_dir).select("view_id", matrices.flipped_axes(F.col("m")).alias("m"))
    return m.select("view_id", *(_r(F.col("m")[k], n) for k, n in ((0, "a"), (8, "b"), (3, "x"), (7, "y"), (11, "z"))))


@query("adjusted_intrinsics", "SELECT obj_id, round((600 + ex) * (853.0 / 1280), 6) AS fx, round((610 + ey) * (480.0 / 720), 6) AS fy, round((639.5 + ex) * (639.0 / 1279), 6) AS cx, round((359.5 + ey) * (479.0 / 719), 6) AS cy, round((600 + ex) * 0.5, 6) AS half FROM objects", "objects")
def adjusted_intrinsics(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = matrices.intrinsics(600 + F.col("ex"), 610 + F.col("ey"), 639.5 + F.col("ex"), 359.5 + F.col("ey"))
    o = scene(spark, sf_dir, "objects").select("obj_id", matrices.adjusted(k, (1280, 720), (640, 480)).alias("k"), matrices.scaled(k, 0.5, 0.5)[0].alias("half"))
    return o.select("obj_id", *(_r(F.col("k")[i], n) for i, n in ((0, "fx"), (4, "fy"), (2, "cx"), (5, "cy"))), _r("half", "half"))


_BACK = "((obj_id * 7) % 1200 - 599.5) * depth / 600.0 AS xc, ((pt * 3) % 680 - 339.5) * depth / 600.0 AS yc"


@query(
    "backprojected_pixels",
    f""", c AS (SELECT points.*, {_BACK} FROM points WHERE depth > 0.5 AND depth < 8) SELECT pt, round(fwx * xc - fwy * yc + px, 6) AS x, round(fwy * xc + fwx * yc + py, 6) AS y, round(depth + pz, 6) AS z, round(1 / (1 + depth / 5), 6) AS weight FROM c JOIN poses USING (view_id)""",
    "points", "poses",
)
def backprojected_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of a valid depth as points of the world, closer ones weighing more."""
    pixels = scene(spark, sf_dir, "points").select("pt", "view_id", ((F.col("obj_id") * 7) % 1200).alias("u"), ((F.col("pt") * 3) % 680).alias("v"), "depth")
    p = camera.backproject(pixels.where(camera.valid_depth(F.col("depth"), "pixel", 0.5, 8.0)), _poses(spark, sf_dir), 600.0, 600.0, 599.5, 339.5)
    return p.select("pt", _r("x", "x"), _r("y", "y"), _r("z", "z"), _r("weight", "weight"))


@query(
    "backprojected_patches",
    f""", c AS (SELECT points.*, {_BACK} FROM points WHERE depth >= 0.1 AND depth <= 10), w AS (SELECT pt, fwx * xc - fwy * yc AS dx, fwy * xc + fwx * yc AS dy, depth AS dz, depth FROM c JOIN poses USING (view_id))
SELECT pt, round(1 / (1 + depth / 5) * greatest(0.2, abs(-dz / (sqrt(dx * dx + dy * dy + dz * dz) + 1e-8))), 6) AS weight FROM w""",
    "points", "poses",
)
def backprojected_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of patches by depth and by the angle at which they are seen."""
    pixels = scene(spark, sf_dir, "points").select("pt", "view_id", ((F.col("obj_id") * 7) % 1200).alias("u"), ((F.col("pt") * 3) % 680).alias("v"), "depth")
    p = camera.backproject(pixels.where(camera.valid_depth(F.col("depth"), "patch", 0.1, 10.0)), _poses(spark, sf_dir), 600.0, 600.0, 599.5, 339.5, by_angle=True)
    return p.select("pt", _r("weight", "weight"))


@query("depth_to_xyz", "SELECT pt, round(((pt % 160) - 80.5) * depth / 120, 6) AS x, round((120 - (obj_id % 120) - 60.5) * depth / 120, 6) AS y, round(depth, 6) AS z FROM points", "points")
def depth_to_xyz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of a depth image whose rows count from the bottom."""
    x, y, z = camera.depth_xyz(F.col("pt") % 160, F.col("obj_id") % 120, F.col("depth"), 120, 120.0, 120.0, 80.5, 60.5)
    return scene(spark, sf_dir, "points").select("pt", _r(x, "x"), _r(y, "y"), _r(z, "z"))


@query("world_points", "SELECT pt, round(fwx * x - fwy * y + px, 6) AS x, round(fwy * x + fwx * y + py, 6) AS y, round(z + pz, 6) AS z FROM points JOIN poses USING (view_id)", "points", "poses")
def world_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points moved by the pose of their view."""
    j = scene(spark, sf_dir, "points").join(_poses(spark, sf_dir).select("view_id", "m"), "view_id")
    return j.select("pt", *(_r(c, n) for c, n in zip(matrices.apply(F.col("m"), F.col("x"), F.col("y"), F.col("z")), "xyz")))


_CORNERS = "SELECT obj_id, sx, sy, sz, cx + sx * ex / 2 AS x, cy + sy * ey / 2 AS y, cz + sz * ez / 2 AS z FROM objects, (SELECT unnest([-1, 1]) AS sx), (SELECT unnest([-1, 1]) AS sy), (SELECT unnest([-1, 1]) AS sz)"


@query("box_corners", f", k AS ({_CORNERS}) SELECT obj_id, CAST((sx + 1) * 2 + (sy + 1) + (sz + 1) / 2 AS INT) AS corner, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM k", "objects")
def box_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = camera.box_corners(scene(spark, sf_dir, "objects"))
    return c.select("obj_id", "corner", _r("x", "x"), _r("y", "y"), _r("z", "z"))


@query(
    "projected_boxes",
    f""", k AS ({_CORNERS}), p AS (SELECT obj_id, (x - 5) * 300.0 / (z + 2) + 320 AS u, (y - 5) * 300.0 / (z + 2) + 240 AS v FROM k WHERE z + 2 > 0.01),
q AS (SELECT * FROM p WHERE u >= 0 AND u < 640 AND v >= 0 AND v < 480), b AS (SELECT obj_id, count(*) AS n, greatest(0, min(u)) AS x1, greatest(0, min(v)) AS y1, least(639, max(u)) AS x2, least(479, max(v)) AS y2 FROM q GROUP BY obj_id)
SELECT obj_id, CAST(trunc(x1) AS INT) AS x1, CAST(trunc(y1) AS INT) AS y1, CAST(trunc(x2) AS INT) AS x2, CAST(trunc(y2) AS INT) AS y2 FROM b WHERE n >= 2 AND x2 > x1 AND y2 > y1""",
    "objects",
)
def projected_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The image box around the corners of a box that are in view."""
    c = camera.box_corners(scene(spark, sf_dir, "objects")).select("obj_id", (F.col("x") - 5).alias("x"), (F.col("y") - 5).alias("y"), (F.col("z") + 2).alias("z"))
    return camera.image_boxes(c, 300.0, 300.0, 320.0, 240.0, 640, 480)


@query("resized_boxes", "SELECT seq_major, seq_minor, CAST(round(x1 * (640.0 / 1200)) AS INT) AS x1, CAST(round(y1 * (480.0 / 680)) AS INT) AS y1, CAST(round(x2 * (640.0 / 1200)) AS INT) AS x2, CAST(round(y2 * (480.0 / 680)) AS INT) AS y2 FROM detections", "detections")
def resized_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = {"x": 640.0 / 1200, "y": 480.0 / 680}
    return scene(spark, sf_dir, "detections").select("seq_major", "seq_minor", *(F.round(F.col(c) * ratio[c[0]]).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")))


@query(
    "crop_windows",
    """, p AS (SELECT seq_major, seq_minor, greatest(0, x1 - CAST(trunc((x2 - x1) * 0.1) AS INT)) AS a, greatest(0, y1 - CAST(trunc((y2 - y1) * 0.1) AS INT)) AS b, least(1200, x2 + CAST(trunc((x2 - x1) * 0.1) AS INT)) AS c, least(680, y2 + CAST(trunc((y2 - y1) * 0.1) AS INT)) AS d FROM detections)
SELECT seq_major, seq_minor, a, b, c, d FROM p WHERE c - a >= 32 AND d - b >= 32""",
    "detections",
)
def crop_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes padded by a share of their size and kept in the image, those too small left out."""
    w, h = (F.col("x2") - F.col("x1")) * 0.1, (F.col("y2") - F.col("y1")) * 0.1
    a, b, c, d = camera.crop_window(w.cast("int"), h.cast("int"), 1200, 680)
    p = scene(spark, sf_dir, "detections").select("seq_major", "seq_minor", a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"))
    return p.where("c - a >= 32 AND d - b >= 32")


@query("depth_validity", "SELECT pt, depth >= 0.1 AND depth <= 10 AS patch, depth > 1.2 AND depth < 8 AS pixel, depth > 0 AND depth < 5 AS cloud FROM points", "points")
def depth_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("depth")
    return scene(spark, sf_dir, "points").select("pt", camera.valid_depth(d, "patch", 0.1, 10.0).alias("patch"), camera.valid_depth(d, "pixel", 1.2, 8.0).alias("pixel"), camera.valid_depth(d, "cloud", 0.0, 5.0).alias("cloud"))


@query(
    "depth_occlusion",
    """, d AS (SELECT pt, depth, sqrt((x - px) * (x - px) + (y - py) * (y - py) + (z - pz) * (z - pz)) AS expected FROM points JOIN poses USING (view_id))
SELECT pt, abs(depth - expected) <= 0.25 * depth AS visible, depth < expected - 0.3 AS occluded, CASE WHEN expected < depth - 0.05 THEN 'front' WHEN expected > depth + 0.05 THEN 'behind' ELSE 'align' END AS side FROM d""",
    "points", "poses",
)
def depth_occlusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a point is what its pixel shows, hidden, in front or behind."""
    j = scene(spark, sf_dir, "points").join(_poses(spark, sf_dir), "view_id").withColumn("expected", norm(*(F.col(c) - F.col(f"p{c}") for c in "xyz")))
    visible, occluded, side = camera.occlusion(F.col("depth"), F.col("expected"))
    return j.select("pt", visible.alias("visible"), occluded.alias("occluded"), side.alias("side"))


@query(
    "pixel_mapping",
    """, o AS (SELECT obj_id, view_id, fwx * (cx - px) + fwy * (cy - py) AS ahead, -fwy * (cx - px) + fwx * (cy - py) AS across, cz - pz AS up FROM objects, poses),
q AS (SELECT obj_id, view_id, ahead, CAST(round(round(across * 60.0 / ahead + 60, 9)) AS INT) AS col, CAST(round(round(up * 60.0 / ahead + 34, 9)) AS INT) AS row FROM o WHERE ahead > 0.01), s AS (SELECT * FROM q WHERE col >= 0 AND col < 120 AND row >= 0 AND row < 68),
m AS (SELECT view_id, CAST(floor(x1 / 10) AS INT) AS col, CAST(floor(y1 / 10) AS INT) AS row, min(seq_major % 40) AS depth FROM detections GROUP BY ALL) SELECT s.obj_id, s.view_id, s.row, s.col, m.depth FROM s JOIN m USING (view_id, row, col)""",
    "objects", "poses", "detections",
)
def pixel_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects as pixels of views, joined with what a map holds at these pixels."""
    back = matrices.rigid_inverse(F.col("m"))
    views = _poses(spark, sf_dir).select("view_id", *(back[k].alias(f"b{k}") for k in range(12)))
    o = scene(spark, sf_dir, "objects").select("obj_id", "cx", "cy", "cz")
    o = o.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "obj_id")  # a small file is one task, and each row is as much work as there are views
    q = reduce(DataFrame.unionByName, [o.crossJoin(block) for block in broadcast_blocks(views, "view_id")])  # each object is projected into each view
    ahead, across, up = matrices.apply([F.col(f"b{k}") for k in range(12)], F.col("cx"), F.col("cy"), F.col("cz"))
    # Rounding moves a pixel by less than one and costs much more than the rest. Both coordinates are one key, or filters on each would round once for every comparison.
    # A key that is never null isn't asked for null either, before the filter.
    key = lambda col, row: F.coalesce((row + 1) * 1000 + col + 1, F.lit(-1)).alias("pixel")
    front = F.when(ahead > 0.01, ahead)
    near = camera.in_image(*(c + 1 for c in camera.project(across, up, front, 60.0, 60.0, 60.0, 34.0)), ahead, 122, 70)
    s = q.where(near).select("obj_id", "view_id", key(*camera.project(across, up, front, 60.0, 60.0, 60.0, 34.0, "nearest")))
    m = scene(spark, sf_dir, "detections").groupBy("view_id", F.floor(F.col("x1") / 10).cast("int").alias("col"), F.floor(F.col("y1") / 10).cast("int").alias("row")).agg(F.min(F.col("seq_major") % 40).alias("depth"))
    m = m.where(camera.in_image(F.col("col"), F.col("row"), F.lit(1.0), 120, 68)).select("view_id", key(F.col("col"), F.col("row")), "row", "col", "depth")
    return s.join(m, ["view_id", "pixel"]).select("obj_id", "view_id", "row", "col", "depth")


@query("rotation_distance", ", d AS (SELECT event_id, (value * 7) AS a, (value * 3 + event_id) AS b, user_id * 11.0 AS c FROM events), m AS (SELECT event_id, ((a - b) % 360 + 360) % 360 AS x, ((b - c) % 360 + 360) % 360 AS y, ((c - a) % 360 + 360) % 360 AS z FROM d) SELECT event_id, round(least(x, 360 - x) + least(y, 360 - y) + least(z, 360 - z), 5) AS angle FROM m".replace(", d AS", "WITH d AS", 1))
def rotation_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angles between two rotations, added up over three axes."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.col("value") * 7).alias("a"), (F.col("value") * 3 + F.col("event_id")).alias("b"), (F.col("user_id") * 11.0).alias("c"))
    return e.select("event_id", _r(camera.rotation_distance((F.col("a"), F.col("b"), F.col("c")), (F.col("b"), F.col("c"), F.col("a"))), "angle", 5))


@query("position_distance", "SELECT obj_id, round(abs(cx - ex) + abs(cz - ez), 6) AS l1_floor, round(abs(cx - ex) + abs(cy - ey) + abs(cz - ez), 6) AS l1, round(sqrt((cx - ex) * (cx - ex) + (cz - ez) * (cz - ez)), 6) AS l2_floor FROM objects", "objects")
def position_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = tuple(F.col(f"c{x}") for x in "xyz"), tuple(F.col(f"e{x}") for x in "xyz")
    return scene(spark, sf_dir, "objects").select("obj_id", _r(camera.position_distance(a, b, True, True), "l1_floor"), _r(camera.position_distance(a, b, l1=True), "l1"), _r(camera.position_distance(a, b, True), "l2_floor"))


@query("heat_colours", "SELECT obj_id, CASE WHEN t < 0.5 THEN CAST(trunc(510 * t) AS INT) ELSE 255 END AS r, CASE WHEN t < 0.5 THEN CAST(trunc(510 * t) AS INT) ELSE CAST(trunc(510 * (1 - t)) AS INT) END AS g, CASE WHEN t < 0.5 THEN CAST(trunc(255 * (1 - 2 * t)) AS INT) ELSE 0 END AS b FROM (SELECT obj_id, (feat[1] / 4 + 1) / 2 AS t FROM features WHERE abs(feat[1]) < 4)", "features")
def heat_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, g, b = camera.heat_colour(F.col("feat")[0] / 4)
    return scene(spark, sf_dir, "features").where(F.abs(F.col("feat")[0]) < 4).select("obj_id", r.alias("r"), g.alias("g"), b.alias("b"))


# --- oriented boxes at any angle: the SQL adds up what of either's edges lies in the other -------------------------

_YAW = "CAST(obj_id * 37 % 360 AS DOUBLE) * pi() / 180"


def _enter(c: str, h: str, last: bool) -> str:
    """Where an edge enters a slab, or leaves it."""
    f, inside, outside = ("greatest", "1", "-1") if last else ("least", "0", "2")
    return f"CASE WHEN abs(d{c}) < 1e-12 THEN CASE WHEN abs({c}0) < {h} THEN {inside} ELSE {outside} END ELSE {f}((-{h} - {c}0) / d{c}, ({h} - {c}0) / d{c}) END"


_EDGES = f"""o AS MATERIALIZED (SELECT obj_id, cx, cy, cz, greatest(ex, 0.02) AS ex, greatest(ey, 0.02) AS ey, greatest(ez, 0.02) AS ez, {_YAW} AS yaw FROM objects),
p AS MATERIALIZED (SELECT a.obj_id AS i, b.obj_id AS j, a AS a, b AS b, a.ex * a.ey * a.ez AS va, b.ex * b.ey * b.ez AS vb, greatest(0.0, least(a.cz + a.ez / 2, b.cz + b.ez / 2) - greatest(a.cz - a.ez / 2, b.cz - b.ez / 2)) AS high
      FROM o a, o b WHERE a.obj_id < b.obj_id AND sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2) <= (sqrt(a.ex ** 2 + a.ey ** 2) + sqrt(b.ex ** 2 + b.ey ** 2)) / 2),
s AS (SELECT i, j, a AS u, b AS v FROM p UNION ALL SELECT i, j, b, a FROM p),
c AS (SELECT i, j, v, u.cx + cos(u.yaw) * sx * u.ex / 2 - sin(u.yaw) * sy * u.ey / 2 AS x, u.cy + sin(u.yaw) * sx * u.ex / 2 + cos(u.yaw) * sy * u.ey / 2 AS y,
             u.cx + cos(u.yaw) * tx * u.ex / 2 - sin(u.yaw) * ty * u.ey / 2 AS x2, u.cy + sin(u.yaw) * tx * u.ex / 2 + cos(u.yaw) * ty * u.ey / 2 AS y2
      FROM s, (VALUES (-1, -1, 1, -1), (1, -1, 1, 1), (1, 1, -1, 1), (-1, 1, -1, -1)) e(sx, sy, tx, ty)),
w AS (SELECT i, j, v.ex / 2 AS hx, v.ey / 2 AS hy, x, y, x2, y2, cos(v.yaw) * (x - v.cx) + sin(v.yaw) * (y - v.cy) AS x0, cos(v.yaw) * (y - v.cy) - sin(v.yaw) * (x - v.cx) AS y0,
             cos(v.yaw) * (x2 - x) + sin(v.yaw) * (y2 - y) AS dx, cos(v.yaw) * (y2 - y) - sin(v.yaw) * (x2 - x) AS dy FROM c),
t AS (SELECT *, greatest(0.0, {_enter('x', 'hx', False)}, {_enter('y', 'hy', False)}) AS t0, least(1.0, {_enter('x', 'hx', True)}, {_enter('y', 'hy', True)}) AS t1 FROM w),
area AS (SELECT i, j, sum((x + t0 * (x2 - x)) * (y + t1 * (y2 - y)) - (x + t1 * (x2 - x)) * (y + t0 * (y2 - y))) / 2 AS area FROM t WHERE t1 > t0 GROUP BY i, j)"""


@query(
    "oriented_box_iou",
    f""", {_EDGES} SELECT i, j, round(area * high / (va + vb - area * high), 6) AS iou, round(least(1.0, area * high / va), 6) AS contained, round(va, 6) AS volume FROM p JOIN area USING (i, j) WHERE area * high > 1e-6""",
    "objects",
)
def oriented_box_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IoU and share held of boxes that are turned about the vertical by any angle."""
    return oriented.similarities(_turned(spark, sf_dir)).where("inter > 1e-6").select("i", "j", _r("iou", "iou"), _r("contained", "contained"), _r("volume", "volume"))


@query("oriented_box_giou")
def oriented_box_giou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GIoU by the convex hull of both boxes, for those that meet."""
    return oriented.similarities(_turned(spark, sf_dir), hull=True).where("inter > 1e-6").select("i", "j", _r("giou", "giou", 5))


def _turned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scene(spark, sf_dir, "objects").withColumn("yaw", F.radians((F.col("obj_id") * 37 % 360).cast("double")))
