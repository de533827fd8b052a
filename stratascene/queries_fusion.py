"""Queries on fusing the object map frame by frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import fusion
from .registry import query
from .registry import rounded as _r
from .sources.adapters import scene

#: Detections with boxes in space: a point of the object, with the object's extent around it; fifty objects make a scene, eight views a frame.
_BOX = ", ".join(f"{a} - e{a} / 2" for a in "xyz"), ", ".join(f"{a} + e{a} / 2" for a in "xyz")
RULES = fusion.Rules(threshold=1.15, penalty=0.1, background=("rod",), filter_every=10, least_points=3, least_detections=2)


def framed_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, o, f = (scene(spark, sf_dir, n) for n in ("points", "objects", "features"))
    rows = p.join(o.drop("cx", "cy", "cz"), "obj_id").join(f.select(F.col("obj_id").alias("look"), F.slice("feat", 1, 8).alias("feat")), F.col("look") == F.col("obj_id") % 500)
    lo, hi = (F.array(*(F.col(a) + sign * F.col(f"e{a}") / 2 for a in "xyz")) for sign in (-1, 1))
    whole = lambda c, n: F.floor(F.col(c) / n).cast("long")
    return rows.select(whole("obj_id", 50).alias("scene_id"), whole("view_id", 8).alias("frame_id"), (F.col("pt") * 10_000_000 + F.col("obj_id")).alias("det"), "category", (F.col("pt") % 7 + 1).alias("points"), lo.alias("lo"), hi.alias("hi"), "feat", (F.col("pt") % 3 == 0).alias("contained"))


_DETECTIONS = f"""dets AS (
    SELECT obj_id // 50 AS scene_id, view_id // 8 AS frame_id, pt * 10000000 + obj_id AS det, category, (pt % 7 + 1)::BIGINT AS points, [{_BOX[0]}] AS lo, [{_BOX[1]}] AS hi, f.feat[1:8] AS feat, pt % 3 = 0 AS contained
    FROM points JOIN objects o USING (obj_id) JOIN features f ON f.obj_id = points.obj_id % 500),
marked AS (SELECT scene_id, frame_id, det, category, category IN ('rod') AS background, {{'object': det, 'n': 1::BIGINT, 'points': points, 'lo': lo, 'hi': hi, 'feat': feat, 'contained': contained, 'names': [category], 'a': frame_id, 'b': frame_id}} AS o FROM dets)"""
_UNIT = "list_transform([list_transform(range(1, 9), lambda k: (x.feat[k] * x.n + y.feat[k] * y.n) / (x.n + y.n))], lambda v: list_transform(v, lambda w: w / greatest(sqrt(list_dot_product(v, v)), 1e-8)))[1]"
_MERGED = f"lambda x, y: {{'object': x.object, 'n': x.n + y.n, 'points': x.points + y.points, 'lo': [least(x.lo[1], y.lo[1]), least(x.lo[2], y.lo[2]), least(x.lo[3], y.lo[3])], 'hi': [greatest(x.hi[1], y.hi[1]), greatest(x.hi[2], y.hi[2]), greatest(x.hi[3], y.hi[3])], 'feat': {_UNIT}, 'contained': x.contained, 'names': list_concat(x.names, y.names), 'a': least(x.a, y.a), 'b': greatest(x.b, y.b)}}"
_VOLUME = lambda v: f"(({v}.hi[1] - {v}.lo[1]) * ({v}.hi[2] - {v}.lo[2]) * ({v}.hi[3] - {v}.lo[3]))"
_INTER = "(" + " * ".join(f"greatest(0.0, least(p.hi[{k}], q.hi[{k}]) - greatest(p.lo[{k}], q.lo[{k}]))" for k in (1, 2, 3)) + ")"
_SIM = f"CASE WHEN {_INTER} > 0 THEN round({_INTER} / ({_VOLUME('p')} + {_VOLUME('q')} - {_INTER} + 1e-10) + list_dot_product(p.feat, q.feat) / greatest(sqrt(list_dot_product(p.feat, p.feat)) * sqrt(list_dot_product(q.feat, q.feat)), 1e-8) - CASE WHEN p.contained <> q.contained THEN 0.1 ELSE 0 END, 9) ELSE -1 END"


@query(
    "fused_map",
    f"""RECURSIVE, {_DETECTIONS},
frames AS (SELECT scene_id, row_number() OVER (PARTITION BY scene_id ORDER BY frame_id) AS k, ds FROM (SELECT scene_id, frame_id, list(o ORDER BY det) AS ds FROM marked WHERE NOT background GROUP BY ALL)),
state AS (
    SELECT scene_id, k, ds AS objs FROM frames WHERE k = 1
    UNION ALL
    SELECT scene_id, k, CASE WHEN k % 10 = 0 THEN list_filter(fused, lambda z: z.points >= 3 AND z.n >= 2) ELSE fused END
    FROM (
        SELECT scene_id, k, list_concat(list_transform(objs, lambda z, i: list_reduce(list_concat([z], list_filter(ds, lambda d, j: pick[j] = i)), {_MERGED})), list_filter(ds, lambda d, j: pick[j] = 0)) AS fused
        FROM (
            SELECT scene_id, k, objs, ds, list_transform(sims, lambda s: CASE WHEN len(s) = 0 OR list_max(s) < 1.15 THEN 0 ELSE list_position(s, list_max(s)) END) AS pick
            FROM (SELECT f.scene_id, f.k, objs, ds, list_transform(ds, lambda p: list_transform(objs, lambda q: {_SIM})) AS sims FROM state s JOIN frames f ON f.scene_id = s.scene_id AND f.k = s.k + 1)))),
final AS (
    SELECT scene_id, false AS background, unnest(objs) AS o FROM (SELECT scene_id, arg_max(objs, k) AS objs FROM state GROUP BY scene_id)
    UNION ALL
    SELECT scene_id, true, list_reduce(list(o ORDER BY frame_id, det), {_MERGED}) FROM marked WHERE background GROUP BY scene_id, category)
SELECT scene_id, o.object AS object, background, o.n AS n, o.points AS points, round(o.lo[1] + o.lo[2] + o.lo[3], 6) AS lo, round(o.hi[1] + o.hi[2] + o.hi[3], 6) AS hi, round(list_sum(o.feat), 6) AS feat, o.a AS first_frame, o.b AS last_frame,
       (SELECT min(c) FROM (SELECT c, count(*) AS m FROM (SELECT unnest(o.names) AS c) GROUP BY c) WHERE m = (SELECT max(m) FROM (SELECT count(*) AS m FROM (SELECT unnest(o.names) AS c) GROUP BY c))) AS category
FROM final""",
    "points", "objects", "features",
)
def fused_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The objects of every scene after its last frame: matched by box and features, background merged by class, rare ones filtered every ten frames."""
    total = lambda c: _r(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), c)
    m = fusion.fused_map(framed_detections(spark, sf_dir), RULES)
    return m.select("scene_id", "object", "background", "n", "points", total("lo"), total("hi"), total("feat"), "first_frame", "last_frame", fusion.category_of().alias("category"))
