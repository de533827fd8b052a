"""Registered queries of the scene operators, each with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import camera
from .functions.relations import ALIASES, between, norm, relation_join
from .functions.sweeps import Side, near_pairs
from .functions.vectors import cosine, literal
from .operators import graph, mapping, retrieval, views
from .operators.overlaps import box_overlaps
from .plans.grounding import Grounding, Node, Select, category_scan, colour_filter, quick_filter, spatial_query, superlative_query
from .registry import ORACLE_SQL, QUERIES, query
from .registry import rounded as _r
from .sources.adapters import scene
from .streaming.windows import windowed_counts

# --- relations -----------------------------------------------------------------------------------------------------

_D = "SELECT t.obj_id, t.cx - a.cx AS dx, t.cy - a.cy AS dy, t.cz - a.cz AS dz FROM objects t, objects a WHERE t.category = 'bolt' AND a.category = 'anvil'"
_H, _R = "sqrt(dx * dx + dy * dy)", "sqrt(dx * dx + dy * dy + dz * dz)"
# The condition and score that define each relation.
_RELATIONS = {
    "on_top_of": (f"dz >= 0 AND {_H} <= 0.5", f"0.6 * greatest(0.0, 1 - {_H} / 0.5) + 0.4 * least(1.0, dz / 0.3)"),
    "above": (f"dz >= 0.1 AND {_H} <= 1", f"0.5 * greatest(0.0, 1 - {_H}) + 0.5 * least(1.0, dz)"),
    "below": (f"dz <= -0.1 AND {_H} <= 1", f"0.5 * greatest(0.0, 1 - {_H}) + 0.5 * least(1.0, abs(dz))"),
    "next_to": (f"{_R} <= 1", f"greatest(0.0, 1 - {_R})"),
    "near": (f"{_R} <= 2", f"greatest(0.0, 1 - {_R} / 2)"),
    "around": (f"{_R} <= 2", f"greatest(0.0, 1 - {_R} / 2)"),
    "against": (f"{_R} <= 0.5", f"greatest(0.0, 1 - {_R} / 0.5)"),
    "in_front_of": ("dy > 0 AND abs(dx) <= dy", "least(1.0, dy / 2) * greatest(0.0, 1 - abs(dx) / dy)"),
    "behind": ("dy < 0 AND abs(dx) <= abs(dy)", "least(1.0, abs(dy) / 2) * greatest(0.0, 1 - abs(dx) / abs(dy))"),
    "left_of": ("dx < 0 AND abs(dy) <= abs(dx)", "least(1.0, abs(dx) / 2)"),
    "right_of": ("dx > 0 AND abs(dy) <= abs(dx)", "least(1.0, abs(dx) / 2)"),
}


def _relation_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        o = scene(spark, sf_dir, "objects")
        return relation_join(o.where("category = 'bolt'"), o.where("category = 'anvil'"), name).select("obj_id", _r("score", "score"))

    return run


for _name, (_cond, _score) in _RELATIONS.items():
    query(f"rel_{_name}", f"SELECT obj_id, round(max({_score}), 6) AS score FROM ({_D}) WHERE {_cond} GROUP BY obj_id", "objects")(_relation_query(_name))

query(
    "rel_inside",
    """SELECT t.obj_id, round(max(greatest(0.0, 1 - (abs(t.cx - a.cx) / (a.ex / 2 + 1e-6) + abs(t.cy - a.cy) / (a.ey / 2 + 1e-6) + abs(t.cz - a.cz) / (a.ez / 2 + 1e-6)) / 3)), 6) AS score
FROM objects t, objects a WHERE t.category = 'bolt' AND a.category = 'anvil'
AND t.cx >= a.cx - a.ex / 2 - 0.1 AND t.cx <= a.cx + a.ex / 2 + 0.1 AND t.cy >= a.cy - a.ey / 2 - 0.1 AND t.cy <= a.cy + a.ey / 2 + 0.1
AND t.cz >= a.cz - a.ez / 2 - 0.1 AND t.cz <= a.cz + a.ez / 2 + 0.1 GROUP BY t.obj_id""",
    "objects",
)(_relation_query("inside"))


@query(
    "rel_between",
    """, a AS (SELECT * FROM objects WHERE category = 'anvil' ORDER BY obj_id LIMIT 1), b AS (SELECT * FROM objects WHERE category = 'rod' ORDER BY obj_id LIMIT 1),
p AS (SELECT t.obj_id, t.cx - a.cx AS x, t.cy - a.cy AS y, t.cz - a.cz AS z, b.cx - a.cx AS u, b.cy - a.cy AS v, b.cz - a.cz AS w FROM objects t, a, b WHERE t.category = 'bolt'),
q AS (SELECT *, sqrt(u * u + v * v + w * w) AS len, (x * u + y * v + z * w) / sqrt(u * u + v * v + w * w) AS proj FROM p),
r AS (SELECT *, sqrt((x - proj * u / len) * (x - proj * u / len) + (y - proj * v / len) * (y - proj * v / len) + (z - proj * w / len) * (z - proj * w / len)) AS off FROM q)
SELECT obj_id, round(0.5 * (1 - abs(proj - len / 2) / (len / 2)) + 0.5 * (1 - off / (0.3 * len)), 6) AS score FROM r WHERE len >= 1e-6 AND proj >= 0 AND proj <= len AND off <= 0.3 * len""".lstrip(),
    "objects",
)
def rel_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = scene(spark, sf_dir, "objects")
    c = ("cx", "cy", "cz")
    ends = [o.where(F.col("category") == name).orderBy("obj_id").limit(1).select(*[F.col(x).alias(f"{x}{k}") for x in c]) for k, name in enumerate(("anvil", "rod"))]
    rows = o.where("category = 'bolt'").crossJoin(F.broadcast(ends[0])).crossJoin(F.broadcast(ends[1]))  # one row each
    ok, score = between(tuple(F.col(x) for x in c), tuple(F.col(f"{x}0") for x in c), tuple(F.col(f"{x}1") for x in c))
    return rows.where(ok).select("obj_id", _r(score, "score"))


_SAID = {"resting_on": "on_top_of", "over": "above", "underneath": "below", "next": "next_to", "by": "near", "facing": "in_front_of", "back": "behind", "on_the_left_of": "left_of", "on_the_right_of": "right_of", "contained_in": "inside", "in_between": "between", "leaning_against": "against", "surrounding": "around", "alongside": None}


@query(
    "relation_aliases",
    """, said AS (SELECT obj_id, (['resting_on', 'over', 'underneath', 'next', 'by', 'facing', 'back', 'on_the_left_of', 'on_the_right_of', 'contained_in', 'in_between', 'leaning_against', 'surrounding', 'alongside'])[1 + obj_id % 14] AS word FROM objects)
SELECT obj_id, CASE word WHEN 'resting_on' THEN 'on_top_of' WHEN 'over' THEN 'above' WHEN 'underneath' THEN 'below' WHEN 'next' THEN 'next_to' WHEN 'by' THEN 'near' WHEN 'facing' THEN 'in_front_of' WHEN 'back' THEN 'behind'
WHEN 'on_the_left_of' THEN 'left_of' WHEN 'on_the_right_of' THEN 'right_of' WHEN 'contained_in' THEN 'inside' WHEN 'in_between' THEN 'between' WHEN 'leaning_against' THEN 'against' WHEN 'surrounding' THEN 'around' END AS relation FROM said""",
    "objects",
)
def relation_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What objects' relation words mean; an unknown one means nothing."""
    word = F.element_at(F.array(*[F.lit(w) for w in _SAID]), (1 + F.col("obj_id") % 14).cast("int"))
    names = F.create_map(*[F.lit(x) for k, ws in ALIASES.items() for w in ws for x in (w, k)])
    return scene(spark, sf_dir, "objects").select("obj_id", names[word].alias("relation"))


# --- grounding -----------------------------------------------------------------------------------------------------

_NEAR = f"SELECT obj_id, max(greatest(0.0, 1 - {_R} / 2)) AS score FROM ({_D}) WHERE {_R} <= 2 GROUP BY obj_id"


@query(
    "ground_near_unique",
    f""", m AS (SELECT avg(cx) AS mx, avg(cy) AS my, avg(cz) AS mz FROM objects WHERE category = 'anvil'),
q AS (SELECT obj_id, sqrt((cx - mx) * (cx - mx) + (cy - my) * (cy - my) + (cz - mz) * (cz - mz)) < 4.5 AS ok FROM objects, m WHERE category = 'bolt'),
k AS (SELECT obj_id FROM q WHERE ok OR NOT (SELECT bool_or(ok) FROM q)), s AS ({_NEAR})
SELECT obj_id, round(s.score, 6) AS score FROM s JOIN k USING (obj_id) ORDER BY round(s.score, 9) DESC, obj_id LIMIT 1""".lstrip(),
    "objects",
)
def ground_near_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bolt near the anvil."""
    return Grounding(scene(spark, sf_dir, "objects")).best(spatial_query("bolt", "near", "anvil")).select("obj_id", _r("score", "score"))


@query(
    "ground_nested",
    """, rods AS (SELECT t.obj_id, t.cx, t.cy, t.cz FROM objects t WHERE t.category = 'rod' AND EXISTS (SELECT 1 FROM objects a WHERE a.category = 'anvil'
  AND sqrt((t.cx - a.cx) * (t.cx - a.cx) + (t.cy - a.cy) * (t.cy - a.cy) + (t.cz - a.cz) * (t.cz - a.cz)) <= 1)),
bolts AS (SELECT * FROM objects WHERE category = 'bolt' AND attr = 'red')
SELECT b.obj_id, round(max(greatest(0.0, 1 - sqrt((b.cx - r.cx) * (b.cx - r.cx) + (b.cy - r.cy) * (b.cy - r.cy) + (b.cz - r.cz) * (b.cz - r.cz)) / 2)), 6) AS score
FROM bolts b, rods r WHERE sqrt((b.cx - r.cx) * (b.cx - r.cx) + (b.cy - r.cy) * (b.cy - r.cy) + (b.cz - r.cz) * (b.cz - r.cz)) <= 2 GROUP BY b.obj_id""".lstrip(),
    "objects",
)
def ground_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The red bolts near a rod that is next to an anvil."""
    node = Node("bolt", ("red",), (("near", (spatial_query("rod", "next_to", "anvil"),)),))
    return Grounding(scene(spark, sf_dir, "objects"), quick_filters=False).answers(node).select("obj_id", _r("score", "score"))


@query(
    "ground_two_constraints",
    f""", n AS ({_NEAR}), l AS (SELECT t.obj_id, max(least(1.0, abs(t.cx - a.cx) / 2)) AS score FROM objects t, objects a WHERE t.category = 'bolt' AND a.category = 'rod'
  AND t.cx - a.cx < 0 AND abs(t.cy - a.cy) <= abs(t.cx - a.cx) GROUP BY t.obj_id)
SELECT obj_id, round(n.score * l.score, 6) AS score FROM n JOIN l USING (obj_id)""".lstrip(),
    "objects",
)
def ground_two_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bolts near an anvil and left of a rod."""
    node = Node("bolt", (), (("near", (Node("anvil"),)), ("left of", (Node("rod"),))))
    return Grounding(scene(spark, sf_dir, "objects"), quick_filters=False).answers(node).select("obj_id", _r("score", "score"))


@query("ground_missing_anchor", "SELECT obj_id, CAST(1.0 AS DOUBLE) AS score FROM objects WHERE category = 'bolt'", "objects")
def ground_missing_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An anchor that isn't there says nothing."""
    return Grounding(scene(spark, sf_dir, "objects")).answers(spatial_query("bolt", "near", "unicorn")).select("obj_id", "score")


@query("ground_largest", "SELECT obj_id FROM objects WHERE category = 'ring' ORDER BY ex * ey * ez DESC, obj_id LIMIT 1", "objects")
def ground_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Grounding(scene(spark, sf_dir, "objects")).answers(superlative_query("ring", "size", "max")).select("obj_id")


@query(
    "ground_nearest",
    """SELECT t.obj_id FROM objects t, objects a WHERE t.category = 'ring' AND a.category = 'widget' GROUP BY t.obj_id
ORDER BY min(sqrt((t.cx - a.cx) * (t.cx - a.cx) + (t.cy - a.cy) * (t.cy - a.cy) + (t.cz - a.cz) * (t.cz - a.cz))), t.obj_id LIMIT 1""",
    "objects",
)
def ground_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = Node("ring", select=Select("superlative", "distance", "min", reference=Node("widget")))
    return Grounding(scene(spark, sf_dir, "objects")).answers(node).select("obj_id")


@query("ground_ordinal", "SELECT obj_id FROM objects WHERE category = 'ring' ORDER BY cx, obj_id LIMIT 1 OFFSET 1", "objects")
def ground_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second ring from the left."""
    return Grounding(scene(spark, sf_dir, "objects")).answers(Node("ring", select=Select("ordinal", "x", "asc", 2))).select("obj_id")


@query("category_scan", "SELECT obj_id, category FROM objects WHERE contains(category, 'i') AND contains(category, 'g')  AND contains(category, 'ing')", "objects")
def category_scan_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return category_scan(scene(spark, sf_dir, "objects"), "ing").select("obj_id", "category")


@query("colour_filter", "SELECT obj_id FROM objects WHERE category = 'gear' AND contains(attr || ' ' || category, 'red')", "objects")
def colour_filter_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return colour_filter(scene(spark, sf_dir, "objects").where("category = 'gear'"), "red").select("obj_id")


@query("colour_filter_fallback", "SELECT obj_id FROM objects WHERE category = 'gear'", "objects")
def colour_filter_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return colour_filter(scene(spark, sf_dir, "objects").where("category = 'gear'"), "purple").select("obj_id")


def _quick_sql(condition: str) -> str:
    return f""", m AS (SELECT avg(cx) AS mx, avg(cy) AS my, avg(cz) AS mz FROM objects WHERE category = 'anvil'),
q AS (SELECT obj_id, {condition} AS ok FROM objects, m WHERE category = 'bolt') SELECT obj_id FROM q WHERE ok OR NOT (SELECT bool_or(ok) FROM q)""".lstrip()


_MR = "sqrt((cx - mx) * (cx - mx) + (cy - my) * (cy - my) + (cz - mz) * (cz - mz))"
# Each quick filter's condition.
for _name, _cond in {"on_top_of": "cz - mz > 0", "above": "cz - mz > 0.1", "below": "cz - mz < -0.1", "higher_than": "cz - mz > 0.05", "lower_than": "cz - mz < -0.05", "near": f"{_MR} < 4.5", "next_to": f"{_MR} < 2.25", "close_to": f"{_MR} < 3.0", "far_from": f"{_MR} > 2.1"}.items():

    def _quick(spark: SparkSession, sf_dir: str, name: str = _name) -> DataFrame:
        o = scene(spark, sf_dir, "objects")
        return quick_filter(o.where("category = 'bolt'"), o.where("category = 'anvil'"), name).select("obj_id")

    query(f"quick_{_name}", _quick_sql(_cond), "objects")(_quick)


# --- joins in space ------------------------------------------------------------------------------------------------

_DIST = "sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) + (a.cz - b.cz) * (a.cz - b.cz))"


@query("radius_self_join", f"SELECT a.obj_id, b.obj_id AS other, round({_DIST}, 6) AS distance FROM objects a, objects b WHERE a.obj_id <> b.obj_id AND {_DIST} <= 0.8", "objects")
def radius_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    def both_ways(a: Side, b: Side, far: np.ndarray) -> dict[str, np.ndarray]:
        other = a["obj_id"] != b["obj_id"]
        a, b, far = a.only(other), b.only(other), far[other]
        return {"obj_id": np.concatenate((a["obj_id"], b["obj_id"])), "other": np.concatenate((b["obj_id"], a["obj_id"])), "distance": np.concatenate((far, far))}

    o = scene(spark, sf_dir, "objects").select("obj_id", "cx", "cy", "cz")
    return near_pairs(o, ("cx", "cy", "cz"), 0.8, both_ways, "obj_id long, other long, distance double").select("obj_id", "other", _r("distance", "distance"))


@query("knn_point", "SELECT obj_id, round(sqrt((cx - 5) * (cx - 5) + (cy - 5) * (cy - 5) + (cz - 1) * (cz - 1)), 6) AS distance FROM objects ORDER BY sqrt((cx - 5) * (cx - 5) + (cy - 5) * (cy - 5) + (cz - 1) * (cz - 1)), obj_id LIMIT 10", "objects")
def knn_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = norm(F.col("cx") - 5, F.col("cy") - 5, F.col("cz") - 1)
    return scene(spark, sf_dir, "objects").orderBy(d, "obj_id").limit(10).select("obj_id", _r(d, "distance"))


_BOTH = "sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) + (a.cz - b.cz) * (a.cz - b.cz))"


@query(
    "nearby_descriptions",
    f""", d AS (SELECT a.obj_id, a.category, a.cx - b.cx AS dx, a.cy - b.cy AS dy, b.obj_id AS other, b.category AS name, {_BOTH} AS d FROM objects a, objects b WHERE a.obj_id <> b.obj_id AND {_BOTH} < 3),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY obj_id ORDER BY round(d, 9), other) AS r FROM d WHERE d < 2) WHERE r = 1), z AS (SELECT obj_id, list_sort(list(DISTINCT name)) AS names FROM d GROUP BY obj_id)
SELECT o.obj_id, CASE WHEN n.obj_id IS NULL THEN 'Standalone ' || o.category ELSE CASE WHEN abs(dx) > abs(dy) THEN CASE WHEN dx > 0 THEN 'To the right of' ELSE 'To the left of' END WHEN dy > 0 THEN 'In front of' ELSE 'Behind' END || ' the ' || name END AS spatial,
round(n.d, 4) AS distance, CASE WHEN names IS NULL THEN '' WHEN list_contains(names, 'anvil') THEN 'Part of the forge' WHEN list_contains(names, 'gear') OR list_contains(names, 'ring') THEN 'Part of the workshop' ELSE 'Near ' || array_to_string(names[1:3], ', ') END AS context
FROM objects o LEFT JOIN n ON n.obj_id = o.obj_id LEFT JOIN z ON z.obj_id = o.obj_id""",
    "objects",
)
def nearby_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where an object stands: the nearest one within 2 m and its side, and the zone that categories within 3 m make."""
    from .operators.descriptions import describe

    d = describe(scene(spark, sf_dir, "objects"), {"forge": ("anvil",), "workshop": ("gear", "ring")})
    return d.select("obj_id", F.regexp_replace("spatial", ", about .*$", "").alias("spatial"), _r("distance", "distance", 4), "context")


# --- views ---------------------------------------------------------------------------------------------------------

_VIS = """vis AS (SELECT obj_id, view_id, d, 0.25 * greatest(0.0, 1 - d / 5) + 0.15 * greatest(0.0, ((cx - px) * fwx + (cy - py) * fwy + (cz - pz) * fwz) / greatest(d, 1e-8))
+ 0.20 * least(600.0 / greatest(d, 0.1) / 100, 1.0) + 0.15 AS score FROM (SELECT *, sqrt((cx - px) * (cx - px) + (cy - py) * (cy - py) + (cz - pz) * (cz - pz)) AS d FROM objects, poses) WHERE d <= 5 AND greatest(0.0, 1 - d / 5) >= 0.1)"""


@query("visibility_top_views", f", {_VIS} SELECT obj_id, view_id, round(score, 6) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY obj_id ORDER BY score DESC, view_id) AS INT) AS rank FROM vis) WHERE rank <= 3", "objects", "poses")
def visibility_top_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.visibility(scene(spark, sf_dir, "objects"), scene(spark, sf_dir, "poses"))
    return views.top_per(v, "obj_id", 3, "view_id").select("obj_id", "view_id", _r("score", "score"), "rank")


@query("visibility_own_weights", ", d AS (SELECT obj_id, view_id, sqrt((cx - px) * (cx - px) + (cy - py) * (cy - py) + (cz - pz) * (cz - pz)) AS d, (cx - px) * fwx + (cy - py) * fwy + (cz - pz) * fwz AS a FROM objects, poses) SELECT obj_id, max(round(0.6 * greatest(0.0, 1 - d / 5.0) + 0.15 * greatest(0.0, a / greatest(d, 1e-8)) + 0.05 * least(600.0 / greatest(d, 0.1) / 100, 1.0) + 0.15, 6)) AS score FROM d WHERE 1 - d / 5.0 >= 0.1 GROUP BY obj_id", "objects", "poses")
def visibility_own_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best view's score by other weights."""
    v = views.visibility(scene(spark, sf_dir, "objects"), scene(spark, sf_dir, "poses"), {"visibility": 0.6, "resolution": 0.05})
    return v.groupBy("obj_id").agg(F.round(F.max("score"), 6).alias("score"))


@query("visibility_top_objects", f", {_VIS} SELECT obj_id, view_id, round(score, 6) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY view_id ORDER BY score DESC, obj_id) AS INT) AS rank FROM vis WHERE score >= 0.3) WHERE rank <= 5", "objects", "poses")
def visibility_top_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.visibility(scene(spark, sf_dir, "objects"), scene(spark, sf_dir, "poses"))
    return views.top_of_many(v, "view_id", 5, "obj_id", 0.3).select("obj_id", "view_id", _r("score", "score"), "rank")


@query(
    "detection_visibility",
    """, g AS (SELECT obj_id, view_id, max(greatest(0.0, least(1.0, (x2 - x1) * (y2 - y1) / (0.3 * 816000.0)) - 0.3 * CASE WHEN x1 < 10 OR y1 < 10 OR x2 > 1190 OR y2 > 670 THEN 1.0 ELSE 0.0 END)) AS c,
max(least(1.0, pixel_area / (0.2 * 816000.0))) AS q, count(*) AS n FROM detections GROUP BY ALL),
h AS (SELECT g.*, sqrt((cx - px) * (cx - px) + (cy - py) * (cy - py) + (cz - pz) * (cz - pz)) AS d, -((cx - px) * fwx + (cy - py) * fwy + (cz - pz) * fwz) AS b FROM g JOIN objects USING (obj_id) JOIN poses USING (view_id))
SELECT obj_id, view_id, n, round(0.5 * c + 0.3 * CASE WHEN d > 5 THEN 0.0 ELSE 0.6 * greatest(0.0, 1 - d / 5) + 0.4 * greatest(0.0, b / greatest(d, 1e-8)) END + 0.2 * CASE WHEN q > 0 THEN q ELSE least(1.0, n / 3.0) END, 6) AS score FROM h""".lstrip(),
    "detections", "objects", "poses",
)
def detection_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.detection_visibility(scene(spark, sf_dir, "detections"), scene(spark, sf_dir, "objects"), scene(spark, sf_dir, "poses")).select("obj_id", "view_id", "n", _r("score", "score"))


def _coverage_sql(k: int) -> str:
    parts = [f", {_VIS}", ", s AS (SELECT v.obj_id, v.view_id, round(v.score, 6) AS score FROM vis v JOIN objects o USING (obj_id) WHERE o.category = 'widget' AND o.attr = 'red')", ", c0 AS (SELECT DISTINCT obj_id, CAST(0.0 AS DOUBLE) AS covered FROM s)"]
    for n in range(1, k + 1):
        parts.append(f", b{n} AS (SELECT {n} AS round, view_id, sum(greatest(0.0, score - covered)) AS gain FROM s JOIN c{n - 1} USING (obj_id) GROUP BY view_id HAVING sum(greatest(0.0, score - covered)) > 0 ORDER BY round(sum(greatest(0.0, score - covered)), 6) DESC, view_id LIMIT 1)")
        parts.append(f", c{n} AS (SELECT c.obj_id, greatest(covered, coalesce(a.score, 0.0)) AS covered FROM c{n - 1} c LEFT JOIN (SELECT s.obj_id, s.score FROM s JOIN b{n} USING (view_id)) a USING (obj_id))")
    return " ".join(parts).lstrip() + " " + " UNION ALL ".join(f"SELECT round, view_id, round(gain, 6) AS gain FROM b{n}" for n in range(1, k + 1))


@query("joint_coverage", _coverage_sql(3), "objects", "poses")
def joint_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = scene(spark, sf_dir, "objects").where("category = 'widget' AND attr = 'red'")
    s = views.visibility(o, scene(spark, sf_dir, "poses")).withColumn("score", F.round("score", 6))
    return views.joint_coverage(s, 3).select("round", "view_id", _r("gain", "gain"))


# --- vectors -------------------------------------------------------------------------------------------------------

_Q = [((k * 37) % 11 - 5) / 10 for k in range(64)]
_QL = "CAST([" + ", ".join(map(str, _Q)) + "] AS DOUBLE[])"
_SIM = f"list_dot_product(feat, {_QL}) / (sqrt(list_dot_product(feat, feat)) * sqrt(list_dot_product({_QL}, {_QL})))"
_MEANS = "m AS (SELECT region, list(v ORDER BY k) AS f FROM (SELECT region, k, avg(v) AS v FROM (SELECT region, unnest(feat) AS v, generate_subscripts(feat, 1) AS k FROM features) GROUP BY ALL) GROUP BY region)"


@query("vector_top_k", f"SELECT obj_id, round({_SIM}, 6) AS sim FROM features ORDER BY {_SIM} DESC, obj_id LIMIT 10", "features")
def vector_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.vector_top_k(scene(spark, sf_dir, "features"), literal(_Q), 10).select("obj_id", _r("sim", "sim"))


@query("similarity_heat", f"SELECT obj_id, round(({_SIM} - min({_SIM}) OVER ()) / greatest(max({_SIM}) OVER () - min({_SIM}) OVER (), 1e-8), 6) AS scaled FROM features", "features")
def similarity_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = scene(spark, sf_dir, "features").select("obj_id", cosine(F.col("feat"), literal(_Q)).alias("sim"))
    return retrieval.min_max_scaled(f, "sim").select("obj_id", _r("scaled", "scaled"))


@query("region_features", f", {_MEANS} SELECT region, round(list_sum(f), 6) AS total, len(f) AS dims FROM m", "features")
def region_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = retrieval.region_features(scene(spark, sf_dir, "features"))
    return r.select("region", _r(F.aggregate("feat", F.lit(0.0), lambda a, x: a + x), "total"), F.size("feat").cast("long").alias("dims"))


@query("hierarchical_search", f", {_MEANS}, b AS (SELECT region FROM m ORDER BY {_SIM.replace('feat', 'f')} DESC, region LIMIT 2) SELECT obj_id, round({_SIM}, 6) AS sim FROM features WHERE region IN (SELECT region FROM b) ORDER BY {_SIM} DESC, obj_id LIMIT 5", "features")
def hierarchical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.hierarchical_search(scene(spark, sf_dir, "features"), literal(_Q), 2, 5).select("obj_id", _r("sim", "sim"))


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = scene(spark, sf_dir, "features")
    classes = retrieval.region_features(f).select(F.col("region").alias("class_id"), F.col("feat").alias("cfeat"))
    return f.join(retrieval.classify(f, classes), "obj_id").select(F.col("region").alias("gt"), "pred")


_PRED = f", {_MEANS}, s AS (SELECT obj_id, features.region AS gt, m.region AS pred, list_dot_product(feat, f) / (sqrt(list_dot_product(feat, feat)) * sqrt(list_dot_product(f, f))) AS sim FROM features, m), p AS (SELECT gt, arg_max(pred, sim) AS pred FROM s GROUP BY obj_id, gt)"


@query("confusion", f"{_PRED} SELECT gt, pred, count(*) AS n FROM p GROUP BY ALL", "features")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.confusion(_predicted(spark, sf_dir))


@query(
    "segmentation_metrics",
    f"""{_PRED}, c AS (SELECT coalesce(g.k, q.k) AS k, coalesce(g, 0) AS g, coalesce(tp, 0) AS tp, coalesce(q, 0) AS q FROM (SELECT gt AS k, count(*) AS g, count(*) FILTER (gt = pred) AS tp FROM p GROUP BY gt) g
FULL JOIN (SELECT pred AS k, count(*) AS q FROM p GROUP BY pred) q ON g.k = q.k),
r AS (SELECT k AS class_id, tp / greatest(1.0, g + q - tp) AS iou, tp / greatest(1.0, q) AS pr, tp / greatest(1.0, g) AS re FROM c)
SELECT class_id, round(iou, 6) AS iou, round(pr, 6) AS precision, round(re, 6) AS recall, round(2 * pr * re / greatest(1.0, pr + re), 6) AS f1 FROM r""",
    "features",
)
def segmentation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = retrieval.segmentation_metrics(retrieval.confusion(_predicted(spark, sf_dir)))
    return m.select("class_id", *(_r(c, c) for c in ("iou", "precision", "recall", "f1")))


@query("hybrid_full_outer", f", t AS (SELECT obj_id, {_SIM} AS sem FROM features ORDER BY {_SIM} DESC, obj_id LIMIT 30), p AS (SELECT obj_id, 1 - least(sqrt((cx - 5) * (cx - 5) + (cy - 5) * (cy - 5)) / 3, 1.0) AS spat FROM objects ORDER BY sqrt((cx - 5) * (cx - 5) + (cy - 5) * (cy - 5)), obj_id LIMIT 30) SELECT coalesce(t.obj_id, p.obj_id) AS obj_id, round(0.7 * coalesce(sem, 0.0) + 0.3 * coalesce(spat, 0.0), 6) AS score FROM t FULL JOIN p ON t.obj_id = p.obj_id", "features", "objects")
def hybrid_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = retrieval.vector_top_k(scene(spark, sf_dir, "features"), literal(_Q), 30)
    d = norm(F.col("cx") - 5, F.col("cy") - 5)
    p = scene(spark, sf_dir, "objects").orderBy(d, "obj_id").limit(30).select("obj_id", (1 - F.least(d / 3, F.lit(1.0))).alias("spat"))
    return t.join(p, "obj_id", "full_outer").select("obj_id", _r(0.7 * F.coalesce("sim", F.lit(0.0)) + 0.3 * F.coalesce("spat", F.lit(0.0)), "score"))


# --- boxes, merges, filters ----------------------------------------------------------------------------------------


def _axis(op: str, c: str) -> str:
    e = {"cx": "ex", "cy": "ey", "cz": "ez"}[c]
    return {"i": f"greatest(0.0, least(a.{c} + a.{e} / 2, b.{c} + b.{e} / 2) - greatest(a.{c} - a.{e} / 2, b.{c} - b.{e} / 2))", "h": f"(greatest(a.{c} + a.{e} / 2, b.{c} + b.{e} / 2) - least(a.{c} - a.{e} / 2, b.{c} - b.{e} / 2))"}[op]


_I = " * ".join(_axis("i", c) for c in ("cx", "cy", "cz"))
_HULL = " * ".join(_axis("h", c) for c in ("cx", "cy", "cz"))


@query(
    "box_similarity",
    f"""SELECT i, j, round(inter / (va + vb - inter + 1e-10), 6) AS iou, round(inter / (va + vb - inter + 1e-10) - (hull - (va + vb - inter)) / (hull + 1e-10), 6) AS giou, round(greatest(inter / va, inter / vb), 9) AS overlap
FROM (SELECT a.obj_id AS i, b.obj_id AS j, {_I} AS inter, {_HULL} AS hull, a.ex * a.ey * a.ez AS va, b.ex * b.ey * b.ez AS vb FROM objects a, objects b WHERE a.obj_id < b.obj_id) WHERE inter > 1e-9""",
    "objects",
)
def box_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    inter, va, vb, hull = (F.col(c) for c in ("inter", "va", "vb", "hull"))
    union = va + vb - inter
    iou = inter / (union + 1e-10)
    return box_overlaps(scene(spark, sf_dir, "objects"), "va", "vb", "hull").select("i", "j", _r(iou, "iou"), _r(iou - (hull - union) / (hull + 1e-10), "giou"), F.round(F.greatest(inter / va, inter / vb), 9).alias("overlap"))


_EDGES = f"e AS MATERIALIZED (SELECT a.obj_id AS i, b.obj_id AS j, round(greatest({_I} / (a.ex * a.ey * a.ez), {_I} / (b.ex * b.ey * b.ez)) + 1e-9, 6) AS w FROM objects a, objects b WHERE a.obj_id < b.obj_id AND {_I} > 1e-9)"
_LABELS = f"""{_EDGES}, ways AS (SELECT i, j FROM e UNION ALL SELECT j, i FROM e UNION ALL SELECT obj_id, obj_id FROM objects),
l AS (SELECT 0 AS round, obj_id, obj_id AS component FROM objects UNION ALL SELECT round + 1, i, min(component) FROM l JOIN ways ON j = obj_id WHERE round < 60 GROUP BY round, i)"""


@query("scene_components", f"RECURSIVE, {_LABELS} SELECT obj_id, component FROM l WHERE round = 60", "objects")
def scene_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.box_components(scene(spark, sf_dir, "objects"))


@query(
    "spanning_trees",
    f"""RECURSIVE, {_LABELS}, r AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY w, i, j) AS k FROM e), n AS (SELECT list(obj_id ORDER BY obj_id) AS ids FROM objects),
s AS (SELECT 0::BIGINT AS k, ids AS trees, false AS kept FROM n UNION ALL SELECT r.k, CASE WHEN trees[x.a] = trees[x.b] THEN trees ELSE list_transform(trees, lambda t: CASE WHEN t = trees[x.b] THEN trees[x.a] ELSE t END) END, trees[x.a] <> trees[x.b] FROM s JOIN r ON r.k = s.k + 1 JOIN (SELECT k, list_position(ids, i) AS a, list_position(ids, j) AS b FROM r, n) x ON x.k = r.k)
SELECT component, i, j, w FROM s JOIN r USING (k) JOIN l ON l.obj_id = i AND l.round = 60 WHERE kept""",
    "objects",
)
def spanning_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.box_spanning_trees(scene(spark, sf_dir, "objects"))


_SIMS = f"""o AS (SELECT * FROM objects JOIN features USING (obj_id)), s AS (SELECT a.obj_id AS det_id, b.obj_id, a.obj_id % 2 = 0 AS held_a, b.obj_id % 5 = 0 AS held_b, ({_I}) AS inter, ({_I}) / (a.ex * a.ey * a.ez + b.ex * b.ey * b.ez - ({_I}) + 1e-10) AS spatial,
list_dot_product(a.feat, b.feat) / (sqrt(list_dot_product(a.feat, a.feat)) * sqrt(list_dot_product(b.feat, b.feat))) AS visual FROM o a, o b WHERE a.obj_id % 3 = 1 AND b.obj_id % 3 <> 1)"""


def _best_sql(sim: str, where: str) -> str:
    return f", {_SIMS} SELECT d.obj_id AS det_id, arg_max(s.obj_id, sim) AS obj_id, round(max(sim), 6) AS sim FROM (SELECT obj_id FROM o WHERE obj_id % 3 = 1) d LEFT JOIN (SELECT *, {sim} AS sim FROM s WHERE {where}) s ON d.obj_id = s.det_id GROUP BY d.obj_id"


def _matched(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    o = scene(spark, sf_dir, "objects").join(scene(spark, sf_dir, "features"), "obj_id")
    a, b = (o.where(f"obj_id % 3 {k} 1").withColumn("contained", (F.col("obj_id") % m == 0).cast("int")) for k, m in (("=", 2), ("<>", 5)))
    return mapping.match_detections(a, b, **how).select("det_id", "obj_id", _r("sim", "sim"))


@query("match_detections", _best_sql("spatial + visual", "spatial + visual >= 1.05"), "objects", "features")
def match_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best object of each detection. Above 1 only boxes that meet can match, which the SQL doesn't presume."""
    return _matched(spark, sf_dir, threshold=1.05)


@query("match_detections_biased", _best_sql("1.95 * spatial + 0.05 * visual - CASE WHEN held_a <> held_b THEN 0.002 ELSE 0.0 END", "1.95 * spatial + 0.05 * visual - CASE WHEN held_a <> held_b THEN 0.002 ELSE 0.0 END >= 0.055"), "objects", "features")
def match_detections_biased(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More weight on boxes, and a penalty where just one side contains others."""
    return _matched(spark, sf_dir, threshold=0.055, bias=0.95, penalty=0.002)


@query("match_meeting_detections", _best_sql("spatial + visual", "inter > 0 AND spatial + visual >= 0.1"), "objects", "features")
def match_meeting_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best object of each detection among those whose box meets its own."""
    return _matched(spark, sf_dir, threshold=0.1, meeting=True)


@query("match_assignment", f", {_SIMS} SELECT det_id, obj_id FROM (SELECT det_id, obj_id, 2.0 * spatial AS sim, row_number() OVER (PARTITION BY det_id ORDER BY 2.0 * spatial DESC, obj_id) AS r FROM s) WHERE r = 1 AND sim > 0.01", "objects", "features")
def match_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells that are true in the matrix of assignments: the best object of a detection, if it is above the threshold."""
    return _matched(spark, sf_dir, threshold=0.01, bias=1.0).where("sim > 0.01").select("det_id", "obj_id")


@query("voxel_fusion", "SELECT CAST(floor(px / 2.5) AS BIGINT) AS vx, CAST(floor(py / 2.5) AS BIGINT) AS vy, count(*) AS n, round(sum(px / (1 + frame_id / 5.0)) / sum(1 / (1 + frame_id / 5.0)), 6) AS x, round(sum(py / (1 + frame_id / 5.0)) / sum(1 / (1 + frame_id / 5.0)), 6) AS y FROM trajectory GROUP BY ALL HAVING count(*) >= 2", "trajectory")
def voxel_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = scene(spark, sf_dir, "trajectory").select(F.col("px").alias("x"), F.col("py").alias("y"), F.lit(0.0).alias("z"), (1 / (1 + F.col("frame_id") / 5)).alias("w"))
    return mapping.voxel_fusion(points, 2.5).select("vx", "vy", "n", _r("x", "x"), _r("y", "y"))


@query("contained_boxes", """, d AS (SELECT *, seq_major * 10 + seq_minor AS det FROM detections), held AS (SELECT view_id, det, count(*) AS n FROM (SELECT a.view_id, a.det, a.det <> b.det
AND greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) > 0.95 * (a.x2 - a.x1) * (a.y2 - a.y1) AS ok FROM d a JOIN d b ON a.view_id = b.view_id) WHERE ok GROUP BY ALL)
SELECT d.view_id, d.det, coalesce(n, 0) AS n FROM d LEFT JOIN held ON d.view_id = held.view_id AND d.det = held.det""", "detections")  # fmt: skip
def contained_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.contained_counts(scene(spark, sf_dir, "detections").withColumn("det", F.col("seq_major") * 10 + F.col("seq_minor")))


@query("filter_detections", "SELECT obj_id, view_id, seq_major, seq_minor FROM detections JOIN objects USING (obj_id) WHERE pixel_area >= 3000 AND (category IN ('ring') OR (x2 - x1) * (y2 - y1) <= 0.05 * 816000.0) AND conf >= 0.95", "detections", "objects")
def filter_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scene(spark, sf_dir, "detections").join(scene(spark, sf_dir, "objects").select("obj_id", "category"), "obj_id")
    return mapping.filter_detections(d, ("ring",), 3000.0, 0.05, 0.95).select("obj_id", "view_id", "seq_major", "seq_minor")


@query(
    "nms",
    """RECURSIVE, d AS MATERIALIZED (SELECT DISTINCT view_id, (seq_major * 10 + seq_minor) * 10000000 + obj_id AS det, conf, x1, y1, x2, y2 FROM detections), n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY view_id ORDER BY conf DESC, det, x1, y1, x2, y2) AS k, (x2 - x1) * (y2 - y1) AS area FROM d),
p AS (SELECT a.view_id, a.k, list(b.k) AS weaker FROM n a JOIN n b ON a.view_id = b.view_id AND a.k < b.k AND greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) > 0.5 * (a.area + b.area - greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1))) GROUP BY ALL),
w AS MATERIALIZED (SELECT n.view_id, n.k, n.det, coalesce(weaker, []::BIGINT[]) AS weaker FROM n LEFT JOIN p USING (view_id, k)),
s AS (SELECT view_id, 0::BIGINT AS k, []::BIGINT[] AS gone FROM n GROUP BY view_id UNION ALL SELECT s.view_id, w.k, CASE WHEN list_contains(gone, w.k) THEN gone ELSE list_concat(gone, weaker) END FROM s JOIN w ON w.view_id = s.view_id AND w.k = s.k + 1)
SELECT w.view_id, w.det FROM s JOIN w ON w.view_id = s.view_id AND w.k = s.k + 1 WHERE NOT list_contains(gone, w.k)""",
    "detections",
)
def nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scene(spark, sf_dir, "detections").withColumn("det", (F.col("seq_major") * 10 + F.col("seq_minor")) * 10_000_000 + F.col("obj_id"))
    return mapping.non_maximum_suppression(d.select("view_id", "det", "conf", "x1", "y1", "x2", "y2"), 0.5).select("view_id", "det")


@query("grid_regions", """, b AS (SELECT min(cx) AS a, max(cx) AS b, min(cy) AS c, max(cy) AS d, min(cz) AS e, max(cz) AS f FROM objects),
k AS (SELECT obj_id, CAST(floor((cx - a) / greatest(b - a, 1e-8) * 2.99) AS BIGINT) * 9 + CAST(floor((cy - c) / greatest(d - c, 1e-8) * 2.99) AS BIGINT) * 3 + CAST(floor((cz - e) / greatest(f - e, 1e-8) * 2.99) AS BIGINT) AS cell FROM objects, b)
SELECT obj_id, CAST(dense_rank() OVER (ORDER BY cell) - 1 AS INT) AS region FROM k""", "objects")  # fmt: skip
def grid_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.grid_regions(scene(spark, sf_dir, "objects"), 27)


# --- aggregates, windows, sets -------------------------------------------------------------------------------------


@query("mode_of_view", "SELECT obj_id, view_id, n FROM (SELECT *, row_number() OVER (PARTITION BY obj_id ORDER BY n DESC, view_id) AS r FROM (SELECT obj_id, view_id, count(*) AS n FROM detections GROUP BY ALL)) WHERE r = 1", "detections")
def mode_of_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.mode_per(scene(spark, sf_dir, "detections"), "obj_id", "view_id")


@query("scene_bounds", "SELECT category, count(*) AS n, round(min(cx) - 0.5, 6) AS x0, round(max(cx) + 0.5, 6) AS x1, round(avg(cz), 6) AS z FROM objects GROUP BY ROLLUP (category)", "objects")
def scene_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scene(spark, sf_dir, "objects").rollup("category").agg(F.count(F.lit(1)).alias("n"), _r(F.min("cx") - 0.5, "x0"), _r(F.max("cx") + 0.5, "x1"), _r(F.avg("cz"), "z"))


@query("scene_extent", "SELECT round(min(cx) - 0.5, 6) AS x0, round(max(cx) + 0.5, 6) AS x1, round(min(cy) - 0.5, 6) AS y0, round(max(cy) + 0.5, 6) AS y1, round(min(cz) - 0.5, 6) AS z0, round(max(cz) + 0.5, 6) AS z1 FROM objects", "objects")
def scene_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bounds of all centroids, half a metre wider."""
    return scene(spark, sf_dir, "objects").agg(*(_r(f(f"c{a}") + d, f"{a}{k}") for a in "xyz" for k, (f, d) in enumerate(((F.min, -0.5), (F.max, 0.5)))))


@query("category_counts", "SELECT category, count(*) AS n FROM objects GROUP BY category ORDER BY n DESC, category LIMIT 5", "objects")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scene(spark, sf_dir, "objects").groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "category").limit(5)


@query("point_offsets", "SELECT obj_id, n, CAST(sum(n) OVER (PARTITION BY obj_id % 16 ORDER BY obj_id) - n AS BIGINT) AS start FROM (SELECT obj_id, count(*) AS n FROM detections GROUP BY obj_id)", "detections")
def point_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each object's points start in one of 16 shards of a point table."""
    per = scene(spark, sf_dir, "detections").groupBy("obj_id").agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("start", F.sum("n").over(Window.partitionBy(F.col("obj_id") % 16).orderBy("obj_id")) - F.col("n"))


@query("trajectory_steps", "SELECT seq_id, frame_id, round(sqrt((px - lag(px) OVER w) * (px - lag(px) OVER w) + (py - lag(py) OVER w) * (py - lag(py) OVER w)), 6) AS step FROM trajectory WINDOW w AS (PARTITION BY seq_id ORDER BY frame_id)", "trajectory")
def trajectory_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("seq_id").orderBy("frame_id")
    return scene(spark, sf_dir, "trajectory").select("seq_id", "frame_id", _r(norm(F.col("px") - F.lag("px").over(w), F.col("py") - F.lag("py").over(w)), "step"))


@query("strided_frames", "SELECT seq_id, frame_id FROM trajectory WHERE frame_id >= 2 AND frame_id < 40 AND (frame_id - 2) % 5 = 0", "trajectory")
def strided_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.poses import frame_range

    return frame_range(scene(spark, sf_dir, "trajectory"), 2, 40, 5).select("seq_id", "frame_id")


@query("unseen_objects", "SELECT obj_id FROM objects WHERE NOT EXISTS (SELECT 1 FROM detections d WHERE d.obj_id = objects.obj_id AND d.view_id < 50)", "objects", "detections")
def unseen_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scene(spark, sf_dir, "objects").join(scene(spark, sf_dir, "detections").where("view_id < 50"), "obj_id", "left_anti").select("obj_id")


@query("bev_pixels", ", b AS (SELECT min(cx) AS x0, max(cx) AS x1, min(cy) AS y0, max(cy) AS y1 FROM objects) SELECT obj_id, CAST(trunc((cx - x0) * s + (800 - (x1 - x0) * s) / 2) AS INT) AS u, CAST(trunc((cy - y0) * s + (800 - (y1 - y0) * s) / 2) AS INT) AS v FROM (SELECT *, least(800 / (x1 - x0), 800 / (y1 - y0)) * 0.9 AS s FROM objects, b)", "objects")
def bev_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = scene(spark, sf_dir, "objects")
    b = o.agg(F.min("cx").alias("x0"), F.max("cx").alias("x1"), F.min("cy").alias("y0"), F.max("cy").alias("y1"))
    s = F.least(800 / (F.col("x1") - F.col("x0")), 800 / (F.col("y1") - F.col("y0"))) * 0.9
    pixel = lambda c, lo, hi: ((F.col(c) - F.col(lo)) * s + (800 - (F.col(hi) - F.col(lo)) * s) / 2).cast("int")
    return o.crossJoin(F.broadcast(b)).select("obj_id", pixel("cx", "x0", "x1").alias("u"), pixel("cy", "y0", "y1").alias("v"))  # one row


@query("reply_cascade", r"""SELECT event_id, CAST(coalesce(CASE WHEN props LIKE '{%}' THEN json_extract_string(props, '$.k') END, nullif(regexp_extract(props, '(\d+)', 1), '')) AS BIGINT) AS picked, CASE WHEN props LIKE '{%}' AND json_extract_string(props, '$.k') IS NOT NULL THEN 0.9 WHEN regexp_matches(props, '\d') THEN 0.65 ELSE 0.0 END::DOUBLE AS confidence FROM events""")
def reply_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer's object: its JSON field, else the first number in it, with the confidence of each way."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    field = F.get_json_object("props", "$.k")
    return e.select("event_id", F.coalesce(field, F.nullif(F.regexp_extract("props", r"(\d+)", 1), F.lit(""))).cast("long").alias("picked"), F.when(field.isNotNull(), 0.9).when(F.col("props").rlike(r"\d"), 0.65).otherwise(0.0).alias("confidence"))


@query("windowed_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming window aggregate, run as a batch."""
    w = windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


# --- cameras and small kernels -------------------------------------------------------------------------------------


@query("project_points", "SELECT obj_id, round(cx * 600.0 / (cz + 1) + 599.5, 6) AS u, CAST(trunc(cy * 600.0 / (cz + 1) + 339.5) AS INT) AS v FROM objects WHERE cx * 600.0 / (cz + 1) + 599.5 < 1200 AND cy * 600.0 / (cz + 1) + 339.5 < 680", "objects")
def project_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.col("cz") + 1
    u, v = camera.project(F.col("cx"), F.col("cy"), z, 600.0, 600.0, 599.5, 339.5)
    return scene(spark, sf_dir, "objects").where(camera.in_image(u, v, z, 1200, 680)).select("obj_id", _r(u, "u"), v.cast("int").alias("v"))


@query("unproject_detections", "SELECT seq_major, seq_minor, round(((x1 + x2) / 2 - 599.5) * (1 + seq_major % 40 / 10.0) / 600.0, 6) AS x, round(((y1 + y2) / 2 - 339.5) * (1 + seq_major % 40 / 10.0) / 600.0, 6) AS y FROM detections", "detections")
def unproject_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, _ = camera.unproject((F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2, 1 + F.col("seq_major") % 40 / 10.0, 600.0, 600.0, 599.5, 339.5)
    return scene(spark, sf_dir, "detections").select("seq_major", "seq_minor", _r(x, "x"), _r(y, "y"))


@query("heading_changes", "SELECT seq_id, frame_id, round(least(((px * 100 - py * 50) % 360 + 360) % 360, 360 - ((px * 100 - py * 50) % 360 + 360) % 360), 6) AS angle FROM trajectory", "trajectory")
def heading_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scene(spark, sf_dir, "trajectory").select("seq_id", "frame_id", _r(camera.angle_between(F.col("px") * 100, F.col("py") * 50), "angle"))


@query("fov_intrinsics", "SELECT DISTINCT ez, round(680 / (2 * tan(radians(30 + ez * 100) / 2)), 6) AS focal FROM objects", "objects")
def fov_intrinsics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scene(spark, sf_dir, "objects").select("ez").distinct().select("ez", _r(camera.focal_from_fov(30 + F.col("ez") * 100, 680), "focal"))


@query("confident_detections", "SELECT obj_id, seq_major, seq_minor, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY obj_id ORDER BY conf DESC, seq_major, seq_minor) AS INT) AS rank, count(*) OVER (PARTITION BY obj_id) AS c FROM detections) WHERE rank <= 10 AND c >= 2", "detections")
def confident_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scene(spark, sf_dir, "detections")
    seen = d.groupBy("obj_id").agg(F.count(F.lit(1)).alias("c")).where("c >= 2").select("obj_id")
    rank = F.row_number().over(Window.partitionBy("obj_id").orderBy(F.col("conf").desc(), "seq_major", "seq_minor"))
    return d.join(seen, "obj_id", "left_semi").withColumn("rank", rank).where("rank <= 10").select("obj_id", "seq_major", "seq_minor", "rank")


@query("frequent_views", "SELECT obj_id, view_id, n FROM (SELECT *, row_number() OVER (PARTITION BY obj_id ORDER BY n DESC, first, view_id) AS r FROM (SELECT obj_id, view_id, count(*) AS n, min(seq_major * 10 + seq_minor) AS first FROM detections GROUP BY ALL)) WHERE r = 1", "detections")
def frequent_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scene(spark, sf_dir, "detections").withColumn("first", F.col("seq_major") * 10 + F.col("seq_minor"))
    return retrieval.mode_per(d, "obj_id", "view_id", "first")


@query("clean_tags", "SELECT obj_id, array_to_string(list_filter([attr, category, 'thing'], lambda x: NOT contains(x, 'ing')), ',') AS tags FROM objects WHERE attr <> category", "objects")
def clean_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.col("attr"), F.lit(" , "), F.col("category"), F.lit(", ,"))
    return scene(spark, sf_dir, "objects").where("attr <> category").select("obj_id", F.array_join(camera.clean_tags(text, ("thing",), ("ing",)), ",").alias("tags"))


@query("point_overlap", """, n AS (SELECT a.seq_id AS i, b.seq_id AS j, a.frame_id AS pt FROM trajectory a, trajectory b WHERE a.seq_id <> b.seq_id AND sqrt((a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py)) < 0.15 GROUP BY ALL),
c AS (SELECT seq_id AS i, count(*) AS size FROM trajectory GROUP BY seq_id) SELECT n.i, n.j, count(*) / any_value(c.size) AS ratio FROM n JOIN c ON c.i = n.i GROUP BY n.i, n.j""", "trajectory")
def point_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of the point sets that different users leave on the floor."""
    t = scene(spark, sf_dir, "trajectory").select(F.col("seq_id").alias("obj_id"), F.col("frame_id").alias("pt"), F.col("px").alias("x"), F.col("py").alias("y"), F.lit(0.0).alias("z"))
    return mapping.point_overlap(t, 0.15)


_FOLD = "lambda x, y: {'n': x.n + y.n, 'feat': list_transform([list_transform(range(1, 65), lambda k: (x.feat[k] * x.n + y.feat[k] * y.n) / (x.n + y.n))], lambda v: list_transform(v, lambda e: e / greatest(sqrt(list_dot_product(v, v)), 1e-8)))[1]}"


@query("merge_features", f", g AS (SELECT region, list({{'n': 1::BIGINT, 'feat': feat}} ORDER BY obj_id) AS l FROM features GROUP BY region), m AS (SELECT region, list_reduce(list_concat([{{'n': 0::BIGINT, 'feat': l[1].feat}}], l), {_FOLD}) AS r FROM g) SELECT region::BIGINT AS obj_id, r.n AS n, list_transform(r.feat, lambda e: round(e, 6)) AS feat FROM m", "features")
def merge_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = scene(spark, sf_dir, "features").select(F.col("region").cast("long").alias("obj_id"), F.col("obj_id").alias("seq"), F.lit(1).cast("long").alias("n"), "feat")
    return mapping.merge_features(f).select("obj_id", "n", F.transform("feat", lambda x: F.round(x, 6)).alias("feat"))


from . import queries_clouds, queries_fusion, queries_geometry, queries_mapping, queries_points, queries_retrieval, queries_sources  # noqa: E402, F401  they register themselves
