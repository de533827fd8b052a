"""Queries on finding objects by words and vectors, on views for them, on replies and on metrics."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import boxes
from .functions.vectors import cosine, literal, normalise
from .operators import keyframes as K
from .operators import retrieval, views
from .plans.grounding import Grounding, Node, Select, attribute_filter, category_scan, quick_filter, size_rank, spatial_query
from .queries import _MEANS, _PRED, _VIS, _Q, _QL, _SIM, _D, _predicted
from .registry import query
from .registry import rounded as _r
from .sources.adapters import scene


@query("find_objects", "SELECT obj_id FROM objects WHERE contains(lower(category), 'ing') OR contains('ing', lower(category)) ORDER BY obj_id LIMIT 10", "objects")
def find_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.find_objects(scene(spark, sf_dir, "objects"), "ing", 10)


@query("find_by_vector", f"SELECT obj_id FROM (SELECT obj_id, {_SIM} AS sim FROM features ORDER BY {_SIM} DESC, obj_id LIMIT 10) WHERE sim > 0.2", "features")
def find_by_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No category has the word, so the vector finds the objects."""
    return K.find_objects(scene(spark, sf_dir, "objects"), "unicorn", 10, scene(spark, sf_dir, "features"), literal(_Q))


@query("category_synonyms", "SELECT obj_id, category FROM objects WHERE lower(category) IN ('gear', 'ring')", "objects")
def category_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name that no object has, and what else it is called."""
    return category_scan(scene(spark, sf_dir, "objects"), "cogwheel", {"cogwheel": ("gear", "ring")}).select("obj_id", "category")


@query("default_synonyms", "SELECT obj_id, category FROM (SELECT obj_id, replace(replace(category, 'gear', 'sofa'), 'bolt', 'television') AS category FROM objects) WHERE category = 'sofa'", "objects")
def default_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No object is called a couch, but some are sofas."""
    o = scene(spark, sf_dir, "objects").withColumn("category", F.expr("replace(replace(category, 'gear', 'sofa'), 'bolt', 'television')"))
    return Grounding(o).answers(Node("Couch")).select("obj_id", "category")


@query("tagged_objects", "SELECT obj_id FROM objects WHERE obj_id % 3 = 0 AND category = 'gear' OR obj_id % 3 <> 0 AND category = 'ring'", "objects")
def tagged_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object's tag counts before its category; an empty one doesn't."""
    tag = F.when(F.col("obj_id") % 3 == 0, F.when(F.col("category") == "gear", "RING").otherwise("thing")).otherwise("")
    return Grounding(scene(spark, sf_dir, "objects").withColumn("object_tag", tag)).answers(Node("ring")).select("obj_id")


@query("ground_by_look", f"SELECT obj_id FROM (SELECT obj_id, {_SIM} AS sim FROM features JOIN objects USING (obj_id) ORDER BY {_SIM} DESC, obj_id LIMIT 10) WHERE sim > 0.2", "features", "objects")
def ground_by_look(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that name nothing find objects by the vector that an encoder makes of them."""
    return Grounding(scene(spark, sf_dir, "objects"), features=scene(spark, sf_dir, "features"), encoder=lambda words: _Q if words == "unicorn" else None).answers(Node("unicorn")).select("obj_id")


@query("ground_own_thresholds", f"SELECT obj_id, round(max(greatest(0.0, 1 - sqrt(dx * dx + dy * dy + dz * dz) / 3.5)), 6) AS score FROM ({_D}) WHERE sqrt(dx * dx + dy * dy + dz * dz) <= 3.5 GROUP BY obj_id", "objects")
def ground_own_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near by one's own measure."""
    return Grounding(scene(spark, sf_dir, "objects"), quick_filters=False, thresholds={"near": {"max_distance": 3.5}}).answers(spatial_query("bolt", "close to", "anvil")).select("obj_id", _r("score", "score"))


@query("colour_word", ", q AS (SELECT obj_id, contains(lower(attr || ' ' || category), 'green') AS ok FROM objects WHERE category = 'gear') SELECT obj_id FROM q WHERE ok OR NOT (SELECT bool_or(ok) FROM q)", "objects")
def colour_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribute_filter(scene(spark, sf_dir, "objects").where("category = 'gear'"), "green").select("obj_id")


@query("colour_synonym", "SELECT obj_id FROM objects WHERE category = 'gear' AND (contains(attr || ' ' || category, 'red') OR contains(attr || ' ' || category, 'crimson') OR contains(attr || ' ' || category, 'scarlet') OR contains(attr || ' ' || category, 'maroon') OR contains(attr || ' ' || category, 'ruby'))", "objects")
def colour_synonym(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crimson asks for the whole red family."""
    return Grounding(scene(spark, sf_dir, "objects")).answers(Node("gear", ("crimson",))).select("obj_id")


@query("size_word", "SELECT obj_id FROM objects WHERE category = 'bolt' ORDER BY ex * ey * ez, obj_id LIMIT 1", "objects")
def size_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribute_filter(scene(spark, sf_dir, "objects").where("category = 'bolt'"), "tiny").select("obj_id")


@query("size_rank", "SELECT obj_id FROM objects WHERE category = 'bolt' ORDER BY ex * ey * ez DESC, obj_id LIMIT 4", "objects")
def size_rank_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return size_rank(scene(spark, sf_dir, "objects").where("category = 'bolt'"), "max", 4).select("obj_id")


_MEAN = ", m AS (SELECT avg(cx) AS mx, avg(cy) AS my, avg(cz) AS mz FROM objects WHERE category = 'anvil'), q AS (SELECT obj_id, {} AS ok FROM objects, m WHERE category = 'bolt') SELECT obj_id FROM q WHERE ok OR NOT (SELECT bool_or(ok) FROM q)"
for _name, _config, _cond in (("left", ("x", "lt", -0.5), "cx - mx < -0.5"), ("deep", ("y", "gt", 1.0), "cy - my > 1.0"), ("level", ("z", "lt", 0.3), "abs(cz - mz) < 0.3"), ("floor", ("xy", "lt", 2.0), "sqrt((cx - mx) * (cx - mx) + (cy - my) * (cy - my)) < 2.0"), ("under", ("vertical", "lt", -0.1), "cz - mz < -0.1"), ("beside", ("distance", "lt", 2.25), "sqrt((cx - mx) * (cx - mx) + (cy - my) * (cy - my) + (cz - mz) * (cz - mz)) < 2.25")):

    def _quick(spark: SparkSession, sf_dir: str, name: str = _name, config: tuple = _config) -> DataFrame:
        o = scene(spark, sf_dir, "objects")
        return quick_filter(o.where("category = 'bolt'"), o.where("category = 'anvil'"), name, None if name in ("under", "beside") else {name: config}).select("obj_id")

    query(f"quick_axis_{_name}", _MEAN.format(_cond), "objects")(_quick)


@query("quick_alias", _MEAN.format("cz - mz > 0"), "objects")
def quick_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = scene(spark, sf_dir, "objects")
    return quick_filter(o.where("category = 'bolt'"), o.where("category = 'anvil'"), "atop").select("obj_id")


@query("quick_unknown", "SELECT obj_id FROM objects WHERE category = 'bolt'", "objects")
def quick_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relation without a pre-filter lets all through."""
    o = scene(spark, sf_dir, "objects")
    return quick_filter(o.where("category = 'bolt'"), o.where("category = 'anvil'"), "left_of").select("obj_id")


@query("ground_comparative", "SELECT obj_id FROM objects WHERE category = 'ring'", "objects")
def ground_comparative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Grounding(scene(spark, sf_dir, "objects")).answers(Node("ring", select=Select("comparative", "size", "max", reference=Node("gear")))).select("obj_id")


@query("ground_unknown_relation", f"SELECT obj_id, round(max(greatest(0.0, 1 - sqrt(dx * dx + dy * dy + dz * dz) / 2)), 6) AS score FROM ({_D}) WHERE sqrt(dx * dx + dy * dy + dz * dz) <= 2 GROUP BY obj_id", "objects")
def ground_unknown_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Grounding(scene(spark, sf_dir, "objects"), quick_filters=False).answers(spatial_query("bolt", "hovering about", "anvil")).select("obj_id", _r("score", "score"))


@query("ground_ordinal_beyond", "SELECT obj_id FROM objects WHERE false", "objects")
def ground_ordinal_beyond(spark: SparkSession, sf_dir: str) -> DataFrame:
    """There aren't so many, so there is no answer."""
    return Grounding(scene(spark, sf_dir, "objects")).answers(Node("ring", select=Select("ordinal", "x", "asc", 1_000_000))).select("obj_id")


_WORDS = "CASE event_id % 8 WHEN 0 THEN 'on top of' WHEN 1 THEN ' Under' WHEN 2 THEN 'nearby' WHEN 3 THEN 'adjacent' WHEN 4 THEN 'to the left of' WHEN 5 THEN 'in back of' WHEN 6 THEN 'in between' ELSE 'hanging from' END"


@query("relation_types", f"SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'on' WHEN 1 THEN 'below' WHEN 2 THEN 'near' WHEN 3 THEN 'next_to' WHEN 4 THEN 'left_of' WHEN 5 THEN 'behind' WHEN 6 THEN 'between' END AS relation, CASE event_id % 8 WHEN 0 THEN 'vertical' WHEN 1 THEN 'vertical' WHEN 2 THEN 'distance' WHEN 3 THEN 'distance' END AS filter FROM events")
def relation_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relations that words name, and whether a pre-filter can decide them."""
    relation, kind = K.relations_named(F.expr(_WORDS))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", relation.alias("relation"), kind.alias("filter"))


_ANCHOR = ", a AS (SELECT * FROM objects WHERE category = 'anvil' ORDER BY obj_id LIMIT 1), c AS (SELECT o.obj_id, sqrt((o.cx - a.cx) * (o.cx - a.cx) + (o.cy - a.cy) * (o.cy - a.cy) + (o.cz - a.cz) * (o.cz - a.cz)) AS d FROM objects o, a WHERE o.category = 'bolt') "


@query("around_anchor", _ANCHOR + "SELECT obj_id FROM c WHERE d < 1.5 OR NOT EXISTS (SELECT 1 FROM c WHERE d < 1.5)", "objects")
def around_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = scene(spark, sf_dir, "objects")
    return K.around_anchor(o.where("category = 'bolt'"), o.where("category = 'anvil'"), "beside").select("obj_id")


@query("closest_to_anchor", _ANCHOR + "SELECT obj_id FROM c ORDER BY d, obj_id LIMIT 5", "objects")
def closest_to_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = scene(spark, sf_dir, "objects")
    return K.closest_to_anchor(o.where("category = 'bolt'"), o.where("category = 'anvil'")).select("obj_id")


@query("flat_pipeline", f", {_MEANS}, b AS (SELECT region FROM m ORDER BY {_SIM.replace('feat', 'f')} DESC, region LIMIT 3), c AS (SELECT obj_id, {_SIM} AS sim FROM features WHERE region IN (SELECT region FROM b) ORDER BY {_SIM} DESC, obj_id LIMIT 20), a AS (SELECT * FROM objects WHERE category = 'anvil' ORDER BY obj_id LIMIT 1), d AS (SELECT c.obj_id, sim, sqrt((o.cx - a.cx) * (o.cx - a.cx) + (o.cy - a.cy) * (o.cy - a.cy) + (o.cz - a.cz) * (o.cz - a.cz)) < 2.5 AS ok FROM c JOIN objects o USING (obj_id), a), k AS (SELECT * FROM d WHERE ok OR NOT (SELECT bool_or(ok) FROM d)) SELECT obj_id, CASE WHEN (SELECT count(*) FROM k) = 1 THEN 0.9 ELSE 0.7 END::DOUBLE AS confidence FROM k ORDER BY sim DESC, obj_id LIMIT 1", "features", "objects")
def flat_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, then their objects, then those near an anchor; the best of them with how sure that is."""
    o = scene(spark, sf_dir, "objects")
    found = retrieval.hierarchical_search(scene(spark, sf_dir, "features"), literal(_Q), 3, 20).join(o, "obj_id")
    kept = K.around_anchor(found, o.where("category = 'anvil'"), "near")
    n = kept.agg(F.count(F.lit(1)).alias("n"))
    return kept.crossJoin(F.broadcast(n)).orderBy(F.col("sim").desc(), "obj_id").limit(1).select("obj_id", F.when(F.col("n") == 1, 0.9).otherwise(0.7).alias("confidence"))  # one row


def _covered(wanted: str, k: int) -> str:
    parts = [f", {_VIS}, {wanted}, s AS (SELECT obj_id, view_id, round(score, 6) AS score FROM vis WHERE obj_id IN (SELECT obj_id FROM w)), c0 AS (SELECT DISTINCT obj_id, CAST(0.0 AS DOUBLE) AS covered FROM s)"]
    for n in range(1, k + 1):
        parts.append(f", b{n} AS (SELECT {n} AS round, view_id, sum(greatest(0.0, score - covered)) AS gain FROM s JOIN c{n - 1} USING (obj_id) GROUP BY view_id HAVING sum(greatest(0.0, score - covered)) > 0 ORDER BY round(sum(greatest(0.0, score - covered)), 6) DESC, view_id LIMIT 1)")
        parts.append(f", c{n} AS (SELECT c.obj_id, greatest(covered, coalesce(a.score, 0.0)) AS covered FROM c{n - 1} c LEFT JOIN (SELECT s.obj_id, s.score FROM s JOIN b{n} USING (view_id)) a USING (obj_id))")
    return "".join(parts) + " " + " UNION ALL ".join(f"SELECT round, view_id, round(gain, 6) AS gain FROM b{n}" for n in range(1, k + 1))


_KEY = f"""t AS (SELECT * FROM objects WHERE contains(lower(category), 'bolt') ORDER BY obj_id LIMIT 10), n AS (SELECT * FROM objects WHERE contains(lower(category), 'anvil') ORDER BY obj_id LIMIT 5), f AS (SELECT * FROM n ORDER BY obj_id LIMIT 1),
d AS (SELECT t.obj_id, t.cx - f.cx AS dx, t.cy - f.cy AS dy, t.cz - f.cz AS dz FROM t, f), z AS (SELECT obj_id, CASE WHEN dx < 0 AND abs(dy) <= abs(dx) THEN least(1.0, abs(dx) / 2) END AS score FROM d),
w AS (SELECT obj_id FROM (SELECT obj_id FROM z WHERE score IS NOT NULL OR NOT EXISTS (SELECT 1 FROM z WHERE score IS NOT NULL) ORDER BY round(coalesce(score, 0.0), 9) DESC, obj_id LIMIT 5) UNION SELECT obj_id FROM (SELECT obj_id FROM n ORDER BY obj_id LIMIT 2))"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.visibility(scene(spark, sf_dir, "objects"), scene(spark, sf_dir, "poses")).withColumn("score", F.round("score", 6))


@query("keyframes", _covered(_KEY, 2), "objects", "poses")
def keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views for the bolts left of an anvil."""
    return K.keyframes(scene(spark, sf_dir, "objects"), _scores(spark, sf_dir), "bolt", "anvil", "left of", 2).select("round", "view_id", _r("gain", "gain"))


_KEY2 = f"w AS (SELECT obj_id FROM (SELECT obj_id FROM (SELECT obj_id, max(greatest(0.0, 1 - sqrt(dx * dx + dy * dy + dz * dz))) AS s FROM ({_D}) WHERE sqrt(dx * dx + dy * dy + dz * dz) <= 1 GROUP BY obj_id) ORDER BY obj_id LIMIT 5) UNION SELECT obj_id FROM (SELECT obj_id FROM objects WHERE category = 'anvil' ORDER BY obj_id LIMIT 3))"


@query("keyframes_nested", _covered(_KEY2, 2), "objects", "poses")
def keyframes_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views for the answers of a nested question and its anchors."""
    g = Grounding(scene(spark, sf_dir, "objects"), quick_filters=False)
    wanted = g.answers(spatial_query("bolt", "next to", "anvil")).orderBy("obj_id").limit(5).select("obj_id").unionByName(g.answers(Node("anvil")).orderBy("obj_id").limit(3).select("obj_id")).distinct()
    return views.joint_coverage(_scores(spark, sf_dir).join(F.broadcast(wanted), "obj_id", "left_semi"), 2).select("round", "view_id", _r("gain", "gain"))  # eight objects


_BEST = f", {_VIS}, c AS (SELECT obj_id, row_number() OVER (ORDER BY obj_id) AS rank FROM objects WHERE obj_id IN (3, 8, 21, 40)), b AS (SELECT rank, obj_id, view_id, row_number() OVER (PARTITION BY obj_id ORDER BY round(score, 6) DESC, view_id) AS place FROM vis JOIN c USING (obj_id) QUALIFY place <= 5) "
for _name, _sql in {"best_single": "SELECT view_id FROM b WHERE rank = 1 ORDER BY place LIMIT 1", "close_up": "SELECT view_id FROM b WHERE rank = 1 ORDER BY place LIMIT 3", "same_frame": "SELECT view_id FROM (SELECT view_id, count(DISTINCT obj_id) AS n FROM b GROUP BY view_id ORDER BY n DESC, view_id LIMIT 3)", "multi_angle": "SELECT DISTINCT view_id FROM b WHERE place <= 2 ORDER BY view_id LIMIT 3"}.items():

    def _views(spark: SparkSession, sf_dir: str, strategy: str = _name) -> DataFrame:
        best = K.best_views(_scores(spark, sf_dir), scene(spark, sf_dir, "objects").where("obj_id IN (3, 8, 21, 40)"))
        return K.chosen_views(best, strategy, 3)

    query(f"views_{_name}", _BEST + _sql, "objects", "poses")(_views)

_REPLIES = "CASE event_id % 6 WHEN 0 THEN 'I see {\"count\": 2, \"object_ids\": [' || event_id || ', 7]} there' WHEN 1 THEN '{\"object_id\": ' || event_id || ', \"confidence\": 0.5, \"object_tag\": \"old chair\" }' WHEN 2 THEN '{\"object_id\": ' || event_id || '}' WHEN 3 THEN 'it is #' || event_id WHEN 4 THEN 'ID: ' || event_id ELSE 'no idea' END"


@query("replies", f"SELECT event_id, CASE WHEN event_id % 6 <> 5 THEN event_id END AS picked, CASE event_id % 6 WHEN 0 THEN 0.9 WHEN 1 THEN 0.5 WHEN 2 THEN 0.85 WHEN 3 THEN 0.65 WHEN 4 THEN 0.65 END::DOUBLE AS confidence, CASE WHEN event_id % 6 = 1 THEN 'old chair' END AS tag FROM events")
def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What replies of every form pick, and how sure."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.expr(_REPLIES).alias("reply"))
    return e.select("event_id", K.parsed_reply(F.col("reply")).alias("p"), K.tag_of(F.col("reply")).alias("tag")).select("event_id", "p.picked", "p.confidence", "tag")


@query("reply_mentions", "WITH o AS (SELECT p_partkey % 25 AS k, 'the ' || p_name || ' by the ' || split_part(p_name, ' ', 2) AS text FROM part), w AS (SELECT k, unnest(string_split(text, ' ')) AS word FROM o), c AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS category FROM part) SELECT k, category, count(*) AS n FROM w JOIN c ON c.category = w.word GROUP BY ALL")
def reply_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often replies mention each category."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select((F.col("p_partkey") % 25).alias("k"), F.concat(F.lit("the "), F.col("p_name"), F.lit(" by the "), F.split_part("p_name", F.lit(" "), F.lit(2))).alias("text"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("category"))
    return K.mentions(p, p)


@query("question_words", r"SELECT p_partkey, trim(regexp_replace(lower('The ' || p_name || ' between a ' || p_name), '\b(the|a|an)\b\s*', '', 'g')) AS clean FROM part")
def question_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions without their articles."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", K.without_articles(F.concat(F.lit("The "), F.col("p_name"), F.lit(" between a "), F.col("p_name"))).alias("clean"))


_TYPE = "CASE event_id % 7 WHEN 0 THEN 'Simple_Object' WHEN 1 THEN 'spatial_relation' WHEN 2 THEN 'counting' WHEN 3 THEN 'attribute' WHEN 4 THEN 'functional_region' WHEN 5 THEN 'comparison' ELSE 'riddle' END"


@query("strategies", "SELECT event_id, CASE event_id % 7 WHEN 1 THEN 'joint_coverage' WHEN 2 THEN 'multi_angle' WHEN 3 THEN 'close_up' WHEN 4 THEN 'region_overview' WHEN 5 THEN 'same_frame' ELSE 'best_single' END AS views, CASE event_id % 7 WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 3 THEN 2 WHEN 4 THEN 2 WHEN 5 THEN 2 ELSE 1 END AS max_views, CASE event_id % 7 WHEN 1 THEN 'spatial' WHEN 2 THEN 'counting' WHEN 3 THEN 'attribute' WHEN 4 THEN 'region' WHEN 5 THEN 'comparison' ELSE 'simple' END AS style FROM events")
def strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How views are chosen for each question, by its type."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", K.strategy_of(F.expr(_TYPE)).alias("s")).select("event_id", "s.*")


@query("online_visibility", """, g AS (SELECT obj_id, view_id, max(greatest(0.0, least(1.0, (x2 - x1) * (y2 - y1) / (0.3 * 816000.0)) - 0.3 * CASE WHEN x1 < 10 OR y1 < 10 OR x2 > 1190 OR y2 > 670 THEN 1.0 ELSE 0.0 END)) AS c, count(*) AS n FROM detections WHERE obj_id % 7 <> 0 GROUP BY ALL),
h AS (SELECT obj_id, view_id, sqrt((cx - px) * (cx - px) + (cy - py) * (cy - py) + (cz - pz) * (cz - pz)) AS d, -((cx - px) * fwx + (cy - py) * fwy + (cz - pz) * fwz) AS b FROM objects, poses), e AS (SELECT obj_id, view_id, CASE WHEN d > 5 THEN 0.0 ELSE 0.6 * greatest(0.0, 1 - d / 5) + 0.4 * greatest(0.0, b / (d + 1e-8)) END AS geo, d FROM h)
SELECT obj_id, view_id, round(0.5 * c + 0.3 * geo + 0.2 * least(1.0, n / 3.0), 6) AS score FROM g JOIN e USING (obj_id, view_id) UNION ALL SELECT obj_id, view_id, round(geo, 6) FROM e WHERE obj_id % 7 = 0 AND d <= 5 AND geo > 0.1""", "detections", "objects", "poses")  # fmt: skip
def online_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of views from detections, or from the geometry alone for objects that were never detected."""
    d = scene(spark, sf_dir, "detections").where("obj_id % 7 <> 0")
    v = views.online_visibility(d, scene(spark, sf_dir, "objects").where("obj_id % 7 <> 0"), scene(spark, sf_dir, "poses"))
    alone = views.geometric_visibility(scene(spark, sf_dir, "objects").where("obj_id % 7 = 0"), scene(spark, sf_dir, "poses"))
    return v.unionByName(alone).select("obj_id", "view_id", _r("score", "score"))


# --- metrics and classes -------------------------------------------------------------------------------------------

_IOU = "c AS (SELECT {k}coalesce(g.c, q.c) AS c, coalesce(g, 0) AS g, coalesce(tp, 0) AS tp, coalesce(q, 0) AS q FROM (SELECT {k}gt AS c, count(*) AS g, count(*) FILTER (gt = pred) AS tp FROM p GROUP BY ALL) g FULL JOIN (SELECT {k}pred AS c, count(*) AS q FROM p GROUP BY ALL) q USING ({u}c)), r AS (SELECT *, tp / greatest(1.0, g + q - tp) AS iou FROM c)"
_SUMMARY = "count(*) AS classes, round(avg(iou), 6) AS miou, round(sum(iou * g) / sum(g), 6) AS fmiou, sum((iou > 0.15)::BIGINT)::BIGINT AS acc_15, sum((iou > 0.25)::BIGINT)::BIGINT AS acc_25, sum((iou > 0.5)::BIGINT)::BIGINT AS acc_50, sum((iou > 0.75)::BIGINT)::BIGINT AS acc_75"


@query("segmentation_summary", f"{_PRED}, c AS (SELECT coalesce(g.k, q.k) AS k, coalesce(g, 0) AS g, coalesce(tp, 0) AS tp, coalesce(q, 0) AS q FROM (SELECT gt AS k, count(*) AS g, count(*) FILTER (gt = pred) AS tp FROM p GROUP BY gt) g FULL JOIN (SELECT pred AS k, count(*) AS q FROM p GROUP BY pred) q ON g.k = q.k), r AS (SELECT *, tp / greatest(1.0, g + q - tp) AS iou FROM c) SELECT {_SUMMARY} FROM r", "features")
def segmentation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = retrieval.metrics_summary(retrieval.confusion(_predicted(spark, sf_dir)))
    return s.select("classes", _r("miou", "miou"), _r("fmiou", "fmiou"), "acc_15", "acc_25", "acc_50", "acc_75")


@query("confusion_all_scenes", f", {_MEANS}, s AS (SELECT obj_id, obj_id % 4 AS scene, features.region AS gt, m.region AS pred, list_dot_product(feat, f) / (sqrt(list_dot_product(feat, feat)) * sqrt(list_dot_product(f, f))) AS sim FROM features, m), p AS (SELECT scene, gt, arg_max(pred, sim) AS pred FROM s GROUP BY obj_id, scene, gt) SELECT coalesce(CAST(scene AS VARCHAR), 'all') AS scene, gt, pred, count(*) AS n FROM p GROUP BY GROUPING SETS ((scene, gt, pred), (gt, pred))", "features")
def confusion_all_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The confusion of each scene and of all together."""
    f = scene(spark, sf_dir, "features")
    classes = retrieval.region_features(f).select(F.col("region").alias("class_id"), F.col("feat").alias("cfeat"))
    p = f.join(retrieval.classify(f, classes), "obj_id").select((F.col("obj_id") % 4).cast("string").alias("scene"), F.col("region").alias("gt"), "pred")
    each = p.groupBy("scene", "gt", "pred").agg(F.count(F.lit(1)).alias("n"))
    return each.unionByName(each.groupBy("gt", "pred").agg(F.sum("n").alias("n")).withColumn("scene", F.lit("all")))


@query("classify_without_ignored", f", {_MEANS}, s AS (SELECT obj_id, m.region, CASE WHEN m.region IN (0, 2) THEN -1e10 ELSE list_dot_product(feat, f) / (sqrt(list_dot_product(feat, feat)) * sqrt(list_dot_product(f, f))) END AS sim FROM features, m) SELECT obj_id, region AS pred FROM (SELECT *, row_number() OVER (PARTITION BY obj_id ORDER BY sim DESC, region) AS r FROM s) WHERE r = 1", "features")
def classify_without_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = scene(spark, sf_dir, "features")
    classes = retrieval.region_features(f).select(F.col("region").alias("class_id"), F.col("feat").alias("cfeat"))
    return retrieval.classify(f, classes, (0, 2)).select("obj_id", "pred")


@query("remapped_classes", "SELECT obj_id, region // 2 AS class_id FROM features WHERE region // 2 NOT IN (0) AND region // 2 IN (SELECT DISTINCT region // 2 FROM features WHERE obj_id % 2 = 0)", "features")
def remapped_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes as numbered elsewhere, without excluded ones, and only those that the ground truth has."""
    f = scene(spark, sf_dir, "features").select("obj_id", F.expr("CAST(region DIV 2 AS INT)").alias("class_id"))
    return f.where("class_id NOT IN (0)").join(f.where("obj_id % 2 = 0").select("class_id").distinct(), "class_id", "left_semi").select("obj_id", "class_id")


@query("similarity_softmax", f"SELECT obj_id, round(exp({_SIM}) / sum(exp({_SIM})) OVER (), 9) AS share FROM features", "features")
def similarity_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = scene(spark, sf_dir, "features").select("obj_id", cosine(F.col("feat"), literal(_Q)).alias("sim"))
    return retrieval.softmax(f, "sim").select("obj_id", F.round("share", 9).alias("share"))


@query("region_summary", f", {_MEANS}, n AS (SELECT region, round(list_sum(list_transform(f, lambda x: x / greatest(sqrt(list_dot_product(f, f)), 1e-8))), 6) AS total FROM m), c AS (SELECT region, count(*) AS n, round(avg(cx), 5) AS cx, round(avg(cy), 5) AS cy FROM features JOIN objects USING (obj_id) GROUP BY region) SELECT region, n, cx, cy, total FROM n JOIN c USING (region)", "features", "objects")
def region_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions with their centroid and their mean feature to unit length."""
    f, o = scene(spark, sf_dir, "features"), scene(spark, sf_dir, "objects")
    unit = retrieval.region_features(f).select("region", normalise(F.col("feat")).alias("feat"))
    c = f.join(o, "obj_id").groupBy("region").agg(F.count(F.lit(1)).alias("n"), _r(F.avg("cx"), "cx", 5), _r(F.avg("cy"), "cy", 5))
    return unit.join(c, "region").select("region", "n", "cx", "cy", _r(F.aggregate("feat", F.lit(0.0), lambda a, x: a + x), "total"))


@query("feature_closeness", ", p AS (SELECT a.obj_id, a.feat AS x, b.feat AS y FROM features a JOIN features b ON b.obj_id = a.obj_id + 1), d AS (SELECT obj_id, unnest(x) AS x, unnest(y) AS y FROM p) SELECT obj_id, round(avg(abs(x - y)), 6) AS mad, round(max(abs(x - y)), 6) AS largest, round(avg(abs(x - y) / (abs(y) + 1e-8)), 4) AS mrd FROM d GROUP BY obj_id", "features")
def feature_closeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far features are from the next object's."""
    f = scene(spark, sf_dir, "features")
    j = f.select("obj_id", F.col("feat").alias("x")).join(f.select((F.col("obj_id") - 1).alias("obj_id"), F.col("feat").alias("y")), "obj_id")
    mad, largest, mrd = retrieval.closeness(F.col("x"), F.col("y"))
    return j.select("obj_id", _r(mad, "mad"), _r(largest, "largest"), _r(mrd, "mrd", 4))


@query("class_name_mode", """, c AS (SELECT seq_id, event_type, count(*) AS n, min(frame_id) AS first, event_type IN ('click', 'view') AS stop FROM trajectory GROUP BY ALL) SELECT seq_id, event_type AS name FROM (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY stop, CASE WHEN stop THEN 0 ELSE n END DESC, first) AS r FROM c) WHERE r = 1""", "trajectory")
def class_name_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name said most often, ties to the first said, stop-words only where there is nothing else."""
    return retrieval.mode_name(scene(spark, sf_dir, "trajectory"), "seq_id", "event_type", "frame_id", ("click", "view"))


@query("sliced_objects", "SELECT pos, obj_id, category FROM (SELECT unnest([5, 3, 5, 11]) AS obj_id, unnest([0, 1, 2, 3]) AS pos) JOIN objects USING (obj_id)", "objects")
def sliced_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects by a list of identifiers, in its order and as often as it names them."""
    wanted = spark.range(1).select(F.posexplode(F.array(*[F.lit(i).cast("long") for i in (5, 3, 5, 11)])).alias("pos", "obj_id"))
    return F.broadcast(wanted).join(scene(spark, sf_dir, "objects"), "obj_id").select("pos", "obj_id", "category")  # four rows


@query("masked_objects", "SELECT obj_id, round(feat[4], 6) AS third FROM features WHERE feat[1] > 0", "features")
def masked_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One item of a list column, of the rows that a mask lets through."""
    return scene(spark, sf_dir, "features").where(F.col("feat")[0] > 0).select("obj_id", _r(F.col("feat")[3], "third"))


@query("stacked_boxes", "SELECT obj_id, CAST(k AS INT) AS k, round(cx + (k // 4 - 0.5) * ex, 6) AS x, round(cy + (k // 2 % 2 - 0.5) * ey, 6) AS y, round(cz + (k % 2 - 0.5) * ez, 6) AS z FROM objects, range(8) t(k) WHERE category = 'gear'", "objects")
def stacked_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corners of boxes, of the rows that a mask lets through."""
    o = scene(spark, sf_dir, "objects").where("category = 'gear'")
    box = boxes.corners(tuple(F.col(f"c{a}") for a in "xyz"), tuple(F.col(f"e{a}") for a in "xyz"))
    return o.select("obj_id", F.posexplode(boxes.corner_points(box)).alias("k", "p")).select("obj_id", "k", *(_r(F.col("p")[n], a) for n, a in enumerate("xyz")))


@query("view_lists", "SELECT obj_id, list_reverse(list_sort(list(DISTINCT view_id)))[1:3] AS last, list_contains(list(view_id), 7) AS in_7, len(list_append(list(DISTINCT view_id), -1)) AS n FROM detections GROUP BY obj_id", "detections")
def view_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each object's views as a list: its last three in reverse, whether it has one, and its length with one more at the end."""
    d = scene(spark, sf_dir, "detections").groupBy("obj_id").agg(F.array_sort(F.collect_set("view_id")).alias("views"))
    return d.select("obj_id", F.slice(F.reverse("views"), 1, 3).alias("last"), F.array_contains("views", F.lit(7)).alias("in_7"), F.size(F.array_append("views", F.lit(-1).cast("long"))).cast("long").alias("n"))


@query("explicit_regions", ", m AS (SELECT obj_id, min(region) AS region FROM (SELECT obj_id, region FROM features UNION ALL SELECT obj_id, obj_id % 7 FROM features WHERE obj_id % 10 = 0) GROUP BY obj_id), d AS (SELECT region, k, avg(v) AS v, count(*) AS n FROM (SELECT region, unnest(feat) AS v, generate_subscripts(feat, 1) AS k FROM m JOIN features f USING (obj_id, region)  UNION ALL SELECT m.region, unnest(feat), generate_subscripts(feat, 1) FROM m JOIN features f ON f.obj_id = m.obj_id AND f.region <> m.region) GROUP BY region, k), r AS (SELECT region, max(n) AS n, sum(v) / sqrt(sum(v * v)) AS total FROM d GROUP BY region) SELECT obj_id, m.region::INTEGER AS region, n, round(total, 6) AS total FROM m JOIN r USING (region)", "features")
def explicit_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each object's region, by regions that are given as lists, with the region's size and vector."""
    f = scene(spark, sf_dir, "features")
    given = f.select("region", "obj_id").unionByName(f.where("obj_id % 10 = 0").select((F.col("obj_id") % 7).cast("int").alias("region"), "obj_id"))
    own, regions = retrieval.explicit_regions(given.groupBy("region").agg(F.collect_list("obj_id").alias("obj_ids")), f)
    return own.join(regions, "region").select("obj_id", "region", "n", _r(F.aggregate("feat", F.lit(0.0), lambda a, x: a + x), "total"))


@query("seen_objects", "SELECT DISTINCT obj_id FROM detections WHERE view_id = 7 INTERSECT SELECT obj_id FROM detections WHERE view_id = 8", "detections")
def seen_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that two views have in common."""
    d = scene(spark, sf_dir, "detections")
    return d.where("view_id = 7").select("obj_id").intersect(d.where("view_id = 8").select("obj_id"))


@query("united_views", "SELECT DISTINCT view_id FROM detections WHERE obj_id IN (3, 9) UNION SELECT view_id FROM detections WHERE obj_id = 15", "detections")
def united_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scene(spark, sf_dir, "detections")
    return d.where("obj_id IN (3, 9)").select("view_id").unionByName(d.where("obj_id = 15").select("view_id")).distinct()


@query("view_frequency", "SELECT obj_id, view_id, n FROM (SELECT obj_id, view_id, count(*) AS n, row_number() OVER (PARTITION BY obj_id ORDER BY count(*) DESC, min(seq_major * 10 + seq_minor), view_id) AS r FROM detections GROUP BY obj_id, view_id) WHERE r <= 3", "detections")
def view_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three views in which each object is found most often."""
    c = scene(spark, sf_dir, "detections").groupBy("obj_id", "view_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("seq_major") * 10 + F.col("seq_minor")).alias("first"))
    return c.withColumn("r", F.row_number().over(Window.partitionBy("obj_id").orderBy(F.col("n").desc(), "first", "view_id"))).where("r <= 3").select("obj_id", "view_id", "n")


@query("mapping_counts", "SELECT count(*) AS pairs, count(DISTINCT obj_id) AS objects, count(DISTINCT view_id) AS views FROM (SELECT DISTINCT obj_id, view_id FROM detections)", "detections")
def mapping_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scene(spark, sf_dir, "detections").select("obj_id", "view_id").distinct().agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("obj_id").alias("objects"), F.countDistinct("view_id").alias("views"))


_DIMS = 67
_NEXT = ", ".join(f"avg(f[{k}]) FILTER (r = 1)" for k in range(1, _DIMS + 1))
_AWAY = "round(list_sum(list_transform(list_zip(f, x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9)"


@query(
    "kmeans_regions",
    f"""RECURSIVE, o AS (SELECT obj_id, cx, cy, cz, feat FROM objects JOIN features USING (obj_id)),
b AS (SELECT min(cx) AS x0, max(cx) AS x1, min(cy) AS y0, max(cy) AS y1, min(cz) AS z0, max(cz) AS z1, greatest(2, least(10, floor(sqrt(count(*)))))::BIGINT AS k FROM o),
p AS MATERIALIZED (SELECT obj_id, list_concat([(cx - x0) / (x1 - x0 + 1e-8), (cy - y0) / (y1 - y0 + 1e-8), (cz - z0) / (z1 - z0 + 1e-8)], list_transform(feat, lambda v: v / greatest(sqrt(list_dot_product(feat, feat)), 1e-8) * 0.3)) AS f FROM o, b),
centres AS (
    SELECT 0 AS round, s AS start, c, x FROM (SELECT s, f AS x, row_number() OVER (PARTITION BY s ORDER BY md5('42:' || s || ':' || obj_id)) - 1 AS c FROM p, range(10) t(s)), b WHERE c < k
    UNION ALL
    SELECT round + 1, start, c, CASE WHEN count(*) FILTER (r = 1) = 0 THEN any_value(x) ELSE [{_NEXT}] END
    FROM (SELECT round, start, c, x, f, row_number() OVER (PARTITION BY start, obj_id ORDER BY {_AWAY}, c) AS r FROM centres, p WHERE round < 30) GROUP BY round, start, c),
near AS (SELECT start, obj_id, c, {_AWAY} AS d FROM centres, p WHERE round = 30 QUALIFY row_number() OVER (PARTITION BY start, obj_id ORDER BY {_AWAY}, c) = 1),
best AS (SELECT start FROM near GROUP BY start ORDER BY round(sum(d), 6), start LIMIT 1)
SELECT obj_id, (dense_rank() OVER (ORDER BY c) - 1)::INTEGER AS region FROM near JOIN best USING (start)""",
    "objects", "features",
)
def kmeans_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of objects by place and feature: the best of ten runs of k-means."""
    o = scene(spark, sf_dir, "objects").join(scene(spark, sf_dir, "features"), "obj_id")
    return retrieval.kmeans_regions(o)
