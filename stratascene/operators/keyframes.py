"""From a question to camera views: finding objects by words, filters around an anchor, view strategies, reply parsing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.relations import broadcast_blocks, norm, relation_join
from ..functions.trees import numbered
from .retrieval import vector_top_k
from .views import joint_coverage, top_per

#: For each type of question how views are chosen, how many, and the style of the prompt.
STRATEGIES = {
    "simple_object": ("best_single", 1, "simple"),
    "spatial_relation": ("joint_coverage", 3, "spatial"),
    "counting": ("multi_angle", 4, "counting"),
    "attribute": ("close_up", 2, "attribute"),
    "functional_region": ("region_overview", 2, "region"),
    "comparison": ("same_frame", 2, "comparison"),
}
#: Other names of the relations that pre-filters know.
RELATION_NAMES = {
    "on_top_of": "on", "upon": "on", "atop": "on", "resting_on": "on",
    "over": "above", "higher_than": "above",
    "under": "below", "beneath": "below", "underneath": "below", "lower_than": "below",
    "left": "left_of", "to_the_left_of": "left_of",
    "right": "right_of", "to_the_right_of": "right_of",
    "front": "in_front_of", "facing": "in_front_of",
    "back": "behind", "back_of": "behind", "in_back_of": "behind",
    "close_to": "near", "nearby": "near",
    "adjacent_to": "next_to", "adjacent": "next_to",
    "in": "inside", "within": "inside", "contained_in": "inside",
    "in_between": "between",
}
RELATIONS = ("on", "above", "below", "left_of", "right_of", "in_front_of", "behind", "near", "next_to", "beside", "inside", "between")
_FILTERS = {"on": "vertical", "above": "vertical", "below": "vertical", "near": "distance", "next_to": "distance", "beside": "distance"}


def relation_name(words: str) -> str | None:
    """The relation that words name, or None."""
    w = words.strip().lower().replace(" ", "_")
    return w if w in RELATIONS else RELATION_NAMES.get(w)


def filter_type(relation: str | None) -> str | None:
    """Vertical or distance for relations that a pre-filter can decide, which don't depend on the view."""
    return _FILTERS.get(relation or "")


def _looked_up(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def relations_named(words: Column) -> tuple[Column, Column]:
    """The relation that words in a column name, and its kind of pre-filter; null where there is none."""
    w = F.replace(F.lower(F.trim(words)), F.lit(" "), F.lit("_"))
    relation = _looked_up({r: r for r in RELATIONS} | RELATION_NAMES, w)
    return relation, _looked_up(_FILTERS, relation)


def strategy_of(kind: Column) -> Column:
    """``views, max_views, style`` for a type of question in a column; an unknown one counts as that of one object."""
    parts = []
    for k, name in enumerate(("views", "max_views", "style")):
        found = _looked_up({t: str(s[k]) for t, s in STRATEGIES.items()}, F.lower(F.trim(kind)))
        parts.append(F.coalesce(found, F.lit(str(STRATEGIES["simple_object"][k]))).cast("int" if k == 1 else "string").alias(name))
    return F.struct(*parts)


def mentions(texts: DataFrame, names: DataFrame, key: str = "k", text: str = "text", name: str = "category") -> DataFrame:
    """``key, name, n``: at how many places texts have a name's words, whole and one after another, in any case.

    Words meet names by an equi-join on a name's first word. The different names are counted and broadcast in blocks, never the texts, which Spark
    takes to be as small as the table that they are made from.
    """
    split = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"\w+"), F.lit(0))
    said = texts.select(key, split(F.col(text)).alias("__words")).select(key, "__words", F.posexplode("__words").alias("__at", "__first"))
    known = names.select(name).distinct().withColumn("__parts", split(F.col(name))).where(F.size("__parts") > 0).withColumn("__first", F.col("__parts")[0])
    whole = reduce(DataFrame.unionByName, [said.join(block, "__first").where(F.slice("__words", F.col("__at") + 1, F.size("__parts")) == F.col("__parts")) for block in broadcast_blocks(known, name)])
    return whole.groupBy(key, name).agg(F.count(F.lit(1)).alias("n"))


def find_objects(objects: DataFrame, term: str, k: int, features: DataFrame | None = None, vector: Column | None = None, least: float = 0.2) -> DataFrame:
    """``obj_id`` of ``k`` objects whose category is in the term or has it in it; if none is, those closest to a vector above ``least``."""
    t, name = term.strip().lower(), F.lower("category")
    hits = objects.where(name.contains(t) | F.lit(t).contains(name)).orderBy("obj_id").limit(k).select("obj_id")
    if features is None or vector is None:
        return hits
    none = hits.agg((F.count(F.lit(1)) == 0).alias("none"))
    near = vector_top_k(features, vector, k).where(F.col("sim") > least).select("obj_id")
    return hits.unionByName(near.crossJoin(F.broadcast(none)).where("none").select("obj_id"))  # one row


def around_anchor(candidates: DataFrame, anchor: DataFrame, relation: str) -> DataFrame:
    """Candidates closer to one anchor than the relation's radius; all of them if none is. Without an anchor all stay."""
    said = relation.lower()
    radius = 1.5 if "beside" in said else 2.5 if "near" in said else 2.0
    one = anchor.orderBy("obj_id").limit(1).select(*(F.col(f"c{a}").alias(f"__a{a}") for a in "xyz"))
    j = candidates.join(F.broadcast(one), how="left").withColumn("__near", F.coalesce(norm(*(F.col(f"c{a}") - F.col(f"__a{a}") for a in "xyz")) < radius, F.lit(False)))  # one row
    any_ = j.agg(F.max("__near").alias("__any"))
    return j.crossJoin(F.broadcast(any_)).where(F.col("__near") | ~F.col("__any")).select(*candidates.columns)


def closest_to_anchor(candidates: DataFrame, anchor: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` candidates closest to one anchor; those without a place come last."""
    one = anchor.orderBy("obj_id").limit(1).select(*(F.col(f"c{a}").alias(f"__a{a}") for a in "xyz"))
    d = norm(*(F.col(f"c{a}") - F.col(f"__a{a}") for a in "xyz"))
    return candidates.crossJoin(F.broadcast(one)).orderBy(d.asc_nulls_last(), "obj_id").limit(k).select(*candidates.columns)  # one row


def keyframes(objects: DataFrame, scores: DataFrame, target: str, anchor: str | None, relation: str | None, k: int) -> DataFrame:
    """``round, view_id, gain``: views that cover the first 5 targets and 2 anchors together.

    Targets are 10 objects by their words, those that relate to the first of 5 anchors first by score; all of them if none does.
    """
    targets = objects.join(find_objects(objects, target, 10), "obj_id")
    wanted = targets.orderBy("obj_id").limit(5).select("obj_id")
    if anchor and relation:
        anchors = objects.join(find_objects(objects, anchor, 5), "obj_id")
        first = anchors.orderBy("obj_id").limit(1)
        related = relation_join(targets, first, relation)
        ranked = targets.join(related, "obj_id", "left").crossJoin(F.broadcast(related.agg((F.count(F.lit(1)) > 0).alias("any")))).where("score IS NOT NULL OR NOT any")  # one row
        wanted = ranked.orderBy(F.round(F.coalesce("score", F.lit(0.0)), 9).desc(), "obj_id").limit(5).select("obj_id").unionByName(anchors.orderBy("obj_id").limit(2).select("obj_id")).distinct()
    return joint_coverage(scores.join(F.broadcast(wanted), "obj_id", "left_semi"), k)


def chosen_views(best: DataFrame, strategy: str, k: int) -> DataFrame:
    """``view_id`` by a strategy from candidates' best views (``rank`` of the candidate, ``obj_id, view_id, place``).

    best_single: the first candidate's best view; close_up: its ``k`` best; same_frame: views of most candidates; multi_angle and the
    others: the two best of each candidate, lowest first.
    """
    if strategy == "best_single":
        return best.where("rank = 1").orderBy("place").limit(1).select("view_id")
    if strategy == "close_up":
        return best.where("rank = 1").orderBy("place").limit(k).select("view_id")
    if strategy == "same_frame":
        return best.groupBy("view_id").agg(F.countDistinct("obj_id").alias("n")).orderBy(F.col("n").desc(), "view_id").limit(k).select("view_id")
    return best.where("place <= 2").select("view_id").distinct().orderBy("view_id").limit(k)


def best_views(scores: DataFrame, objects: DataFrame, k: int = 5) -> DataFrame:
    """``rank, obj_id, view_id, place``: the ``k`` best views of each object, objects ranked by identifier."""
    ranked = numbered(objects.select("obj_id"), "obj_id").select("obj_id", (F.col("number") + 1).alias("rank"))
    best = top_per(scores.join(ranked.select("obj_id"), "obj_id"), "obj_id", k, "view_id").select(F.col("rank").alias("place"), "obj_id", "view_id")
    return best.join(ranked, "obj_id").select("rank", "obj_id", "view_id", "place")


def parsed_reply(text: Column) -> Column:
    """``picked, confidence`` of a reply: its JSON's first counted object (0.9) or ``object_id`` (its own confidence or 0.85), else a number after #, ID or object_id (0.65)."""
    json = F.regexp_extract(text, r"(?s)(\{[^{}]+\})", 1)
    counted = F.when(F.get_json_object(json, "$.count").isNotNull(), F.get_json_object(json, "$.object_ids[0]").try_cast("long"))
    picked = F.get_json_object(json, "$.object_id").try_cast("long")
    number = None
    for pattern in (r"#(\d+)", r"(?i)ID\s*[:=]?\s*(\d+)", r'(?i)object_id["\s:]+(\d+)'):
        found = F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("long")
        number = found if number is None else F.coalesce(number, found)
    answer = lambda i, c: F.struct(i.alias("picked"), c.alias("confidence"))
    own = F.coalesce(F.get_json_object(json, "$.confidence").try_cast("double"), F.lit(0.85))
    return F.when(counted.isNotNull(), answer(counted, F.lit(0.9))).when(picked.isNotNull(), answer(picked, own)).when(number.isNotNull(), answer(number, F.lit(0.65)))


def tag_of(text: Column) -> Column:
    """The words after ``"object_tag":`` up to a comma or brace, without quotes."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_extract(text, r'"object_tag":\s*([^,}]*)', 1), '"', "")), F.lit(""))


def without_articles(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\b(the|a|an)\b\s*", ""))
