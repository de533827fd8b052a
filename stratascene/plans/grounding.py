"""Nested spatial questions as data, compiled to one DataFrame plan.

A ``Node`` asks for objects of a category; constraints relate them to the answers of other nodes, a select picks by rank. A node that
is asked for more than once is computed once and written.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.relations import Thresholds, between, canonical, nearest_join, norm, relation_join, thresholds_of
from ..functions.vectors import cosine, literal
from ..storage import cut

# Words that count as a colour.
COLOURS = {
    "red": ("red", "crimson", "scarlet", "maroon", "ruby"),
    "blue": ("blue", "navy", "azure", "cobalt", "cyan", "teal"),
    "green": ("green", "olive", "lime", "emerald", "forest"),
    "yellow": ("yellow", "gold", "golden", "amber"),
    "orange": ("orange", "tangerine", "coral"),
    "purple": ("purple", "violet", "lavender", "magenta", "plum"),
    "pink": ("pink", "rose", "salmon", "fuchsia"),
    "brown": ("brown", "chocolate", "tan", "beige", "khaki", "coffee"),
    "black": ("black", "dark", "ebony", "charcoal"),
    "white": ("white", "ivory", "cream", "pearl"),
    "gray": ("gray", "grey", "silver", "slate"),
}
_FAMILY = {word: family for family, words in COLOURS.items() for word in words}
# Plain colour words, each of which stands for itself.
COLOUR_WORDS = ("red", "blue", "green", "yellow", "orange", "purple", "pink", "black", "white", "gray", "grey", "brown", "beige", "tan", "gold", "silver", "bronze", "copper")
# Words that ask for an extreme size.
SIZE_WORDS = {"large": "max", "big": "max", "biggest": "max", "largest": "max", "huge": "max", "small": "min", "little": "min", "smallest": "min", "tiny": "min"}
# Names that objects of a category also go by.
SYNONYMS = {
    "pillow": ("throw_pillow", "cushion"), "couch": ("sofa",), "sofa": ("couch",), "lamp": ("table_lamp", "floor_lamp"), "table": ("side_table", "coffee_table", "dining_table"),
    "chair": ("armchair", "dining_chair"), "tv": ("television",), "television": ("tv",),
}
# Other names of pre-filters.
QUICK_ALIASES = {"on": "on_top_of", "upon": "on_top_of", "atop": "on_top_of", "over": "above", "beneath": "below", "underneath": "below", "nearby": "near", "adjacent": "next_to", "adjacent_to": "next_to"}
# Pre-filters against the mean anchor: kind, comparison, threshold with its loose factor.
QUICK = {
    "on_top_of": ("vertical", "gt", 0.0), "above": ("vertical", "gt", 0.1), "below": ("vertical", "lt", -0.1), "under": ("vertical", "lt", -0.1), "higher_than": ("vertical", "gt", 0.05), "lower_than": ("vertical", "lt", -0.05),
    "near": ("distance", "lt", 4.5), "next_to": ("distance", "lt", 2.25), "beside": ("distance", "lt", 2.25), "close_to": ("distance", "lt", 3.0), "far_from": ("distance", "gt", 2.1),
}


@dataclass(frozen=True)
class Select:
    kind: str  # superlative or ordinal
    metric: str  # size, height, x, y, distance
    order: str = "max"  # min, max, asc, desc
    position: int | None = None
    reference: Node | None = None

    def __post_init__(self) -> None:
        if self.kind == "ordinal" and self.position is None:
            raise ValueError("an ordinal needs a position")


@dataclass(frozen=True)
class Node:
    category: str
    attributes: tuple[str, ...] = ()
    constraints: tuple[tuple[str, tuple[Node, ...]], ...] = ()
    select: Select | None = None


def spatial_query(target: str, relation: str, anchor: str, attributes: tuple[str, ...] = ()) -> Node:
    return Node(target, attributes, ((relation, (Node(anchor),)),))


def superlative_query(target: str, metric: str, order: str) -> Node:
    return Node(target, select=Select("superlative", metric, order))


def _named(objects: DataFrame) -> F.Column:
    """An object's tag, or its category where it has none, in lower case."""
    category = F.lower("category")
    return F.coalesce(F.nullif(F.lower(F.trim("object_tag")), F.lit("")), category) if "object_tag" in objects.columns else category


def category_scan(objects: DataFrame, category: str, synonyms: dict[str, tuple[str, ...]] | None = None, features: DataFrame | None = None, query: F.Column | None = None, k: int = 10, least: float = 0.2) -> DataFrame:
    """Objects of the first stage that finds any: the same name, a part of the name either way round, a synonym, the look.

    The look is asked for last, if there are ``features`` and the ``query`` vector of the words: the ``k`` objects most like it, if above ``least``.
    """
    q, name = category.strip().lower(), _named(objects)
    others = [s.lower() for s in (SYNONYMS if synonyms is None else synonyms).get(q, ())]
    stage = F.when(name == q, 1).when(name.contains(q) | F.lit(q).contains(name), 2)
    if others:
        stage = stage.when(name.isin(others), 3)
    staged = objects.withColumn("__stage", stage).where("__stage IS NOT NULL")
    if features is not None and query is not None:
        look = features.where("feat IS NOT NULL").join(objects.select("obj_id"), "obj_id", "left_semi").select("obj_id", cosine(F.col("feat"), query).alias("__sim"))
        look = look.orderBy(F.col("__sim").desc(), "obj_id").limit(k).where(F.col("__sim") > least).select("obj_id")
        staged = staged.unionByName(objects.join(F.broadcast(look), "obj_id", "left_semi").withColumn("__stage", F.lit(4)))  # k rows
    first = staged.agg(F.min("__stage").alias("__first"))
    return staged.join(F.broadcast(first), F.col("__stage") == F.col("__first")).drop("__stage", "__first")  # one row


def fallback_if_empty(rows: DataFrame, passes: F.Column) -> DataFrame:
    """The rows that pass; all of them if none does. The count is one row and is joined, not fetched."""
    marked = rows.withColumn("__pass", F.coalesce(passes, F.lit(False)))
    any_ = marked.agg(F.coalesce(F.max("__pass"), F.lit(False)).alias("__any"))
    return marked.join(F.broadcast(any_), F.col("__pass") | ~F.col("__any")).drop("__pass", "__any")


def colour_filter(objects: DataFrame, colour: str) -> DataFrame:
    text = F.lower(F.concat_ws(" ", "attr", "category"))
    hit = None
    for word in COLOURS.get(_FAMILY.get(colour.lower(), colour.lower()), (colour.lower(),)):
        hit = text.contains(word) if hit is None else hit | text.contains(word)
    return fallback_if_empty(objects, hit)


def size_rank(objects: DataFrame, order: str, k: int = 1) -> DataFrame:
    """The ``k`` largest (``max``) or smallest objects by volume, else by ``n_points``, else 1; ties by identifier."""
    points = F.col("n_points").cast("double") if "n_points" in objects.columns else F.lit(None).cast("double")
    size = F.coalesce(F.col("ex") * F.col("ey") * F.col("ez"), points, F.lit(1.0))
    return objects.orderBy(size.desc() if order == "max" else size.asc(), "obj_id").limit(k)


def attribute_filter(objects: DataFrame, word: str) -> DataFrame:
    """Objects with one attribute: a plain colour word in their text (all if none has it), a size word's extreme, or unchanged."""
    w = word.strip().lower()
    if w in COLOUR_WORDS:
        return fallback_if_empty(objects, F.lower(F.concat_ws(" ", "attr", "category")).contains(w))
    return size_rank(objects, SIZE_WORDS[w]) if w in SIZE_WORDS else objects


def quick_name(relation: str) -> str:
    name = relation.strip().lower().replace(" ", "_")
    return QUICK_ALIASES.get(name, name)


def quick_filter(candidates: DataFrame, anchors: DataFrame, relation: str, configs: dict[str, tuple[str, str, float]] | None = None) -> DataFrame:
    """Candidates that fit a relation to the mean anchor; all of them if none does or the relation has no such filter.

    ``configs`` adds or replaces filters: kinds are vertical, x, y (horizontal), distance, and xy or z for distances of these axes alone.
    """
    table = QUICK | (configs or {})
    kind, op, threshold = table.get(quick_name(relation)) or table.get(canonical(relation) or "", (None, None, None))
    if kind is None:
        return candidates
    mean = anchors.agg(F.avg("cx").alias("__mx"), F.avg("cy").alias("__my"), F.avg("cz").alias("__mz"))
    joined = candidates.crossJoin(F.broadcast(mean))  # one row
    dx, dy, dz = (F.col(f"c{a}") - F.col(f"__m{a}") for a in "xyz")
    value = {"vertical": dz, "x": dx, "y": dy, "xy": norm(dx, dy), "z": F.abs(dz)}.get(kind)
    value = norm(dx, dy, dz) if value is None else value
    return fallback_if_empty(joined, value > threshold if op == "gt" else value < threshold).drop("__mx", "__my", "__mz")


def _metric(name: str) -> F.Column | None:
    return {"size": F.col("ex") * F.col("ey") * F.col("ez"), "height": F.col("cz"), "x": F.col("cx"), "y": F.col("cy")}.get(name)


class Grounding:
    """Answers of nodes over one table of objects (``obj_id, category, attr, cx..cz, ex..ez``, and ``object_tag`` if there is one), with a ``score``.

    ``synonyms`` replace the table of names; ``features`` and ``encoder``, which makes a vector of words, find categories by their look; an encoder that fails finds
    nothing. ``thresholds`` replace those of relations.
    """

    def __init__(self, objects: DataFrame, quick_filters: bool = True, synonyms: dict[str, tuple[str, ...]] | None = None, features: DataFrame | None = None, encoder: Callable[[str], list[float] | None] | None = None, thresholds: Thresholds | None = None) -> None:
        self.objects, self.quick, self.synonyms = objects, quick_filters, synonyms
        self.features, self.encoder, self.thresholds = features, encoder, thresholds
        self.done: dict[Node, DataFrame] = {}
        self.asked: Counter[Node] = Counter()

    def _count(self, node: Node) -> None:
        self.asked[node] += 1
        if self.asked[node] == 1:
            for _, anchors in node.constraints:
                for a in anchors:
                    self._count(a)
            if node.select and node.select.reference is not None:
                self._count(node.select.reference)

    def _look(self, words: str) -> F.Column | None:
        try:
            vector = self.encoder(words) if self.encoder and self.features is not None else None
        except Exception:  # whatever an encoder raises: its words find nothing by their look
            vector = None
        return None if vector is None else literal([float(v) for v in vector])

    def answers(self, node: Node) -> DataFrame:
        """The answers of a node, and of those that it asks for."""
        if node not in self.done:
            self._count(node)
        return self._answers(node)

    def _answers(self, node: Node) -> DataFrame:
        if node not in self.done:
            rows = category_scan(self.objects, node.category, self.synonyms, self.features, self._look(node.category))
            for word in node.attributes:
                if word.lower() in _FAMILY:
                    rows = colour_filter(rows, word)
            rows = rows.withColumn("score", F.lit(1.0))
            for name, anchors in node.constraints:
                rows = self._constrain(rows, name, anchors)
            if node.select:
                rows = self._select(rows, node.select)
            self.done[node] = cut(rows, "node") if self.asked[node] > 1 else rows
        return self.done[node]

    def _constrain(self, rows: DataFrame, name: str, anchors: tuple[Node, ...]) -> DataFrame:
        found = [self._answers(a).select("obj_id", "cx", "cy", "cz", "ex", "ey", "ez") for a in anchors]
        every = found[0]
        for f in found[1:]:
            every = every.unionByName(f)
        kept = quick_filter(rows, every, name) if self.quick else rows
        if canonical(name) == "between" and len(found) > 1:
            firsts = [f.orderBy("obj_id").limit(1).select(*[F.col(c).alias(f"__{c}{k}") for c in ("cx", "cy", "cz")]) for k, f in enumerate(found[:2])]
            joined = kept
            for f in firsts:
                joined = joined.crossJoin(F.broadcast(f))  # one row each
            ok, best = between(tuple(F.col(c) for c in ("cx", "cy", "cz")), tuple(F.col(f"__{c}0") for c in ("cx", "cy", "cz")), tuple(F.col(f"__{c}1") for c in ("cx", "cy", "cz")), thresholds_of("between", self.thresholds)["max_distance_ratio"])
            scored = joined.where(ok).select("obj_id", best.alias("__s"))
        else:
            scored = relation_join(kept.select("obj_id", "cx", "cy", "cz"), every, name, thresholds=self.thresholds).withColumnRenamed("score", "__s")
        # without any anchor the constraint says nothing
        none = every.agg((F.count(F.lit(1)) == 0).alias("__none"))
        out = rows.join(scored, "obj_id", "left").crossJoin(F.broadcast(none)).where("__s IS NOT NULL OR __none")
        return out.withColumn("score", F.col("score") * F.coalesce("__s", F.lit(1.0))).drop("__s", "__none")

    def _select(self, rows: DataFrame, select: Select) -> DataFrame:
        metric = _metric(select.metric)
        if select.metric == "distance" and select.reference is not None:
            refs = self._answers(select.reference).select(F.col("obj_id").alias("ref_id"), "cx", "cy", "cz")
            near = nearest_join(rows.select("obj_id", "cx", "cy", "cz"), refs, "obj_id", "ref_id", ("cx", "cy", "cz"), ("cx", "cy", "cz")).select("obj_id", F.col("distance").alias("__m"))
            rows, metric = rows.join(near, "obj_id"), F.col("__m")
        if select.kind == "comparative":  # its reference is evaluated and changes nothing
            return rows
        metric = F.col("score") if metric is None else metric
        if select.kind == "superlative":
            order = metric.asc() if select.order == "min" else metric.desc()
            out = rows.orderBy(order, "obj_id").limit(1)
        else:
            # rows up to the position are found by a top-k, which merges sorted heads; the last of them is the answer if it is there
            order = metric.desc() if select.order == "desc" else metric.asc()
            top = rows.orderBy(order, "obj_id").limit(select.position)
            out = top.withColumn("__n", F.row_number().over(Window.orderBy(order, "obj_id"))).where(F.col("__n") == select.position).drop("__n")
        return out.withColumn("score", F.lit(1.0)).drop("__m")

    def best(self, node: Node) -> DataFrame:
        """The one object with the best score."""
        return self.answers(node).orderBy(F.round("score", 9).desc(), "obj_id").limit(1)
