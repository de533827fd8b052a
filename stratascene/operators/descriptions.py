"""Object descriptions in words, put together from columns."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.relations import nearest_join, norm
from ..storage import cut as _cut

#: What furniture is for, by a part of the category; the first that fits counts.
FUNCTIONS = {
    "chair": "A seating furniture for one person",
    "table": "A surface for placing items or eating",
    "sofa": "A comfortable seating for relaxing or conversation",
    "lamp": "Provides lighting for the area",
    "bed": "A sleeping surface",
    "cabinet": "Storage furniture with doors or drawers",
    "desk": "A work surface for reading or writing",
    "shelf": "Storage for displaying or organizing items",
    "tv": "A display screen for entertainment",
    "plant": "Decorative greenery",
    "window": "Allows natural light and ventilation",
    "door": "An entrance or exit point",
    "pillow": "A cushion for comfort or decoration",
    "blanket": "A textile for warmth or decoration",
}
#: Zones of a home, by parts of categories that are near; the first that fits counts.
ZONES = {
    "living_area": ("sofa", "tv", "coffee table", "armchair"),
    "dining_area": ("dining table", "chair"),
    "bedroom": ("bed", "nightstand", "wardrobe"),
    "kitchen": ("stove", "refrigerator", "sink", "cabinet"),
    "office": ("desk", "office chair", "computer"),
}
NEAREST, AROUND = 2.0, 3.0


def function_of(category: Column, functions: dict[str, str] | None = None) -> Column:
    out = None
    for part, said in (functions or FUNCTIONS).items():
        hit = F.lower(category).contains(part)
        out = F.when(hit, said) if out is None else out.when(hit, said)
    return out.otherwise(F.concat(F.lit("A "), category, F.lit(" for indoor use")))


def _zone(names: Column, zones: dict[str, tuple[str, ...]]) -> Column:
    out = None
    for zone, parts in zones.items():
        hit = F.exists(names, lambda n: F.lower(n).rlike("|".join(parts)))  # noqa: B023
        said = "Part of the " + zone.replace("_", " ")
        out = F.when(hit, said) if out is None else out.when(hit, said)
    return out.otherwise(F.concat(F.lit("Near "), F.array_join(F.slice(names, 1, 3), ", ")))


def names_around(objects: DataFrame, reach: float) -> DataFrame:
    """``obj_id, names``: the categories of other objects nearer than ``reach``, in alphabetical order; no row for an object without any.

    Objects are dealt to cells a quarter of the reach wide. A category of which cells that are wholly within reach have two objects is near all objects of a cell; only
    for the others that cells within reach have are objects held against each other, so that few pairs are formed however dense objects are.
    """
    steps = list(itertools.product(range(-4, 5), repeat=3))
    sure = [d for d in steps if sum((abs(k) + 1) ** 2 for k in d) < 16]
    may = [d for d in steps if sum(max(abs(k) - 1, 0) ** 2 for k in d) <= 16]
    at = _cut(objects.select("obj_id", "category", "cx", "cy", "cz", *(F.floor(F.col(f"c{a}") / (reach / 4)).cast("long").alias(f"g{a}") for a in "xyz")))
    cells = _cut(at.groupBy("gx", "gy", "gz", "category").agg(F.min("obj_id").alias("low"), F.max("obj_id").alias("high")))

    def spread(rows: DataFrame, by: list[tuple[int, ...]]) -> DataFrame:
        rows = rows.withColumn("__s", F.explode(F.array(*[F.array(*map(F.lit, d)) for d in by])))
        return rows.withColumns({f"h{a}": F.col(f"g{a}") + F.col("__s")[k] for k, a in enumerate("xyz")}).drop("__s")

    here = cells.select(*(F.col(f"g{a}").alias(f"h{a}") for a in "xyz")).distinct()
    whole = spread(cells, sure).groupBy("hx", "hy", "hz", "category").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").drop("low", "high")
    whole = _cut(whole.join(here, ["hx", "hy", "hz"], "left_semi"))
    open_ = spread(cells.drop("low", "high"), may).join(here, ["hx", "hy", "hz"], "left_semi").join(whole, ["hx", "hy", "hz", "category"], "left_anti")
    first = at.select("obj_id", *(F.col(f"c{a}").alias(f"a{a}") for a in "xyz"), *(F.col(f"g{a}").alias(f"h{a}") for a in "xyz"))
    apart = norm(*(F.col(f"a{a}") - F.col(f"c{a}") for a in "xyz"))
    pairs = first.join(open_, ["hx", "hy", "hz"]).join(at.withColumnRenamed("obj_id", "other"), ["gx", "gy", "gz", "category"])
    found = pairs.where((apart < reach) & (F.col("obj_id") != F.col("other"))).groupBy("obj_id").agg(F.collect_set("category").alias("some"))
    whole = whole.groupBy("hx", "hy", "hz").agg(F.collect_set("category").alias("all"))
    names = first.select("obj_id", "hx", "hy", "hz").join(whole, ["hx", "hy", "hz"], "left").join(found, "obj_id", "left")
    none = F.array().cast("array<string>")
    names = names.select("obj_id", F.array_sort(F.array_union(F.coalesce("all", none), F.coalesce("some", none))).alias("names"))
    return names.where(F.size("names") > 0)


def describe(objects: DataFrame, zones: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``obj_id, function, spatial, distance, context, summary``: what an object is for, its nearest neighbour closer than 2 m, and the zone of what is closer than 3 m.

    An object without a place has an unknown location and no context; the neighbours' names are in alphabetical order.
    """
    o = objects.select("obj_id", "category", "cx", "cy", "cz")
    at, xyz = o.dropna(subset=["cx", "cy", "cz"]), ("cx", "cy", "cz")
    closest = nearest_join(at, at.withColumnRenamed("obj_id", "other"), "obj_id", "other", xyz, xyz, limit=math.nextafter(NEAREST, 0.0), others=True, digits=9, carry=("category", *xyz))
    closest = closest.select("obj_id", F.struct(F.col("category").alias("name"), *(F.col(c).alias(f"b{c[1]}") for c in xyz), F.col("distance").alias("d")).alias("b"))
    closest = o.join(closest, "obj_id").select("obj_id", F.struct("b.name", "b.d", *((F.col(c) - F.col(f"b.b{c[1]}")).alias(f"d{c[1]}") for c in xyz)).alias("n"))
    near = names_around(at, AROUND).join(closest, "obj_id", "full")
    side = F.when(F.abs("n.dx") > F.abs("n.dy"), F.when(F.col("n.dx") > 0, "To the right of").otherwise("To the left of")).when(F.col("n.dy") > 0, "In front of").otherwise("Behind")
    placed = F.concat(side, F.lit(" the "), F.col("n.name"), F.lit(", about "), F.format_string("%.1f", F.col("n.d")), F.lit("m away"))
    spatial = F.when(F.col("cx").isNull(), "Location unknown").when(F.col("n").isNull(), F.concat(F.lit("Standalone "), F.col("category"))).otherwise(placed)
    context = F.when(F.col("names").isNull(), "").otherwise(_zone(F.col("names"), zones or ZONES))
    out = o.join(near, "obj_id", "left").select("obj_id", "category", function_of(F.col("category")).alias("function"), spatial.alias("spatial"), F.col("n.d").alias("distance"), context.alias("context"))
    brief = F.concat(F.lit("A "), F.col("category"))
    summary = F.when(F.lower("spatial").contains("unknown"), brief).otherwise(F.concat(brief, F.lit(" "), F.substring_index(F.lower("spatial"), ",", 1)))
    return out.withColumn("summary", summary).drop("category")
