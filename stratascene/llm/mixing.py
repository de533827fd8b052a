"""Mixing sources to target weights, in DataFrame operations only.

Every document gets a hash-random key. A source's words are laid out in key order and the layout is cut at the source's
exact word budget; a budget above the source's size repeats it in epochs. Positions in the layout are distributed prefix
sums: the leading hex digits of the key are a range bucket, words are summed by (source, bucket), a window over the buckets of
a source gives each bucket its offset, and a window inside one bucket finishes the sum. A hot source has as many buckets as
any other, so no task ever sorts a whole source.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, new_name, stage_table

#: Rows that a bucket of the hottest source holds on average, at most, before another hex digit is used.
BUCKET_ROWS = 2_000
#: A source may be repeated this often.
MAX_EPOCHS = 3


def word_count(text: F.Column) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(id_col: F.Column, seed: str) -> F.Column:
    """Hash-random key of a document, the same in every run; a null identifier has one too."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit("null"))))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``source, source_size, target`` from rows of ``source, source_size``.

    Sources by code point, null last, weigh ``weights`` in turn. The share ``level * weight`` is cut at ``MAX_EPOCHS`` times the
    source's size, and the excess goes to the others by weight until none is above: the level is where the capped shares add
    up to the whole, found by one pass over the sources in the order in which they reach their cap.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("long")
    w = sizes.withColumn("weight", pick)
    full = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    every = Window.partitionBy(F.lit(1))
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    rest = full.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    w = w.withColumn("level", (F.sum("source_size").over(every) - MAX_EPOCHS * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(rest))
    # the first source in this order whose cap is not below its share fixes the level for itself and all later ones
    w = w.withColumn("open", F.col("level") * F.col("weight") <= MAX_EPOCHS * F.col("source_size"))
    w = w.withColumn("final", F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(full.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    target = F.when(F.col("final").isNull(), (MAX_EPOCHS * F.col("source_size")).cast("double")).otherwise(F.least(F.col("final") * F.col("weight"), (MAX_EPOCHS * F.col("source_size")).cast("double")))
    return w.select("source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """One row per input row: ``id, source, key, size, source_size, target, taken``; ``taken`` counts words, repeats included.

    Each source's ``taken`` adds up to its target rounded to a whole word. The document at the cut gives only its first words in
    the last epoch. A null text has size 0, null sources are one source, rows with equal keys are ordered by size, and an
    empty table gives an empty table. Other columns are ignored.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")).withColumn("key", random_key(F.col("id"), seed))
    slim = stage_table(slim, "sizes")
    totals = stage_table(slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")), "sources")
    hottest = totals.agg(F.max("rows")).first()[0] or 1
    digits = max(2, math.ceil(math.log(max(hottest / BUCKET_ROWS, 1), 16)))
    slim = slim.withColumn("bucket", F.substring("key", 1, digits))
    plan = stage_table(source_targets(totals.select("source", "source_size")), "targets")
    offsets = slim.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    offsets = offsets.withColumn("offset", F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) - F.col("words"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = slim.withColumn("upto", F.sum("size").over(inside))
    offsets = offsets.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "offset")
    placed = placed.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).withColumn("start", F.col("offset") + F.col("upto") - F.col("size"))
    plan = plan.select(F.col("source").alias("p"), "source_size", "target")
    placed = placed.join(plan, F.col("source").eqNullSafe(F.col("p")))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    last = F.least(F.greatest(rest - F.col("start"), F.lit(0)), F.col("size"))
    return placed.select("id", "source", "key", "size", "source_size", "target", (epochs * F.col("size") + last).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, whole: the document at the cut is taken if at least half of it fits.

    A row that the mix takes no word of is left out, so null and empty texts are; null sources are one source; repeated rows of
    one identifier are each taken as often as the most taken of them; extra columns may have any name; an empty table gives an empty table.
    """
    taken = mix_sources(docs, id_col, text_col, source_col, seed, weights)
    copies = F.when(F.col("size") > 0, F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size")))).otherwise(F.lit(0))
    per_id = taken.select("id", "source", "size", copies.cast("int").alias("copies")).groupBy("id", "source", "size").agg(F.max("copies").alias("copies")).where("copies > 0")
    key, source, size, times, nth = (new_name(docs, x) for x in ("key", "mixed_source", "size", "copies", "nth"))
    per_id = per_id.select(F.col("id").alias(key), F.col("source").alias(source), F.col("size").alias(size), F.col("copies").alias(times))
    same = docs[id_col].eqNullSafe(F.col(key)) & docs[source_col].cast("string").eqNullSafe(F.col(source)) & (word_count(docs[text_col]) == F.col(size))
    return docs.join(per_id, same).withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)
