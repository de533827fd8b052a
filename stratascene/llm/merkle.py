"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces of a paragraph, in DataFrame expressions only.

Sections are parted by an empty line, paragraphs by a line end, pieces have ``PIECE`` code points. A piece's node is its SHA-256,
a paragraph's that of its pieces' nodes, a section's that of its paragraphs', the root that of the sections'. Equal roots mean
equal texts. The fingerprint is the tree in short: the root, the node of every section and paragraph, and a mark of every piece, so that two
fingerprints alone tell which branches differ, from the root down, and how much of two texts agrees.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage_table

PIECE = 32
#: Hex digits of an inner node and of a piece's mark in the fingerprint.
NODE, MARK = 16, 4
#: Documents in one slice of the order by identifier, on average.
SLICE_ROWS = 2_000
#: Slices at most; beyond, slices grow.
MAX_SLICES = 100_000


def _pieces(paragraph: F.Column) -> F.Column:
    return F.transform(F.regexp_extract_all(paragraph, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), lambda x: F.sha2(x, 256))


def _joined(nodes: F.Column) -> F.Column:
    return F.sha2(F.array_join(nodes, ""), 256)


def _once(value: F.Column, use: Callable[[F.Column], F.Column]) -> F.Column:
    """``use(value)``, with a value that is used several times computed once; inside lambdas Spark doesn't see that it is the same."""
    return F.transform(F.array(value), use)[0]


def fingerprint(text: F.Column) -> F.Column:
    """The fingerprint of a text that isn't null: ``root|section/section...``, a section ``node:paragraph.paragraph...``, a paragraph ``node=marks``."""

    def paragraph(p: F.Column) -> F.Column:
        marks = lambda pieces: F.array_join(F.transform(pieces, lambda x: F.substring(x, 1, MARK)), "")
        return _once(_pieces(p), lambda pieces: F.struct(_joined(pieces).alias("node"), marks(pieces).alias("marks")))

    def section(s: F.Column) -> F.Column:
        short = lambda paragraphs: F.array_join(F.transform(paragraphs, lambda p: F.concat(F.substring(p["node"], 1, NODE), F.lit("="), p["marks"])), ".")
        both = _once(F.transform(F.split(s, "\n", -1), paragraph), lambda x: F.struct(_joined(F.transform(x, lambda p: p["node"])).alias("node"), short(x).alias("short")))
        return _once(both, lambda x: F.struct(x["node"].alias("node"), F.concat(F.substring(x["node"], 1, NODE), F.lit(":"), x["short"]).alias("short")))

    whole = lambda sections: F.concat(_joined(F.transform(sections, lambda x: x["node"])), F.lit("|"), F.array_join(F.transform(sections, lambda x: x["short"]), "/"))
    return _once(F.transform(F.split(text, "\n\n", -1), section), whole)


def _sections(print_: F.Column) -> F.Column:
    return F.split(F.substring_index(print_, "|", -1), "/", -1)


def _paragraphs(section: F.Column) -> F.Column:
    return F.split(F.substring_index(section, ":", -1), "[.]", -1)


def _paragraph_marks(print_: F.Column) -> F.Column:
    return F.transform(F.flatten(F.transform(_sections(print_), _paragraphs)), lambda p: F.substring_index(p, "=", -1))


def likeness(a: F.Column, b: F.Column) -> F.Column:
    """Share of pieces with equal marks at the same place of the same paragraph, from two fingerprints; 1 for equal roots."""
    marks = lambda p: F.regexp_extract_all(p, F.lit(f".{{{MARK}}}"), F.lit(0))

    def equal(z: F.Column) -> F.Column:
        every = F.size(F.filter(F.arrays_zip(marks(z["x"]).alias("p"), marks(z["y"]).alias("q")), lambda m: m["p"] == m["q"]))
        return F.when(z["x"].isNull() | z["y"].isNull() | (z["x"] == "") | (z["y"] == ""), F.lit(0)).when(z["x"] == z["y"], (F.length(z["x"]) / MARK).cast("int")).otherwise(every)

    def of(z: F.Column) -> F.Column:
        same = F.aggregate(F.transform(F.arrays_zip(z["x"].alias("x"), z["y"].alias("y")), equal), F.lit(0), lambda acc, n: acc + n)
        size = lambda side: F.aggregate(side, F.lit(0), lambda acc, p: acc + F.length(p)) / MARK
        return _once(F.greatest(size(z["x"]), size(z["y"])), lambda most: F.when(most == 0, F.lit(0.0)).otherwise(same / most))

    pair = F.struct(_paragraph_marks(a).alias("x"), _paragraph_marks(b).alias("y"))
    return F.when(F.substring_index(a, "|", 1) == F.substring_index(b, "|", 1), F.lit(1.0)).otherwise(_once(pair, of))


def differing_branches(a: F.Column, b: F.Column) -> F.Column:
    """``section, paragraph`` (numbers from 0) of the paragraphs whose nodes differ, or that only one text has; branches under equal nodes aren't entered."""
    kind = "array<struct<section:int,paragraph:int>>"

    def in_section(z: F.Column, s: F.Column) -> F.Column:
        pairs = F.arrays_zip(_paragraphs(F.coalesce(z["x"], F.lit(":"))).alias("p"), _paragraphs(F.coalesce(z["y"], F.lit(":"))).alias("q"))
        unequal = F.transform(pairs, lambda w, k: F.when(~F.substring_index(w["p"], "=", 1).eqNullSafe(F.substring_index(w["q"], "=", 1)), F.struct(s.alias("section"), k.alias("paragraph"))))
        return F.when(F.substring_index(z["x"], ":", 1).eqNullSafe(F.substring_index(z["y"], ":", 1)), F.array().cast(kind)).otherwise(F.filter(unequal, lambda w: w.isNotNull()))

    every = F.flatten(F.transform(F.arrays_zip(_sections(a).alias("x"), _sections(b).alias("y")), in_section))
    return F.when(F.substring_index(a, "|", 1) == F.substring_index(b, "|", 1), F.array().cast(kind)).otherwise(every)


def _slices(ids: DataFrame) -> tuple[list[int], int]:
    """Identifiers, descending, that cut the order into slices of about equal size, and the number of rows."""
    rows = ids.count()
    n = min(MAX_SLICES, rows // SLICE_ROWS)
    if n < 1:
        return [], rows
    cuts = ids.agg(F.percentile_approx("id", [k / (n + 1) for k in range(1, n + 1)], 20 * (n + 1))).first()[0] or []
    return sorted(set(cuts), reverse=True), rows


def _slice_of(id_: F.Column, cuts: list[int]) -> F.Column:
    """Number of cuts above an identifier, found in two steps of about the square root of their number; null comes last."""
    if not cuts:
        return F.when(id_.isNull(), F.lit(1)).otherwise(F.lit(0))
    step = max(1, int(len(cuts) ** 0.5))
    coarse = cuts[step - 1 :: step]
    above = lambda values: F.size(F.filter(values, lambda c: c > id_))
    k = above(F.array(*[F.lit(c).cast("long") for c in coarse])) * step
    fine = above(F.slice(F.array(*[F.lit(c).cast("long") for c in cuts]), k + 1, F.lit(step)))
    return F.when(id_.isNull(), F.lit(len(cuts) + 1)).otherwise(k + fine)


def with_next(rows: DataFrame, value: list[str]) -> DataFrame:
    """``rows`` (``id``, ``body``, ...) with ``next_<value>`` of the next row by descending ``id``, after the last of the first.

    The order is cut into slices; the first row of a slice goes to the slice before it too, as a guest at its end, so that one
    shuffle and a window in each slice suffice. Null identifiers come last; ties are ordered by ``body``.
    """
    cuts, _ = _slices(rows.select("id"))
    placed = rows.withColumn("slice", _slice_of(F.col("id"), cuts))
    firsts = {r["slice"]: r["id"] for r in placed.groupBy("slice").agg(F.max("id").alias("id")).collect()}  # a row for each slice
    order = sorted(firsts)
    guest_of = {k: order[(n - 1) % len(order)] for n, k in enumerate(order)}
    size = len(cuts) + 2
    first_id = F.element_at(F.array(*[F.lit(firsts.get(k)).cast("long") for k in range(size)]), F.col("slice") + 1)
    guest = F.element_at(F.array(*[F.lit(guest_of.get(k, 0)) for k in range(size)]), F.col("slice") + 1)
    own = F.struct(F.col("slice").alias("slice"), F.lit(False).alias("guest"))
    both = F.array(own, F.struct(guest.alias("slice"), F.lit(True).alias("guest")))
    dealt = placed.withColumn("at", F.explode(F.when(F.col("id").eqNullSafe(first_id), both).otherwise(F.array(own)))).drop("slice").select("*", F.col("at.slice").alias("slice"), F.col("at.guest").alias("guest")).drop("at")
    window = Window.partitionBy("slice").orderBy("guest", F.col("id").desc_nulls_last(), F.col("body").desc())
    return reduce(lambda df, c: df.withColumn(f"next_{c}", F.lead(c).over(window)), value, dealt).where("NOT guest").drop("slice", "guest")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edited_branches``, the last the number of differing paragraphs.

    The edited text has its last ``floor(n_chars / 3)`` code points replaced by the first as many, or all, of the next document in
    descending order of identifiers, after the last of the first. A null text is empty; a single document is its own next;
    null identifiers come last and ties are ordered by text; an empty table gives an empty table. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body")).withColumn("fingerprint", fingerprint(F.col("body")))
    rows = with_next(rows, ["body", "fingerprint"])
    n = F.length("body")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("body"), F.lit(1), n - cut), F.substring(F.col("next_body"), F.lit(1), cut))
    rows = rows.select("id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    rows = rows.select("id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint")
    rows = stage_table(rows, "fingerprints", compression="zstd")
    return rows.select("id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"), F.size(differing_branches(F.col("fingerprint"), F.col("edited_fingerprint"))).cast("long").alias("edited_branches"))
