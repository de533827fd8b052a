"""Audit of how filters interact: what each removes, in every order, from 32 signed parity sums a part and label.

A document that fails the filters in a set m belongs to the cell m. The parity sum of a set w counts each document with
(-1) ** |w and m|; these sums are the Walsh-Hadamard transform of the cells' counts, so that the same signs and a division by their
number give the counts back exactly. Sums of a part add up over tasks, and all orders are evaluated on the cells alone.
"""

from __future__ import annotations

import itertools
import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, text_or_empty

#: Filters in an audit at most: the plan has a sum for each subset, and a result a row for each order and step.
MOST = 6
_STEPS = "array<struct<filter_order:string,step:int,bit:int,prior:int>>"


def failing_conditions() -> dict[str, Column]:
    """When a document fails: columns over ``body`` (its text) and ``words``. ``None`` stands for *a smaller identifier has the same text*."""
    body, words = F.col("body"), F.col("words")
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * F.regexp_count(body, F.lit("[A-Z]")) > 10 * F.length(body),
        "D": body.rlike("[#$%&*|]"),
        "E": None,
    }


def _sign(w: Column | int) -> Column:
    return 1 - 2 * (F.bit_count(F.col("mask").bitwiseAND(w)) % 2)


def failed_filters(docs: DataFrame, labels: DataFrame, filters: dict[str, Column | None], id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``part, good, toxic, mask, n``: rows of documents by what they fail, a bit for each filter in turn.

    Copies are found without gathering any: documents are counted by identifier and digest of the text, then by digest and cell, and
    of a digest only the count at its smallest identifier passes.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("body"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    rows = rows.withColumn("words", F.regexp_extract_all("body", F.lit(WORD), F.lit(0)))
    mask = sum((F.when(c, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(filters.values()) if c is not None), F.lit(0))
    rows = rows.select("id", "part", F.unhex(F.sha2("body", 256)).alias("digest"), mask.alias("mask"))
    rows = rows.groupBy("id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col("quality").eqNullSafe(1).alias("good"), F.col("toxic").eqNullSafe(1).alias("toxic")).where("id IS NOT NULL")
    known = known.groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic")).withColumn("spread", F.lit(0))
    rows = rows.withColumn("spread", F.when(F.col("id").isNull(), F.xxhash64("digest")).otherwise(0))  # rows without an identifier have no label and needn't meet in one task
    rows = rows.join(known, ["id", "spread"], "left").fillna(False, ["good", "toxic"])
    copies = [k for k, c in enumerate(filters.values()) if c is None]
    if not copies:
        return rows.groupBy("part", "good", "toxic", "mask").agg(F.sum("n").alias("n"))
    rows = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("id").alias("least"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"), F.coalesce(F.min_by(F.when(F.col("id").isNotNull(), F.col("n")), "id"), F.lit(0)).alias("at_least"))
    first = F.min("least").over(Window.partitionBy("digest"))  # a digest has a row for each part and label
    rows = rows.withColumn("pass", F.col("nameless") + F.when(F.col("least") == first, F.col("at_least")).otherwise(0))
    bits = sum(1 << k for k in copies)
    rows = rows.select("part", "good", "toxic", F.inline(F.array(F.struct("mask", F.col("pass").alias("n")), F.struct(F.col("mask").bitwiseOR(bits).alias("mask"), (F.col("n") - F.col("pass")).alias("n")))))
    return rows.groupBy("part", "good", "toxic", "mask").agg(F.sum("n").alias("n"))


def parity_sums(failed: DataFrame, n_filters: int) -> DataFrame:
    """``part, label, sums``: the signed sums of all ``2 ** n_filters`` sets, for all documents, the good ones and the toxic ones."""
    labels = F.filter(F.array(F.lit("all"), F.when(F.col("good"), F.lit("good")), F.when(F.col("toxic"), F.lit("toxic"))), lambda x: x.isNotNull())
    sums = [F.sum(F.col("n") * _sign(F.lit(w))).alias(f"s{w}") for w in range(1 << n_filters)]
    grouped = failed.select("part", F.explode(labels).alias("label"), "mask", "n").groupBy("part", "label").agg(*sums)
    return grouped.select("part", "label", F.array(*[f"s{w}" for w in range(1 << n_filters)]).alias("sums"))


def cell_counts(sums: DataFrame) -> DataFrame:
    """``part`` and ``all, good, toxic``, arrays of the documents in each cell, got back from the parity sums; labels without documents have zeros."""
    cells = F.expr("transform(sums, (s, m) -> aggregate(transform(sums, (x, w) -> x * (1 - 2 * (bit_count(m & w) % 2))), 0L, (a, x) -> a + x) div size(sums))")
    by_label = sums.select("part", "label", F.size("sums").alias("size"), cells.alias("cells")).groupBy("part")
    return by_label.agg(*[F.coalesce(F.max(F.when(F.col("label") == x, F.col("cells"))), F.array_repeat(F.lit(0).cast("long"), F.max("size"))).alias(x) for x in ("all", "good", "toxic")])


def audit_filters(docs: DataFrame, labels: DataFrame, filters: dict[str, Column | None] | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of all filters and step: ``kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.

    ``filters`` has a failing condition (a column over ``body`` and ``words``) by a name of one letter. A null text is empty, a null part
    the empty string; rows are counted as often as they occur. A condition that is null doesn't hold. A row without an identifier
    copies nothing, nor is it copied, and has no label; of labels that repeat, any that says 1 counts. Rows of one identifier don't
    copy each other. Other columns are ignored; an empty table has no parts and gives an empty table.
    ``shapley`` is what the filter of the step removes, summed over all orders: a document that fails k filters is removed by each of them in
    one k-th of the orders.
    """
    filters = filters or failing_conditions()
    if not 0 < len(filters) <= MOST:
        raise ValueError(f"between 1 and {MOST} filters can be audited")
    names = "".join(filters)
    orders = [{"filter_order": "".join(o), "step": k + 1, "bit": 1 << names.index(f), "prior": sum(1 << names.index(x) for x in o[:k])} for o in itertools.permutations(sorted(names)) for k, f in enumerate(o)]
    cells = cell_counts(parity_sums(failed_filters(docs, labels, filters, id_col, text_col, part_col), len(filters)))
    steps = cells.select("part", "all", "good", "toxic", F.inline(F.from_json(F.lit(json.dumps(orders)), _STEPS)))

    def total(of: str, when: str, times: str = "1L") -> Column:
        return F.expr(f"aggregate(transform(`{of}`, (n, m) -> IF({when}, n * ({times}), 0L)), 0L, (a, x) -> a + x)")

    fails, here = "(m & bit) != 0", "(m & bit) != 0 AND (m & prior) = 0"
    return steps.select(
        "part", "filter_order", "step", total("all", "(m & (prior | bit)) = 0").alias("kept"), total("all", here).alias("removed"), total("all", f"{fails} AND (m & prior) != 0").alias("redundant"), total("all", "m = bit").alias("unique_fails"),
        total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"), total("all", fails, f"{math.factorial(len(filters))} div bit_count(m)").alias("shapley"))
