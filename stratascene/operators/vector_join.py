"""The most similar vectors of many, for many: blocks of one side meet blocks of the other in matrix products, and each keeps a few a row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut

#: Vectors of a block, on either side, on average.
BLOCK = 4096
#: Similarities are ordered by so many digits, so that equal ones are, however they were summed; ties go to the lowest identifier.
DIGITS = 9


def _blocks(rows: DataFrame, id_col: str, feature: str, name: str) -> tuple[DataFrame, int]:
    slim = rows.where(F.col(feature).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(feature).cast("array<double>").alias("v"))
    n = max(1, -(-slim.count() // BLOCK))
    return cut(slim.withColumn(name, F.floor(F.rand(5) * n).cast("int")), name), n


def _best(k: int, least: float | None):
    def run(both: pa.Table) -> pa.Table:
        both = both.combine_chunks()
        asked = both.column("asks").to_numpy()
        left, right = (both.take(pa.array(np.flatnonzero(x))) for x in (asked, ~asked))
        empty = pa.schema([("q", pa.int64()), ("id", pa.int64()), ("sim", pa.float64())]).empty_table()
        if not left.num_rows or not right.num_rows:
            return empty
        vectors = []
        for t in (left, right):
            flat = t.column("v").combine_chunks().flatten().to_numpy()
            if len(flat) % t.num_rows:
                raise ValueError("vectors differ in length")
            x = flat.reshape(t.num_rows, -1)
            vectors.append(x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-300)[:, None])
        q, ids = left.column("id").to_numpy(), right.column("id").to_numpy()
        out = []
        for lo in range(0, len(q), 512):  # a slice of the product at a time
            sims = np.round(vectors[0][lo : lo + 512] @ vectors[1].T, DIGITS)
            for row, s in zip(q[lo : lo + 512], sims):
                may = np.flatnonzero(s >= (np.partition(s, len(s) - k)[len(s) - k] if k < len(s) else -np.inf))
                may = may if least is None else may[s[may] >= least]
                may = may[np.lexsort((ids[may], -s[may]))[:k]]
                out.append((np.full(len(may), row), ids[may], s[may]))
        return pa.table([np.concatenate(c) for c in zip(*out)], schema=empty.schema)

    return run


def top_k_join(queries: DataFrame, rows: DataFrame, k: int, query_id: str = "det_id", row_id: str = "obj_id", feature: str = "feat", least: float | None = None) -> DataFrame:
    """``<query_id>, <row_id>, sim, rank``: for each vector asked for the ``k`` rows most similar by cosine (of ``least`` at least), ties by identifier.

    What leaves a task are ``k`` rows for each vector asked for and block of rows. Null vectors ask for nothing and are no answer.
    """
    left, m = _blocks(queries, query_id, feature, "chunk")
    right, n = _blocks(rows, row_id, feature, "block")
    every = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    both = left.select(F.lit(True).alias("asks"), "id", "v", "chunk", every(n).alias("block")).unionByName(right.select(F.lit(False).alias("asks"), "id", "v", every(m).alias("chunk"), "block"))
    found = both.groupBy("chunk", "block").applyInArrow(_best(k, least), "q long, id long, sim double")
    order = Window.partitionBy("q").orderBy(F.col("sim").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("q").alias(query_id), F.col("id").alias(row_id), "sim", "rank")
