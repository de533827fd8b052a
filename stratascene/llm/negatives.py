"""Hard negatives by a vector-approximation file.

Each dimension is cut into 256 cells of about equally many rows; the file keeps a row's cells, a byte each, beside its vector of
integers. For an anchor, a table has what each cell can add to the inner product at least and at most, so that look-ups bound the
score of a row. Only rows that the bounds leave in question are scored exactly.

Anchors are dealt in chunks and rows in blocks; a task holds one chunk and one block and returns, for each anchor, as many rows as are
wanted. First the positives are found, then, for the window of scores that each of them sets, the negatives.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship_package, stage_table

#: Cells of a dimension: a byte.
CELLS = 256
#: Rows in a block and anchors in a chunk, on average.
BLOCK, CHUNK = 1024, 512
#: Anchors whose bounds are held at once.
AT_ONCE = 64
_LAST = np.iinfo(np.int64).max


class Cells:
    """The cells of each dimension, from what separates them and the smallest and largest value."""

    def __init__(self, cuts: np.ndarray, least: np.ndarray, most: np.ndarray) -> None:
        self.cuts = cuts
        self.least = np.concatenate([least[:, None], cuts], axis=1)
        self.most = np.concatenate([cuts - 1, most[:, None]], axis=1)

    def approximations(self, vectors: np.ndarray) -> np.ndarray:
        """The cells of vectors."""
        cells = np.zeros(vectors.shape, dtype=np.uint8)
        for j in range(vectors.shape[1]):
            cells[:, j] = np.searchsorted(self.cuts[j], vectors[:, j], side="right")
        return cells

    def bounds(self, anchors: np.ndarray, approximations: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the scores of rows (first axis) with anchors (second) are at least and at most."""
        k, d = anchors.shape
        table = np.empty((CELLS, 2 * k), dtype=np.int64)
        out = np.zeros((len(approximations), 2 * k), dtype=np.int64)
        for j in range(d):
            a, b = self.least[j][:, None] * anchors[:, j], self.most[j][:, None] * anchors[:, j]
            np.minimum(a, b, out=table[:, :k])
            np.maximum(a, b, out=table[:, k:])
            out += table[approximations[:, j]]
        return out[:, :k], out[:, k:]


def best_in_window(k: int, low: int | None, high: int | None, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Rows that may be among the ``k`` highest scores from ``low`` to ``high``, by bounds of their scores."""
    may, sure = np.ones(len(least), dtype=bool), np.ones(len(least), dtype=bool)
    if low is not None:
        may, sure = (most >= low) & (least <= high), (least >= low) & (most <= high)
    known = least[sure]
    if len(known) >= k:  # k rows of the window score as much at least
        may &= most >= np.partition(known, len(known) - k)[len(known) - k]
    return np.flatnonzero(may)


def _highest(k: int, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids[rows], -scores))[:k]
    return rows[order], scores[order]


def _vectors(column: pa.ChunkedArray, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), width)


def _scan(cells: Cells, found: Callable, out: pa.Schema) -> Callable[[pa.Table], pa.Table]:
    """A task's work on a chunk of anchors and a block of rows: ``found(anchor, own, other, least, most)`` gives the parts of the result for an anchor."""

    def run(both: pa.Table) -> pa.Table:
        both = both.combine_chunks()
        anchor = both.column("anchor").to_numpy()
        rows, anchors = both.take(pa.array(np.flatnonzero(~anchor))), both.take(pa.array(np.flatnonzero(anchor)))
        if not rows.num_rows or not anchors.num_rows:
            return out.empty_table()
        d = len(cells.cuts)
        vectors, file = _vectors(rows.column("vector"), np.int64, d), _vectors(rows.column("approximation"), np.uint8, d)
        labels, ids = rows.column("label").to_numpy(), rows.column("id").fill_null(_LAST).to_numpy()
        asked = _vectors(anchors.column("vector"), np.int64, d)
        parts = []
        for lo in range(0, len(asked), AT_ONCE):
            least, most = cells.bounds(asked[lo : lo + AT_ONCE], file)
            for a in range(least.shape[1]):
                at = lo + a
                one = {c: anchors.column(c)[at].as_py() for c in anchors.column_names if c not in ("vector", "approximation")}
                for extra, which, scores in found(one, ids, labels, vectors, asked[at], least[:, a], most[:, a]):
                    if len(which):
                        parts.append({**extra, "row": which, "score": scores})
        if not parts:
            return out.empty_table()
        where = np.concatenate([p["row"] for p in parts])
        times = [len(p["row"]) for p in parts]
        got = {"id": rows.column("id").take(pa.array(where)), "score": pa.array(np.concatenate([p["score"] for p in parts]))}
        for f in out:
            if f.name not in got:
                got[f.name] = pa.array([p[f.name] for p, n in zip(parts, times) for _ in range(n)], f.type)
        return pa.table({f.name: got[f.name] for f in out}, schema=out)

    return run


def _positives(k: int) -> Callable:
    def found(one, ids, labels, vectors, asked, least, most):
        rows = np.flatnonzero((labels == one["label"]) & (ids != one["id"]))
        rows = rows[best_in_window(k, None, None, least[rows], most[rows])]
        yield {"key": one["key"]}, *_highest(k, rows, vectors[rows] @ asked, ids)

    return found


def _negatives(k: int, low: int, high: int) -> Callable:
    def found(one, ids, labels, vectors, asked, least, most):
        others = np.flatnonzero(labels != one["label"])
        least, most = least[others], most[others]
        for place, positive, score in zip(one["places"], one["positives"], one["scores"]):
            first, last = -(-low * score // 100), high * score // 100
            if first <= last:
                rows = others[best_in_window(k, first, last, least, most)]
                scores = vectors[rows] @ asked
                inside = (first <= scores) & (scores <= last)
                yield {"key": one["key"], "anchor_id": one["id"], "place": place, "positive_id": positive, "positive_score": score}, *_highest(k, rows[inside], scores[inside], ids)

    return found


def _codes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where("label IS NOT NULL AND v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
    return rows.select("id", "label", F.transform("v", lambda x: F.floor(256 * x)).alias("codes"))


def _cells_of(codes: DataFrame) -> Cells | None:
    """Cells of about equally many values; the driver gets a row for each dimension."""
    parts = F.array(*[F.lit(k / CELLS) for k in range(1, CELLS)])
    rows = codes.select(F.posexplode("codes")).groupBy("pos").agg(F.percentile_approx("col", parts, 10_000).alias("cuts"), F.min("col").alias("least"), F.max("col").alias("most")).orderBy("pos").collect()
    least, most = (np.array([f(r[c], 0) for r in rows], dtype=np.int64) for c, f in (("least", min), ("most", max)))  # a vector that ends early goes on with zeros
    if len(rows) and len(rows) * float(max(-least.min(), most.max())) ** 2 >= 2.0**62:
        raise ValueError("the scores of these vectors don't fit into 64 bits")
    return Cells(np.array([r.cuts for r in rows], dtype=np.int64).reshape(len(rows), CELLS - 1), least, most)


def approximation_file(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, Cells, int]:
    """``id, label, block, vector, approximation`` (little-endian 64-bit integers; a byte for each cell), written to the shared folder; the cells; the number of blocks."""
    ship_package(vectors.sparkSession)
    codes = _codes(vectors, id_col, vector_col, label_col)
    cells = _cells_of(codes)
    d = len(cells.cuts)
    blocks = max(1, math.ceil(vectors.count() / BLOCK))

    def run(batches):
        for batch in batches:
            rows = np.zeros((batch.num_rows, d), dtype=np.int64)
            for k, v in enumerate(batch.column("codes")):
                v = v.values.to_numpy()
                rows[k, : len(v)] = v
            file = cells.approximations(rows)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("block"), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array([r.tobytes() for r in file], pa.binary())], ["id", "label", "block", "vector", "approximation"])

    dealt = codes.withColumn("block", F.floor(F.rand(7) * blocks).cast("int"))  # whatever the identifiers; written once, so that it stays
    return stage_table(dealt.mapInArrow(run, "id long, label long, block int, vector binary, approximation binary"), "approximations"), cells, blocks


def _searched(rows: DataFrame, anchors: DataFrame, blocks: int, chunks: int, extra: str, run: Callable, schema: str) -> DataFrame:
    """``run`` on each chunk of anchors with each block of rows."""
    own = [c.split()[0] for c in extra.split(",")] if extra else []
    left = rows.select("block", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(False).alias("anchor"), F.lit(None).cast("long").alias("key"), "id", "label", "vector", "approximation", *[F.lit(None).cast("array<long>").alias(c) for c in own])
    right = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "chunk", F.lit(True).alias("anchor"), "key", "id", "label", "vector", F.lit(None).cast("binary").alias("approximation"), *own)
    return left.unionByName(right).groupBy("block", "chunk").applyInArrow(run, schema)


def hard_negatives(vectors: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """For each anchor and positive, the highest-scored rows of other labels from ``low`` to ``high`` per cent of the positive's score.

    Columns ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``. Components become ``floor(256 * x)`` and scores are
    integer inner products; higher ones come first, ties by smaller identifier, null last. ``is_anchor`` is a condition on ``id``; rows
    whose identifier is null are no anchors, but may be found.
    Rows with a null label or vector, or a component that is null or not finite, take no part. A vector that is shorter than others goes on
    with zeros. A row that occurs repeatedly is found as often; of equal anchors one is asked for, and rows of an anchor's own
    identifier aren't among its positives. A positive that has no such negative has no row; an empty table gives an empty table. Other
    columns are ignored. Vectors whose scores could pass 64 bits are an error.
    """
    rows, cells, blocks = approximation_file(vectors, id_col, vector_col, label_col)
    anchors = rows.where(F.col("id").isNotNull() & is_anchor).select("id", "label", "vector").distinct()
    chunks = max(1, math.ceil(anchors.count() / CHUNK))
    anchors = stage_table(anchors.select(F.monotonically_increasing_id().alias("key"), F.floor(F.rand(11) * chunks).cast("int").alias("chunk"), "id", "label", "vector"), "anchors")
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]

    near = _searched(rows, anchors, blocks, chunks, "", _scan(cells, _positives(n_positives), pa.schema([("key", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])), "key long, id long, score long")
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where(F.col("place") <= n_positives)
    near = near.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("p"))
    asked = anchors.join(near, "key").select("*", *[F.col(f"p.{c}").cast("array<long>").alias(n) for c, n in (("place", "places"), ("id", "positives"), ("score", "scores"))]).drop("p")

    fields = ("key", "anchor_id", "place", "positive_id", "positive_score", "id", "score")
    schema = pa.schema([(c, pa.int64()) for c in fields])
    far = _searched(rows, asked, blocks, chunks, "places long, positives long, scores long", _scan(cells, _negatives(n_negatives, low, high), schema), ", ".join(f"{c} long" for c in fields))
    far = far.withColumn("rank", F.row_number().over(Window.partitionBy("key", "place").orderBy(*order))).where(F.col("rank") <= n_negatives)
    return far.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
