"""K-means by Lloyd's rounds: tasks add up what falls to each centre, for all starts at once, and only centres go back and forth."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distances and inertias are compared by so many digits; ties go to the lowest centre and start.
DIGITS, INERTIA_DIGITS = 9, 6


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d2 = np.round(((x[:, None, :] - centres[None]) ** 2).sum(axis=2), DIGITS)
    return d2.argmin(axis=1), d2.min(axis=1)


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)


def _sums(centres: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [np.zeros(len(c), dtype=np.int64) for c in centres]
        total = [np.zeros(c.shape) for c in centres]
        inertia = [0.0] * len(centres)
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                x = _vectors(whole.slice(lo, 2000))
                for s, c in enumerate(centres):
                    near, d2 = _nearest(x, c)
                    n[s] += np.bincount(near, minlength=len(c))
                    np.add.at(total[s], near, x)
                    inertia[s] += float(d2.sum())
        rows = [(s, k, int(n[s][k]), total[s][k].tolist(), inertia[s] if k == 0 else 0.0) for s in range(len(centres)) for k in range(len(centres[s]))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.float64()))], ["start", "centre", "n", "total", "inertia"])

    return run


def _round(rows: DataFrame, centres: list[np.ndarray]) -> tuple[list[np.ndarray], list[float]]:
    """The centres of what is nearest to each (as before where nothing is), and the starts' inertias before. The driver gets a row for each centre."""
    parts = rows.select("x").mapInArrow(_sums(centres), "start int, centre int, n long, total array<double>, inertia double")
    sums = parts.select("start", "centre", "n", "inertia", F.posexplode("total").alias("k", "v")).groupBy("start", "centre", "k").agg(F.sum("v").alias("v"), F.sum("n").alias("n"), F.sum("inertia").alias("inertia"))
    after = [c.copy() for c in centres]
    inertia = [0.0] * len(centres)
    for r in sums.collect():
        if r.n:
            after[r.start][r.centre, r.k] = r.v / r.n
        if r.k == 0:
            inertia[r.start] += r.inertia
    return after, inertia


def kmeans(rows: DataFrame, k: int, starts: int = 10, rounds: int = 30, seed: int = 42) -> DataFrame:
    """``id, cluster`` of ``id, x`` (vectors): the best of ``starts`` runs of at most ``rounds`` rounds; clusters that are empty have no number.

    A start's first centres are the ``k`` rows whose identifiers have the smallest MD5 with the seed and the start's number, so that the result is the
    same in every run and can be stated elsewhere.
    """
    centres = []
    for s in range(starts):
        first = rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:{s}:"), F.col("id").cast("string")))).limit(k).collect()
        centres.append(np.array([r.x for r in first]))
    for _ in range(rounds):
        after, _ = _round(rows, centres)
        moved = max(float(np.abs(a - b).max()) for a, b in zip(after, centres))
        centres = after
        if moved < 1e-12:
            break
    _, inertia = _round(rows, centres)
    best = centres[min(range(starts), key=lambda s: (round(inertia[s], INERTIA_DIGITS), s))]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                batch = whole.slice(lo, 2000)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(_nearest(_vectors(batch), best)[0].astype(np.int32))], ["id", "centre"])

    near = rows.select("id", "x").mapInArrow(assign, "id long, centre int")
    used = sorted(r.centre for r in near.select("centre").distinct().collect())
    return near.select("id", (F.array_position(F.array(*[F.lit(c) for c in used]), F.col("centre")) - 1).cast("int").alias("cluster"))
