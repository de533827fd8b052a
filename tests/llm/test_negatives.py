"""Hard negatives against all scores, and the bounds of the approximation file."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from stratascene.llm import negatives

R = random.Random(3)
SCHEMA = "vec_id long, embedding array<double>, label int, id string, key string, chunk string, block string, approximation string"


def _rows():
    near = [[R.gauss(0, 0.2) for _ in range(7)] for _ in range(6)]
    rows = [(k, [x + R.gauss(0, 0.03) for x in near[k % 6]], R.choice([0, 1, 1, 1, 2])) for k in range(300)]
    rows += [(1000 + k, near[0], k % 3) for k in range(60)]  # one vector, many times
    rows += [(None, near[1], 1), (None, near[1], 2), rows[50], rows[7], rows[60], (50, near[2], 2), (400, [], 1), (450, [0.5] * 3, 2), (500, [-0.1] * 7, 1), (550, [0.0] * 7, 2)]
    rows += [(600, None, 1), (601, near[1], None), (602, [0.1, None], 1), (603, [float("nan")] + near[1][1:], 1), (604, [float("-inf")] + near[1][1:], 1), (650, [3.0] * 7, 9), (700, [30.0, -2.0], 8)]
    return rows


def _by_hand(rows, anchor=lambda i: i % 50 == 0, low=50, high=95, most=(5, 3)):
    valid = [(i, label, tuple(math.floor(256 * x) for x in v)) for i, v, label in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda r: (-r[1], r[0] is None, r[0] or 0)
    out = []
    for i, label, v in {r for r in valid if r[0] is not None and anchor(r[0])}:
        score = [(j, sum(a * b for a, b in zip(v, w)), other) for j, other, w in valid]
        positives = sorted([s for s in score if s[2] == label and s[0] != i], key=order)[: most[0]]
        for p, ps, _ in positives:
            found = sorted([s for s in score if s[2] != label and low * ps <= 100 * s[1] <= high * ps], key=order)[: most[1]]
            out += [(i, p, k + 1, n, ps, ns) for k, (n, ns, _) in enumerate(found)]
    return sorted(out, key=str)


def test_hard_negatives(spark, monkeypatch):
    rows = _rows()
    table = spark.createDataFrame([(*r, *["clash"] * 5) for r in rows], SCHEMA).repartition(3)
    want = _by_hand(rows)
    assert len(want) > 50
    assert sorted((tuple(r) for r in negatives.hard_negatives(table, F.col("id") % 50 == 0).collect()), key=str) == want
    monkeypatch.setattr(negatives, "BLOCK", 40)  # many blocks and chunks
    monkeypatch.setattr(negatives, "CHUNK", 3)
    assert sorted((tuple(r) for r in negatives.hard_negatives(table, F.col("id") % 50 == 0).collect()), key=str) == want
    got = negatives.hard_negatives(table, F.col("id") < 20, n_positives=2, n_negatives=40, low=10, high=200)
    assert sorted((tuple(r) for r in got.collect()), key=str) == _by_hand(rows, lambda i: i < 20, 10, 200, (2, 40))


def test_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert negatives.hard_negatives(none, F.col("id") % 50 == 0).count() == 0
    one = spark.createDataFrame([(0, [0.5], 1)], "vec_id long, embedding array<float>, label int")
    assert negatives.hard_negatives(one, F.col("id") % 50 == 0).count() == 0


def test_too_large(spark):
    table = spark.createDataFrame([(0, [1e18], 1), (1, [1.0], 1)], "vec_id long, embedding array<double>, label int")
    try:
        negatives.hard_negatives(table, F.col("id") % 50 == 0)
    except ValueError:
        return
    raise AssertionError("scores past 64 bits")


def test_bounds_leave_few():
    g = np.random.default_rng(1)
    vectors = np.floor(256 * g.normal(0, 0.12, (2000, 64))).astype(np.int64)
    cuts = np.sort(np.quantile(vectors, np.arange(1, 256) / 256, axis=0).astype(np.int64).T, axis=1)
    cells = negatives.Cells(cuts, vectors.min(0), vectors.max(0))
    least, most = cells.bounds(vectors[:70], cells.approximations(vectors))
    scores = vectors @ vectors[:70].T
    assert (least <= scores).all() and (scores <= most).all()
    for a in range(70):
        for low, high in ((None, None), (int(scores[:, a].max()) // 8, int(scores[:, a].max()) // 4)):
            inside = np.ones(2000, dtype=bool) if low is None else (low <= scores[:, a]) & (scores[:, a] <= high)
            best = sorted(np.flatnonzero(inside), key=lambda r: -scores[r, a])[:3]
            rows = negatives.best_in_window(3, low, high, least[:, a], most[:, a])
            assert {*best} <= {*rows.tolist()} and len(rows) < 250
