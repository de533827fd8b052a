"""Density clusters and oriented boxes of point clouds against plain numpy."""

import random

import numpy as np
import pytest

from stratascene.operators import density, principal

R = random.Random(4)
SCHEMA = "obj_id long, pt long, x double, y double, z double, colour string"


def _cloud():
    rows, pt = [], 0
    for obj in range(6):
        for _ in range(R.choice([1, 2, 3])):
            at = [R.uniform(-1, 1) for _ in range(3)]
            for _ in range(R.choice([3, 12, 40])):
                rows.append((obj, pt, *(round(a + R.gauss(0, 0.08), 2) for a in at), "red"))
                pt += 1
        for _ in range(8):
            rows.append((obj, pt, *(R.uniform(-2, 2) for _ in range(3)), "noise"))
            pt += 1
    rows += [(7, pt + k, 0.5, 0.5, 0.5, "same") for k in range(9)] + [(8, pt + 20, 1.0, 1.0, 1.0, "lone"), (9, pt + 21, None, 1.0, 1.0, "nowhere")]
    return rows


def _clusters(rows, eps, least):
    out = {}
    for obj in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == obj and r[2] is not None)
        p = np.array([r[2:5] for r in own], dtype=float).reshape(-1, 3)
        d2 = ((p[:, None] - p[None]) ** 2).sum(axis=2)
        near = d2 <= eps * eps
        core = near.sum(axis=1) >= least
        label = [None] * len(own)
        for k in range(len(own)):
            if core[k] and label[k] is None:
                todo = [k]
                while todo:
                    j = todo.pop()
                    if label[j] is None:
                        label[j] = own[k][1]
                        todo += np.flatnonzero(near[j] & core).tolist()
        for k in range(len(own)):
            if not core[k] and (near[k] & core).any():
                label[k] = label[min(np.flatnonzero(near[k] & core), key=lambda j: (d2[k, j], own[j][1]))]
        out |= {r[1]: x for r, x in zip(own, label)}
    return out


@pytest.mark.parametrize("eps, least", [(0.1, 4), (0.25, 2), (0.05, 10), (0.3, 1)])
def test_clusters(spark, eps, least):
    rows = _cloud()
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = _clusters(rows, eps, least)
    got = density.dbscan(table, eps, least).collect()
    assert len(got) == len(rows) and {r.pt: r.cluster for r in got} == {r[1]: want.get(r[1]) for r in rows}
    kept = density.keep_largest_cluster(table, eps, least).collect()
    for obj in {r[0] for r in rows}:
        sizes = {}
        for r in rows:
            if r[0] == obj and want.get(r[1]) is not None:
                sizes[want[r[1]]] = sizes.get(want[r[1]], 0) + 1
        best = min(sizes, key=lambda c: (-sizes[c], c), default=None)
        own = {r[1] for r in rows if r[0] == obj and (best is None or sizes[best] < 5 or want.get(r[1]) == best)}
        assert {r.pt for r in kept if r.obj_id == obj} == own
    assert density.dbscan(table.limit(0), eps, least).count() == 0


def test_denoised_keeps_small_objects(spark):
    rows = [(1, k, 0.1 * k, 0.0, 0.0, "") for k in range(3)] + [(2, 10 + k, 0.001 * k, 0.0, 0.0, "") for k in range(50)] + [(3, 100 + k, 0.06 * k, 0.0, 0.0, "") for k in range(9)] + [(3, 200, 9.0, 9.0, 9.0, "")]
    got = density.denoised(spark.createDataFrame(rows, SCHEMA), 0.05, 0.2, 2).collect()
    assert sorted((r.obj_id, r.pt) for r in got) == [(1, 0), (1, 1), (1, 2), *((2, 10 + k) for k in range(50)), *((3, 100 + k) for k in range(9))]


def test_principal_boxes(spark):
    g = np.random.default_rng(0)
    rows, want = [], {}
    for obj in range(8):
        turn, _ = np.linalg.qr(g.normal(size=(3, 3)))
        p = g.normal(size=(60, 3)) * [0.9, 0.4, 0.1] @ turn + g.normal(size=3)
        rows += [(obj, 100 * obj + k, *map(float, x), "") for k, x in enumerate(p)]
        axes = np.linalg.eigh(np.cov(p.T, bias=True))[1][:, ::-1]
        want[obj] = np.ptp(p @ axes, axis=0), axes, p
    rows += [(20, k, float(k), 2.0 * k, 0.0, "") for k in range(3)] + [(21, k, 1.0, 1.0, 1.0, "") for k in range(5)]
    boxes = {r.obj_id: r for r in principal.oriented_boxes(spark.createDataFrame(rows, SCHEMA)).collect()}
    for obj, (extent, axes, p) in want.items():
        b = boxes[obj]
        assert np.allclose([b.ex, b.ey, b.ez], extent)
        for v, a in zip((b.u, b.v, b.w), axes.T):
            assert abs(abs(np.dot(v, a)) - 1) < 1e-9
        inside = (p - [b.cx, b.cy, b.cz]) @ np.array([b.u, b.v, b.w]).T
        assert (np.abs(inside) <= np.array([b.ex, b.ey, b.ez]) / 2 + 1e-9).all()
    assert [boxes[20][c] for c in ("ex", "ey", "ez")] == [2.0, 4.0, 0.0] and [boxes[21][c] for c in ("ex", "ey", "ez")] == [0.0, 0.0, 0.0]
    upright = {r.obj_id: r for r in principal.oriented_boxes(spark.createDataFrame(rows, SCHEMA), upright=True).collect()}
    for obj, (_, _, p) in want.items():
        b = upright[obj]
        inside = (p - [b.cx, b.cy, b.cz]) @ np.array([b.u, b.v, b.w]).T
        assert b.w == [0.0, 0.0, 1.0] and np.allclose(np.ptp(inside, axis=0), [b.ex, b.ey, b.ez]) and abs(np.cov(inside.T)[0, 1]) < 1e-9


def test_upright_boxes_without_covariance(spark):
    """x and y don't vary together, but their sums of products round to either sign: the box turns the same way in every order of rows."""
    r = random.Random(3)
    rows, pt = [], 0
    for obj in range(40):
        half = [(r.randrange(1, 15) / 100, r.randrange(1, 40) / 100) for _ in range(8)]
        points = [(a * sx + 3.37, b * sy + 5.83) for a, b in half for sx in (1, -1) for sy in (2, -2)]
        r.shuffle(points)
        for x, y in points:
            rows.append((obj, pt, x, y, 0.1, ""))
            pt += 1
    for parts in (1, 7):
        got = principal.oriented_boxes(spark.createDataFrame(rows, SCHEMA).repartition(parts), upright=True)
        assert {round(x.yaw, 9) for x in got.collect()} == {round(np.pi / 2, 9)}
