"""Built indices, joins of vectors and k-means against all pairs; plans that grow with their rounds."""

import math
import random

import numpy as np
import pytest

from stratascene.operators import kmeans as km
from stratascene.operators import retrieval, vector_join, views
from stratascene.sources import indices, spatial_index

R = random.Random(6)


def _points(n):
    return [(k, k % 7, R.uniform(0, 10), R.gauss(5, 2), R.choice([0.0, 1.0, R.random()])) for k in range(n)] + [(n + k, 0, 1.0, 1.0, 1.0) for k in range(40)]


def test_spatial_index_reads_few_files(spark, tmp_path):
    rows = _points(4000)
    points = spark.createDataFrame([*rows, (9000, 1, None, 0.0, 0.0)], "pt long, obj_id long, x double, y double, z double").repartition(3)
    spatial_index.build(points, str(tmp_path / "i"), rows_per_file=30)
    index = spatial_index.SpatialIndex(spark, str(tmp_path / "i"))
    every = index.files.count()
    assert every > 20
    for place, radius in [((5.0, 5.0, 0.5), 0.5), ((0.0, 9.0, 0.0), 1.0), ((1.0, 1.0, 1.0), 0.0), ((50.0, 0.0, 0.0), 3.0)]:
        want = {r[0]: math.dist(place, r[2:]) for r in rows if math.dist(place, r[2:]) <= radius}
        found = index.ball(place, radius)
        assert {r.pt: pytest.approx(r.distance) for r in found.collect()} == want
        assert len(index.files_in(place, radius)) < every / 2 and len(found.inputFiles()) == len(index.files_in(place, radius))
        for k in (1, 17, 60):
            near = index.nearest(place, k)
            assert [r.pt for r in near.collect()] == [r[0] for r in sorted(rows, key=lambda r: (math.dist(place, r[2:]), r[0]))[:k]]
            assert len(near.inputFiles()) < every or place[0] == 50.0
    empty = spatial_index.build(points.limit(0), str(tmp_path / "none"))
    assert empty.ball((0.0, 0.0, 0.0), 1.0).count() == 0 and empty.nearest((0.0, 0.0, 0.0), 3).count() == 0


def test_all_indices(spark, tmp_path):
    objects = spark.createDataFrame([(k, float(k % 5), float(k // 5), 1.0) for k in range(20)], "obj_id long, cx double, cy double, cz double")
    poses = spark.createDataFrame([(v, float(v), 0.0, 1.0, 1.0, 0.0, 0.0) for v in range(4)], "view_id long, px double, py double, pz double, fwx double, fwy double, fwz double")
    features = spark.createDataFrame([(k, [3.0, float(k)] if k % 4 else None) for k in range(20)], "obj_id long, feat array<double>")
    points = spark.createDataFrame(_points(50), "pt long, obj_id long, x double, y double, z double")
    indices.build_indices(objects, poses, features, points, str(tmp_path / "all"), most_views=2)
    i = indices.open_indices(spark, str(tmp_path / "all"))
    assert i.features.count() == 15 and all(abs(np.linalg.norm(r.feat) - 1) < 1e-9 for r in i.features.collect())
    assert i.views_of.where("rank > 2").count() == 0 and {r.view_id for r in i.objects_in.collect()} == {0, 1, 2, 3}
    assert i.regions.count() == 20 and 1 < i.regions.select("region").distinct().count() <= 4
    assert [r.pt for r in i.places.nearest((0.1, 0.0, 1.0), 2).collect()] == [0, 1]
    given = objects.select("obj_id", (objects.obj_id % 3).alias("region"))
    again = indices.build_indices(objects, poses, features, points, str(tmp_path / "given"), regions=given)
    assert {r.obj_id: r.region for r in again.regions.collect()} == {k: k % 3 for k in range(20)}


def test_top_k_join(spark, monkeypatch):
    vectors = [[round(R.gauss(0, 1), 1) for _ in range(3)] for _ in range(120)]
    vectors += [[2 * x for x in vectors[k]] for k in range(20)]  # equal directions, so ties
    rows = spark.createDataFrame([*enumerate(vectors), (500, None)], "obj_id long, feat array<double>").repartition(3)
    asked = spark.createDataFrame([*((k, v) for k, v in enumerate(vectors[:50])), (60, None)], "det_id long, feat array<float>")
    unit = [np.array(v) / np.linalg.norm(v) for v in vectors]
    for block in (4096, 17):
        monkeypatch.setattr(vector_join, "BLOCK", block)
        for least in (None, 0.9):
            got = {(r.det_id, r["rank"]): (r.obj_id, r.sim) for r in vector_join.top_k_join(asked, rows, 4, least=least).collect()}
            for q in range(50):
                u = np.array(np.float32(vectors[q]), dtype=float)
                sims = [(-round(float(u / np.linalg.norm(u) @ w), 9), k) for k, w in enumerate(unit)]
                best = sorted(s for s in sims if least is None or -s[0] >= least)[:4]
                assert [got.get((q, r + 1), (None,))[0] for r in range(len(best))] == [k for _, k in best] and (q, len(best) + 1) not in got
    assert vector_join.top_k_join(asked.limit(0), rows, 4).count() == 0 and vector_join.top_k_join(asked, rows.limit(0), 4).count() == 0


def test_kmeans(spark):
    points = [(k, [R.gauss(3 * (k % 4), 0.6), R.gauss(2 * (k % 3), 0.6)]) for k in range(150)] + [(200 + k, [9.0, 9.0]) for k in range(10)]
    rows = spark.createDataFrame(points, "id long, x array<double>").repartition(4)
    import hashlib

    x = np.array([p for _, p in points])
    best = None
    for s in range(10):
        order = sorted(range(len(points)), key=lambda k: hashlib.md5(f"42:{s}:{points[k][0]}".encode()).hexdigest())
        c = x[order[:5]]
        for _ in range(30):
            near = np.round(((x[:, None] - c[None]) ** 2).sum(axis=2), 9).argmin(axis=1)
            c = np.array([x[near == k].mean(axis=0) if (near == k).any() else c[k] for k in range(5)])
        d2 = np.round(((x[:, None] - c[None]) ** 2).sum(axis=2), 9)
        if best is None or round(d2.min(axis=1).sum(), 6) < best[0]:
            best = round(d2.min(axis=1).sum(), 6), d2.argmin(axis=1)
    names = {c: k for k, c in enumerate(sorted({*best[1].tolist()}))}
    assert {r.id: r.cluster for r in km.kmeans(rows, 5).collect()} == {i: names[c] for (i, _), c in zip(points, best[1].tolist())}


def test_regions_by_kmeans(spark):
    schema = "obj_id long, cx double, cy double, cz double, feat array<double>"
    rows = [(k, float(k % 2) * 9 + k / 100, 0.0, 0.0, [1.0, float(k % 2)] if k != 4 else None) for k in range(30)] + [(99, None, 0.0, 0.0, [1.0, 1.0])]
    df = spark.createDataFrame(rows, schema)
    got = {x.obj_id: x.region for x in retrieval.kmeans_regions(df, 2).collect()}
    assert 99 not in got and len({got[k] for k in range(0, 30, 2)}) == 1 and len(set(got.values())) == 2
    assert len({x.region for x in retrieval.kmeans_regions(df).collect()}) == 5
    assert {x.region for x in retrieval.kmeans_regions(df.limit(2)).collect()} == {0}
    assert {x.region for x in retrieval.kmeans_regions(df.where("obj_id IN (1, 2, 99)"), 3).collect()} == {0}


def test_coverage_scans_grow_with_rounds(spark):
    scores = spark.createDataFrame([(o, v, ((o * 7 + v * 3) % 9) / 8) for o in range(12) for v in range(8)], "obj_id long, view_id long, score double")
    scans = []
    for k in (1, 2, 3, 5):
        plan = views.joint_coverage(scores, k)._jdf.queryExecution().optimizedPlan().toString()
        scans.append(plan.count("Relation ["))
    assert scans == [1, 2, 3, 5]
    cover, chosen = dict.fromkeys(range(12), 0.0), []
    table = {(o, v): ((o * 7 + v * 3) % 9) / 8 for o in range(12) for v in range(8)}
    for _ in range(5):
        gain, v = max((round(sum(max(0, table[o, v] - cover[o]) for o in cover), 9), -v) for v in range(8))
        if gain <= 0:
            break
        chosen.append(-v)
        cover = {o: max(c, table[o, -v]) for o, c in cover.items()}
    assert [r.view_id for r in views.joint_coverage(scores, 5).orderBy("round").collect()] == chosen
