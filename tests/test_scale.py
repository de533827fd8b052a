"""That steps form no more rows than their results need, and the same results as plain loops."""

import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratascene.functions import relations, sweeps
from stratascene.operators import density, descriptions, graph, keyframes, mapping, oriented, overlaps
from stratascene.operators import points as P


def test_blended_features_look_for_no_points_without_features(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(k % 40, k, *(rng.random() for _ in range(3))) for k in range(400)]
    feats = {o: [float(o), 1.0 / (o + 1), -1.0] for o in range(4)}
    points = spark.createDataFrame(rows, "obj_id long, pt long, x double, y double, z double")
    features = spark.createDataFrame([*feats.items(), (7, None)], "obj_id long, feat array<double>")
    met, join = [], P.radius_join
    monkeypatch.setattr(P, "radius_join", lambda left, right, *rest: met.append(sorted((left.count(), right.count()))) or join(left, right, *rest))
    got = {r.pt: list(r.feat) for r in P.blended_features(points, points.where("obj_id % 20 = 0"), features, 0.3).collect()}
    want = {}
    for o, pt, *at in rows:
        near = [feats[q] for q, _, *to in rows if q in feats and sum((a - b) ** 2 for a, b in zip(at, to)) <= 0.09]
        if o % 20 == 0 and near:
            want[pt] = [sum(c) / len(near) for c in zip(*near)]
    assert met == [[20, 40]]
    assert got.keys() == want.keys() and all(abs(a - b) < 1e-9 for k in want for a, b in zip(got[k], want[k]))


def test_box_join_against_all_pairs(spark):
    rng = random.Random(7)
    rows = [(k, *(rng.uniform(-2, 2) for _ in range(2)), *(rng.choice((0.01, 0.1, 0.5, 3.0)) for _ in range(2))) for k in range(150)]
    table = spark.createDataFrame(rows, "i long, x double, y double, w double, h double")
    other = table.toDF("j", "bx", "by", "bw", "bh")
    low, high = (lambda *c: tuple(F.col(n) for n in c)), (lambda *c: tuple(F.col(n) + F.col(e) for n, e in c))
    found = relations.box_join(table, other, (low("x", "y"), high(("x", "w"), ("y", "h"))), (low("bx", "by"), high(("bx", "bw"), ("by", "bh"))), F.col("i") != F.col("j"))
    want = [(a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and all(a[k] <= b[k] + b[k + 2] and b[k] <= a[k] + a[k + 2] for k in (1, 2))]
    got = [(r.i, r.j) for r in found.collect()]
    assert len(got) == len(set(got)) and sorted(got) == sorted(want)
    assert found.columns == [*table.columns, *other.columns]
    assert relations.box_join(table.limit(0), other, (low("x", "y"), high(("x", "w"), ("y", "h"))), (low("bx", "by"), high(("bx", "bw"), ("by", "bh"))), F.lit(True)).count() == 0


def test_hulls_are_no_larger_than_what_slices_add_up_to():
    rng = np.random.default_rng(3)
    a, b = (np.column_stack([rng.uniform(0, 0.2, (40, 3)), rng.uniform(0.3, 1, (40, 3)), rng.integers(0, 8, 40) * np.pi / 7]) for _ in range(2))
    b[:5], b[5:10, 6] = a[:5], a[5:10, 6]
    one = [oriented.hull_volume(np.concatenate([oriented.corners(x[:3], x[3:6], x[6]) for x in pair])) for pair in zip(a, b)]
    assert np.abs(oriented.hull_volumes(a, b) - one).max() < 1e-8
    directions = np.linspace(0, np.pi, 400, endpoint=False)
    for x, y, volume in zip(a, b, one):  # no more than the height times the least rectangle about both, no less than either box
        points = np.concatenate([oriented.corners(v[:3], v[3:6], v[6]) for v in (x, y)])
        spread = lambda d: np.ptp(points[:, 0] * np.cos(d) + points[:, 1] * np.sin(d))  # noqa: B023, E731
        assert max(x[3:6].prod(), y[3:6].prod()) - 1e-9 <= volume <= np.ptp(points[:, 2]) * min(spread(d) * spread(d + np.pi / 2) for d in directions) + 1e-9


def test_components_of_boxes_form_few_pairs(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(k, *(rng.uniform(0, 6) for _ in range(3)), *(rng.choice((0.02, 0.3, 0.9)) for _ in range(3))) for k in range(260)] + [(300 + k, *[20 + 0.01 * k] * 3, 1.0, 1.0, 1.0) for k in range(50)]
    table = spark.createDataFrame(rows, "obj_id long, cx double, cy double, cz double, ex double, ey double, ez double")
    volume = lambda a, b: np.prod([max(0.0, min(a[k] + a[k + 3] / 2, b[k] + b[k + 3] / 2) - max(a[k] - a[k + 3] / 2, b[k] - b[k + 3] / 2)) for k in (1, 2, 3)])
    want = {r[0]: r[0] for r in rows}
    for a, b in [(a, b) for a in rows for b in rows if a[0] < b[0] and volume(a, b) > 1e-9]:
        low, high = sorted((want[a[0]], want[b[0]]))
        want = {k: low if v == high else v for k, v in want.items()}
    met, join = [], graph.box_join
    monkeypatch.setattr(graph, "box_join", lambda *how: met.append(join(*how)) or met[-1])
    assert dict(map(tuple, graph.box_components(table).collect())) == want
    assert met[0].count() < 500  # the fifty boxes at one place alone are 1225 pairs
    assert graph.box_components(table.limit(0)).count() == 0


@pytest.mark.parametrize("most", [0, 30, 512])
def test_clusters_of_small_and_large_objects_agree(spark, monkeypatch, most):
    rng = random.Random(11)
    rows = [(k % 7, k, *(round(rng.uniform(0, 0.5), 2) for _ in range(3))) for k in range(330) if k % 7 < 3 or k < 120]
    table = spark.createDataFrame(rows, "obj_id long, pt long, x double, y double, z double").repartition(3)
    formed, pairs = [], density.near_pairs
    monkeypatch.setattr(density, "near_pairs", lambda spots, eps: formed.append(spots.select("obj_id").distinct().count()) or pairs(spots, eps))
    monkeypatch.setattr(density, "SMALL", most)
    monkeypatch.setattr(density, "PAIRS", 500)
    got = {r.pt: r.cluster for r in density.dbscan(table, 0.12, 4).collect()}
    assert formed == {0: [7], 30: [3], 512: []}[most]
    test_clusters_of_small_and_large_objects_agree.seen = getattr(test_clusters_of_small_and_large_objects_agree, "seen", got)
    assert got == test_clusters_of_small_and_large_objects_agree.seen and any(c is None for c in got.values()) and len(set(got.values())) > 7


def _crowd(spark, n, seed):
    rng = random.Random(seed)
    return [(k, rng.choice(("anvil", "gear", "rod", "ring")), *(round(rng.uniform(0, w), 2) for w in (1.0, 1.0, 0.5))) for k in range(n)] + [(n, "rod", 3.5, 0.5, 0.2), (n + 1, "plate", 7.0, 0.0, 0.0), (n + 2, "rod", None, 0.0, 0.0)]


def test_neighbours_of_crowded_objects_form_few_pairs(spark, monkeypatch):
    rows, formed, join = _crowd(spark, 500, 3), [], relations.radius_join

    def counted(*args, **how):
        formed.append(join(*args, **how).count())
        return join(*args, **how)

    for module in (relations, descriptions):
        monkeypatch.setattr(module, "radius_join", counted, raising=False)
    table = spark.createDataFrame(rows, "obj_id long, category string, cx double, cy double, cz double")
    got = {r.obj_id: (None if r.distance is None else round(r.distance, 9), r.context) for r in descriptions.describe(table, {"forge": ("none",)}).collect()}
    want = {}
    for o, _, *at in rows:
        near = [] if None in at else [(sum((a - b) ** 2 for a, b in zip(at, to)) ** 0.5, name) for q, name, *to in rows if q != o and None not in to]
        names = sorted({name for d, name in near if d < 3})
        want[o] = (min((round(d, 9) for d, _ in near if d < 2), default=None), "Near " + ", ".join(names[:3]) if names else "")
    assert got == want and sum(formed) < 40 * len(rows)
    assert {r.obj_id: r.names for r in descriptions.names_around(table.dropna(), 0.5).collect()} == {
        o: sorted(names) for o, _, *at in rows if None not in at and (names := {n for q, n, *to in rows if q != o and None not in to and sum((a - b) ** 2 for a, b in zip(at, to)) < 0.25})
    }


@pytest.mark.parametrize("other", [False, True])
def test_near_anchors_are_searched_for_in_rings(spark, monkeypatch, other):
    rows = _crowd(spark, 520, 4)
    table = spark.createDataFrame(rows, "obj_id long, category string, cx double, cy double, cz double")
    monkeypatch.setattr(relations, "best_scores", None)  # no tree
    monkeypatch.setattr(relations, "radius_join", None)  # no pairs by reach
    got = {r.obj_id: r.score for r in relations.relation_join(table, table, "hovering about", other).collect()}
    near = {o: [sum((a - b) ** 2 for a, b in zip(at, to)) ** 0.5 for q, _, *to in rows if None not in to and not (other and q == o)] for o, _, *at in rows if None not in at}
    want = {o: 1 - min(d) / 2 for o, d in near.items() if min(d) <= 2}
    assert got.keys() == want.keys() and all(abs(got[o] - want[o]) < 1e-12 for o in want)


def test_suppression_forms_no_pairs_of_what_stronger_boxes_cover(spark, monkeypatch):
    r = np.random.default_rng(8)
    f = pd.DataFrame({"view_id": r.integers(0, 2, 1600), "det": range(1600), "conf": np.round(r.random(1600), 1), "x1": np.round(r.random(1600) * 60), "y1": np.round(r.random(1600) * 40)})
    f["x2"], f["y2"] = f.x1 + np.round(10 + 30 * r.random(1600) ** 2), f.y1 + np.round(8 + 30 * r.random(1600) ** 2)
    f = pd.concat([f, f.assign(det=f.det + 1600)], ignore_index=True)
    formed, cut = [], mapping._cut
    monkeypatch.setattr(mapping, "BATCH", 64, raising=False)
    monkeypatch.setattr(mapping, "_cut", lambda df, *name: (lambda out: formed.append(out.count()) or out if out.columns == ["s", "w"] else out)(cut(df, *name)))
    kept = sorted(d for _, g in f.groupby("view_id") for d in mapping.suppress(g)["det"])
    assert sorted(x.det for x in mapping.non_maximum_suppression(spark.createDataFrame(f)).collect()) == kept
    assert max(formed) < 3 * len(f)


@pytest.mark.parametrize("between", [False, True])
def test_pairs_of_points_are_not_shuffled(spark, between):
    rng = random.Random(9)
    rows = [(k % 7, k, *(rng.random() for _ in range(3))) for k in range(300)]
    table = spark.createDataFrame(rows, "obj_id long, pt long, x double, y double, z double")
    sides = (table.where("obj_id < 3"), table.where("obj_id >= 3")) if between else (table, table)
    found = mapping.point_overlap_between(*sides, 0.2) if between else mapping.point_overlap(table, 0.2)
    want = {}
    for o, _, *at in rows:
        for j in {q for q, _, *to in rows if q != o and (not between or o < 3 <= q) and sum((a - b) ** 2 for a, b in zip(at, to)) ** 0.5 < 0.2}:
            want[o, j] = want.get((o, j), 0) + 1
    sizes = {o: sum(r[0] == o for r in rows) for o in range(7)}
    assert {(r.i, r.j): r.ratio for r in found.collect()} == {(i, j): n / sizes[i] for (i, j), n in want.items()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and re.search(r"\ba#", line)], plan


def test_texts_are_not_broadcast_to_names(spark):
    names = ["red rod", "rod", "gear box", "gear"]
    rows = [(k % 3, f"the {names[k % 4]} by the {names[k % 3]}", names[k % 4]) for k in range(60)]
    table = spark.createDataFrame(rows, "k long, text string, category string")
    found = keyframes.mentions(table, table)
    want = {}
    for k, text, _ in rows:
        for name in names:
            n = sum(text.split()[i : i + len(name.split())] == name.split() for i in range(len(text.split())))
            if n:
                want[k, name] = want.get((k, name), 0) + n
    assert {(r.k, r.category): r.n for r in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan and "leftHint=(strategy=broadcast)" not in plan, plan


def test_neighbours_are_summed_where_they_meet(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(k % 40, k % 390, *(rng.random() for _ in range(3))) for k in range(400)]  # some points have the same identifier
    feats = {o: [float(o), 1.0 / (o + 1)] for o in range(12)}
    points = spark.createDataFrame(rows, "obj_id long, pt long, x double, y double, z double")
    features = spark.createDataFrame([*feats.items()], "obj_id long, feat array<double>")
    want = {}
    for o, pt, *at in rows:
        want[pt] = want.get(pt, []) + [feats[q] for q, _, *to in rows if q in feats and o % 20 == 0 and sum((a - b) ** 2 for a, b in zip(at, to)) <= 0.09]
    for numbers in (1000, 8):
        monkeypatch.setattr(P, "NUMBERS", numbers, raising=False)
        found = P.blended_features(points, points.where("obj_id % 20 = 0"), features, 0.3)
        got = {r.pt: list(r.feat) for r in found.collect()}
        assert got.keys() == {pt for pt, near in want.items() if near}
        assert all(abs(a - sum(c) / len(want[pt])) < 1e-9 for pt in got for a, c in zip(got[pt], zip(*want[pt])))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert not [line for line in plan.splitlines() if re.search(r"Exchange hashpartitioning\(pt#\d+L?, \w*obj", line)], plan


@pytest.mark.parametrize("n, two", [(2, False), (3, False), (3, True), (2, True)])
def test_sweeps_against_all_pairs(spark, monkeypatch, n, two):
    rng = random.Random(n + 2 * two)
    rows = [(k, [float(k), -1.0], *(rng.choice((0.0, 1.0, rng.uniform(-2, 2))) for _ in range(n)), *(rng.choice((0.0, 0.1, 0.5, 3.0)) for _ in range(n))) for k in range(300)]
    at, ext = [f"p{k}" for k in range(n)], [f"e{k}" for k in range(n)]
    table = spark.createDataFrame(rows, "id long, v array<double>, " + ", ".join(f"{c} double" for c in (*at, *ext))).repartition(3)
    box = tuple(F.col(c) for c in at), tuple(F.col(c) + F.col(e) for c, e in zip(at, ext))
    left, right = (table.where("id % 3 = 0"), table.where("id % 3 > 0")) if two else (table, None)
    monkeypatch.setattr(sweeps, "BLOCK", 16)
    monkeypatch.setattr(sweeps, "HELD", 40)
    measure = lambda: lambda a, b: {"i": a["id"], "j": b["id"], "s": a["v"][:, 0] * b["v"][:, 1], "w": a["e0"]}
    got = sweeps.swept(left, right, box, box if two else None, measure, "i long, j long, s double, w double").collect()
    meet = lambda a, b: all(a[2 + k] <= b[2 + k] + b[2 + n + k] and b[2 + k] <= a[2 + k] + a[2 + n + k] for k in range(n))
    if two:
        assert sorted((r.i, r.j) for r in got) == sorted((a[0], b[0]) for a in rows for b in rows if a[0] % 3 == 0 < b[0] % 3 and meet(a, b))
    else:
        assert sorted(tuple(sorted((r.i, r.j))) for r in got) == sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and meet(a, b))
    assert all(r.s == -r.i and r.w == rows[r.i][2 + n] for r in got)
    assert sweeps.swept(left.limit(0), right, box, box if two else None, measure, "i long, j long, s double, w double").count() == 0


@pytest.mark.parametrize("k", [7, 40, 5000])
def test_most_overlapping_pairs_with_ties(spark, monkeypatch, k):
    rng = random.Random(k)
    rows = [(o, *(round(rng.uniform(0, 2), 1) for _ in range(3)), *(rng.choice((0.1, 0.2, 0.6)) for _ in range(3))) for o in range(160)]
    table = spark.createDataFrame(rows, "obj_id long, cx double, cy double, cz double, ex double, ey double, ez double").repartition(3)
    monkeypatch.setattr(sweeps, "BLOCK", 16)
    every = overlaps.box_overlaps(table, "va", both=True).select("i", "j", F.round(F.col("inter") / F.col("va"), 9).alias("ratio"))
    want = sorted(map(tuple, every.collect()), key=lambda r: (-r[2], r[0], r[1]))
    volume = lambda a, b: np.prod([max(0.0, min(a[c] + a[c + 3] / 2, b[c] + b[c + 3] / 2) - max(a[c] - a[c + 3] / 2, b[c] - b[c + 3] / 2)) for c in (1, 2, 3)])
    assert sorted(r[:2] for r in want) == sorted((a[0], b[0]) for a in rows for b in rows if a != b and volume(a, b) > 1e-9)
    assert list(map(tuple, overlaps.most_overlapping(table, k).collect())) == want[:k]
    plan = every._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan, plan  # pairs are no rows of a join


@pytest.mark.parametrize("how", [{"threshold": 1.05}, {"threshold": 0.1, "meeting": True}, {"threshold": 0.055, "bias": 0.95, "penalty": 0.002}, {"threshold": 0.01, "bias": 1.0}])
def test_matches_are_found_without_a_join_of_pairs(spark, monkeypatch, how):
    rng = random.Random(12)

    def row(o):
        feat = [rng.uniform(-1, 1) for _ in range(3 if o % 19 else 2)]
        return o, *(rng.uniform(0, 1.5) for _ in range(3)), *(rng.choice((0.2, 0.5)) for _ in range(3)), None if o % 17 == 0 else [0.0] * 3 if o % 23 == 0 else feat, rng.choice((0, 1, None))

    rows = [row(o) for o in range(160)]
    table = spark.createDataFrame(rows, "obj_id long, cx double, cy double, cz double, ex double, ey double, ez double, feat array<double>, contained int").repartition(3)
    d, o = table.where("obj_id < 50"), table.where("obj_id >= 50")
    monkeypatch.setattr(sweeps, "BLOCK", 16)
    bias, want = how.get("bias", 0.0), {r[0]: (None, None) for r in rows[:50]}
    for a in rows[:50]:
        for b in rows[50:]:
            inter = np.prod([max(0.0, min(a[c] + a[c + 3] / 2, b[c] + b[c + 3] / 2) - max(a[c] - a[c + 3] / 2, b[c] - b[c + 3] / 2)) for c in (1, 2, 3)])
            if not inter or not a[7] or not b[7] or len(a[7]) != len(b[7]) or not any(a[7]) or not any(b[7]):
                continue
            sim = (1 + bias) * inter / (np.prod(a[4:7]) + np.prod(b[4:7]) - inter) + (1 - bias) * np.dot(a[7], b[7]) / np.linalg.norm(a[7]) / np.linalg.norm(b[7])
            sim -= how.get("penalty", 0.0) * (None not in (a[8], b[8]) and a[8] != b[8])
            if sim >= how["threshold"] and (want[a[0]][0] is None or sim > want[a[0]][1]):
                want[a[0]] = b[0], sim
    found = mapping.match_detections(d, o, **how)
    got = {r.det_id: (r.obj_id, r.sim) for r in found.collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and any(v[0] for v in got.values())
    assert all(v[1] is None or abs(v[1] - want[k][1]) < 1e-6 for k, v in got.items())
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # the detections without a match


def test_spanning_trees_of_boxes_keep_few_edges(spark, monkeypatch):
    rng = random.Random(13)
    rows = [(o, *(round(rng.uniform(0, 0.9), 1) for _ in range(3)), *(rng.choice((0.1, 0.2, 0.3)) for _ in range(3))) for o in range(200)]
    table = spark.createDataFrame(rows, "obj_id long, cx double, cy double, cz double, ex double, ey double, ez double").repartition(3)
    edges = overlaps.box_overlaps(table, "va", "vb").select("i", "j", F.round(F.greatest(F.col("inter") / F.col("va"), F.col("inter") / F.col("vb")) + 1e-9, 6).alias("w")).collect()
    tree, want = list(range(200)), []
    for e in sorted(edges, key=lambda e: (e.w, e.i, e.j)):
        a, b = sorted((tree[e.i], tree[e.j]))
        if a != b:
            tree = [a if x == b else x for x in tree]
            want.append((e.i, e.j, e.w))
    at, nodes, least = overlaps.smallest_forest(*(np.array(c) for c in zip(*edges)))
    assert dict(zip(nodes.tolist(), least.tolist())) == {k: tree[k] for k in nodes.tolist()}
    assert sorted(tuple(edges[k]) for k in at) == sorted(want)
    for most, few in ((64, 100), (10_000, 10_000)):
        monkeypatch.setattr(overlaps, "EDGES", most)
        monkeypatch.setattr(graph, "FEW", few)
        got = graph.box_spanning_trees(table).collect()
        assert sorted((r.component, r.i, r.j, r.w) for r in got) == sorted((tree[i], i, j, w) for i, j, w in want)
    assert overlaps.overlap_forests(table).count() < len(edges) / 2


def test_equal_boxes_of_a_view_form_no_pairs(spark, monkeypatch):
    rng = random.Random(14)
    kinds = [(float(x), float(y), float(x + rng.choice((0, 40, 160, 300))), float(y + rng.choice((40, 90, 200)))) for x, y in ((rng.randrange(0, 400, 20), rng.randrange(0, 200, 20)) for _ in range(25))]
    rows = [(k % 2, k % 190, *rng.choice(kinds)) for k in range(200)] * 2 + [(0, 500, None, 0.0, 1.0, 1.0)]
    table = spark.createDataFrame(rows, "view_id long, det long, x1 double, y1 double, x2 double, y2 double").repartition(3)
    want = {}
    for v, d, *a in rows:
        want.setdefault((v, d), 0)
        for u, e, *b in rows if None not in a else ():
            if v == u and d != e and None not in b:
                inter = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
                want[v, d] += inter > 0.95 * (a[2] - a[0]) * (a[3] - a[1])
    met, pairs = [], mapping.box_pairs
    monkeypatch.setattr(mapping, "box_pairs", lambda f, *how, **more: met.append(f.count()) or pairs(f, *how, **more))
    got = mapping.contained_counts(table).collect()
    assert len(got) == len(rows) and all(r.n == want[r.view_id, r.det] for r in got) and any(want.values())
    assert met[0] < 60  # 401 rows


def test_near_pairs_are_no_rows_of_a_join(spark):
    rng = random.Random(15)
    rows = [(k % 140, *(round(rng.uniform(-1, 1), 1) for _ in range(3))) for k in range(150)] + [(200, None, 0.0, 0.0)]
    table = spark.createDataFrame(rows, "o long, x double, y double, z double").repartition(3)
    found = sweeps.near_pairs(table, ("x", "y", "z"), 0.55, lambda a, b, far: {"i": a["o"], "j": b["o"], "far": far}, "i long, j long, far double")
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a[1:], b[1:])) ** 0.5
    want = [(*sorted((a[0], b[0])), far(a, b)) for k, a in enumerate(rows[:150]) for b in rows[:k] if far(a, b) <= 0.55]
    got = [(*sorted((r.i, r.j)), r.far) for r in found.collect()]
    assert [r[:2] for r in sorted(got)] == [r[:2] for r in sorted(want)] and np.allclose(sorted(r[2] for r in got), sorted(r[2] for r in want))
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
