"""Hand-computed cases of the spatial kernels and plans."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratascene.functions import boxes
from stratascene.functions.relations import between, canonical, inside, relation
from stratascene.operators import mapping
from stratascene.operators.graph import components, spanning_trees
from stratascene.operators.retrieval import segmentation_metrics
from stratascene.plans.grounding import Grounding, Node, Select, spatial_query
from stratascene.sources.poses import frame_range, read_poses

CASES = [
    ("on_top_of", (0.3, 0, 0.15), True, 0.44), ("on_top_of", (0.6, 0, 0.2), False, None), ("above", (0.6, 0, 0.5), True, 0.45), ("below", (0, 0.5, -0.4), True, 0.45), ("next_to", (0.6, 0, 0), True, 0.4),
    ("near", (1, 0, 0), True, 0.5), ("against", (0.25, 0, 0), True, 0.5), ("in_front_of", (0.5, 1, 0), True, 0.25), ("in_front_of", (1.5, 1, 0), False, None), ("left_of", (-1, 0.5, 0), True, 0.5),
]


@pytest.mark.parametrize("name,d,ok,score", CASES)
def test_relation(spark, name, d, ok, score):
    got_ok, got = relation(name, tuple(F.lit(float(x)) for x in d))
    row = spark.range(1).select(got_ok.alias("ok"), got.alias("score")).first()
    assert row.ok == ok and (not ok or abs(row.score - score) < 1e-9)


def _point(*v):
    return tuple(F.lit(float(x)) for x in v)


def test_between_and_inside(spark):
    ok, score = between(_point(1, 0.6, 0), _point(0, 0, 0), _point(4, 0, 0))
    ok2, score2 = inside(_point(1, 1.5, 1), _point(1, 1, 1), _point(2, 2, 2))
    same, _ = between(_point(1, 1, 1), _point(2, 2, 2), _point(2, 2, 2))
    r = spark.range(1).select(ok.alias("a"), score.alias("b"), ok2.alias("c"), score2.alias("d"), same.alias("e")).first()
    assert (r.a, r.c, r.e) == (True, True, False) and abs(r.b - 0.5) < 1e-9 and abs(r.d - 0.833333) < 1e-5


def test_boxes(spark):
    a, b = boxes.corners(_point(1, 1, 1), _point(2, 2, 2)), boxes.corners(_point(2, 2, 2), _point(2, 2, 2))
    r = spark.range(1).select(boxes.iou(a, b).alias("i"), boxes.giou(a, b).alias("g")).first()
    assert abs(r.i - 0.066667) < 1e-6 and abs(r.g + 0.377778) < 1e-6


def test_metrics(spark):
    m = spark.createDataFrame([(0, 0, 3), (0, 1, 1), (1, 0, 2), (1, 1, 4)], "gt int, pred int, n long")
    rows = {r.class_id: r for r in segmentation_metrics(m).collect()}
    assert [round(rows[k].iou, 6) for k in (0, 1)] == [0.5, 0.571429]
    assert [round(rows[k].recall, 6) for k in (0, 1)] == [0.75, 0.666667] and [round(rows[k].precision, 6) for k in (0, 1)] == [0.6, 0.8]


@pytest.fixture(scope="module")
def scene(spark):
    rows = [(1, "bolt", "red", 0.0, 0.0, 0.0), (2, "bolt", "blue", 5.0, 0.0, 0.0), (3, "anvil", "old", 0.5, 0.0, 0.0), (4, "rod", "new", 9.0, 9.0, 0.0)]
    return spark.createDataFrame([(*r, 0.1 * r[0], 0.1, 0.1) for r in rows], "obj_id long, category string, attr string, cx double, cy double, cz double, ex double, ey double, ez double").cache()


def ids(df):
    return sorted(r.obj_id for r in df.collect())


def test_grounding(scene):
    g = Grounding(scene)
    assert ids(g.best(spatial_query("bolt", "near", "anvil"))) == [1]
    assert ids(g.answers(spatial_query("bolt", "near", "unicorn"))) == [1, 2]
    assert ids(g.answers(Node("bolt", ("purple",)))) == [1, 2]
    assert ids(g.answers(Node("bolt", ("red",)))) == [1]
    assert ids(g.answers(Node("bolt", select=Select("ordinal", "x", "asc", 4)))) == []
    assert ids(g.answers(Node("bolt", select=Select("superlative", "size", "max")))) == [2]
    assert ids(g.answers(Node("bolt", (), (("between", (Node("anvil"), Node("rod"))),)))) == [2]
    with pytest.raises(ValueError):
        Select("ordinal", "x")


def test_aliases():
    assert canonical("In Front Of") == "in_front_of" and canonical("beside") == "next_to" and canonical("orbiting") is None


def test_components_and_trees(spark):
    nodes = spark.createDataFrame([(k,) for k in range(1, 8)], "obj_id long")
    edges = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.1), (1, 3, 0.2), (5, 6, 0.3)], "i long, j long, w double")
    labels = components(nodes, edges)
    assert {r.obj_id: r.component for r in labels.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7}
    assert sorted((r.i, r.j) for r in spanning_trees(edges, labels).collect()) == [(1, 3), (2, 3), (5, 6)]


def test_suppress():
    f = pd.DataFrame({"det": [1, 2, 3], "conf": [0.9, 0.8, 0.7], "x1": [0, 1, 20], "y1": [0, 1, 20], "x2": [10, 11, 30], "y2": [10, 11, 30]})
    assert mapping.suppress(f)["det"].tolist() == [1, 3]


def test_pose_layouts(spark, tmp_path):
    eye = "1 0 0 1 0 1 0 2 0 0 1 3 0 0 0 1"
    (tmp_path / "rows.txt").write_text(f"{eye}\n{eye}\n")
    (tmp_path / "blocks.txt").write_text("1 0 0 1\n0 1 0 2\n0 0 1 3\n0 0 0 1\n")
    (tmp_path / "quat.txt").write_text("1 2 3 1 0 0 0\n")
    want = [float(x) for x in eye.split()]
    assert [r.m for r in read_poses(spark, str(tmp_path / "rows.txt"), "rows").collect()] == [want, want]
    assert [r.m for r in read_poses(spark, str(tmp_path / "blocks.txt"), "blocks").collect()] == [want]
    assert [r.m for r in read_poses(spark, str(tmp_path / "quat.txt"), "quaternions").collect()] == [want]
    frames = spark.range(10).withColumnRenamed("id", "frame_id")
    assert [r.frame_id for r in frame_range(frames, 1, 8, 3).orderBy("frame_id").collect()] == [1, 4, 7]
    with pytest.raises(ValueError):
        read_poses(spark, "x", "unknown")


def test_match_by_looks_alone(spark):
    """A threshold that visual similarity can reach: the best object needn't meet the detection's box."""
    schema = "obj_id long, cx double, cy double, cz double, ex double, ey double, ez double, feat array<double>, contained int"
    box = (1.0, 1.0, 1.0)
    d = spark.createDataFrame([(1, 0.0, 0.0, 0.0, *box, [1.0, 0.0], 0), (3, 50.0, 0.0, 0.0, *box, [0.0, 1.0], 0)], schema)
    o = spark.createDataFrame([(2, 0.9, 0.0, 0.0, *box, [0.2, 1.0], 0), (4, 90.0, 0.0, 0.0, *box, [1.0, 0.0], 0), (6, 90.0, 0.0, 0.0, *box, [1.0, 0.0], 0)], schema)
    assert {r.det_id: r.obj_id for r in mapping.match_detections(d, o, threshold=0.1).collect()} == {1: 4, 3: 2}
    assert {r.det_id: r.obj_id for r in mapping.match_detections(d, o, threshold=0.1, meeting=True).collect()} == {1: 2, 3: None}
    assert {r.obj_id for r in mapping.match_detections(d, o).collect()} == {None}


def test_trees_nms_and_merging_gather_no_group(spark, monkeypatch):
    """Against plain Python, with no group handed to a function as a whole."""
    from pyspark.sql.group import GroupedData

    def whole(*_):
        raise AssertionError("a whole group in one task")

    r = np.random.default_rng(4)
    e = pd.DataFrame({"i": r.integers(0, 40, 200), "j": r.integers(0, 40, 200), "w": np.round(r.random(200), 1)}).drop_duplicates(["i", "j"])
    e = e[e.i < e.j]
    f = pd.DataFrame({"view_id": r.integers(0, 3, 300), "det": range(300), "conf": np.round(r.random(300), 1), "x1": r.random(300) * 60, "y1": r.random(300) * 60})
    f["x2"], f["y2"] = f.x1 + 3 + 40 * r.random(300) ** 3, f.y1 + 3 + 40 * r.random(300) ** 3
    f.loc[250:, ["x1", "x2", "y1", "y2"]] = [5.0, 15.0, 5.0, 15.0]
    parent = list(range(40))

    def find(x):
        return x if parent[x] == x else find(parent[x])

    want = []
    for row in e.sort_values(["w", "i", "j"]).itertuples():
        if find(row.i) != find(row.j):
            parent[find(row.i)] = find(row.j)
            want.append((row.i, row.j))
    monkeypatch.setattr(GroupedData, "applyInPandas", whole)
    edges = spark.createDataFrame(e)
    got = spanning_trees(edges, components(spark.range(40).withColumnRenamed("id", "obj_id"), edges))
    assert sorted((x.i, x.j) for x in got.collect()) == sorted(want)
    kept = sorted(d for _, g in f.groupby("view_id") for d in mapping.suppress(g)["det"])
    assert sorted(x.det for x in mapping.non_maximum_suppression(spark.createDataFrame(f)).collect()) == kept
    c = spark.createDataFrame([(k % 2, k, 1 + k % 3, [1.0 * k, 1.0]) for k in range(1, 60)], "obj_id long, seq long, n long, feat array<double>")
    for x in mapping.merge_features(c.repartition(3)).collect():
        total, v = 0, np.zeros(2)
        for k in range(1, 60):
            if k % 2 == x.obj_id:
                v = (v * total + np.array([1.0 * k, 1.0]) * (1 + k % 3)) / (total + 1 + k % 3)
                v, total = v / np.linalg.norm(v), total + 1 + k % 3
        assert x.n == total and np.allclose(x.feat, v)
