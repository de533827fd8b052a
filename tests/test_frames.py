"""Folders of scenes by layout, whole scenes, clouds and trajectories as files."""

import json

import numpy as np
import pytest

from stratascene.sources import frames, poses, sinks

FLIP = np.diag([1.0, -1.0, -1.0, 1.0])


def _matrix(k):
    m = np.eye(4)
    m[0, 1], m[:3, 3] = 0.5, (k, 2 * k, 3)
    return m


def _text(m):
    return "\n".join(" ".join(map(str, row)) for row in m)


def _images(root, *names):
    for n in names:
        (root / n).parent.mkdir(parents=True, exist_ok=True)
        (root / n).write_bytes(b"")


def _read(spark, root, layout, **options):
    return {r.frame_id: r for r in spark.read.format("scene_frames").options(layout=layout, **options).load(str(root)).collect()}


def _scene(root, layout, n):
    """A scene of ``n`` frames; the matrices that it should have."""
    want = [FLIP @ _matrix(k) @ FLIP.T for k in range(n)]
    if layout in ("scannet", "hm3d-openeqa"):
        folder, image = ("pose/", "color/{}.jpg") if layout == "scannet" else ("", "{}-rgb.png")
        for k in range(n):
            _images(root, image.format(k))
            (root / folder).mkdir(exist_ok=True)
            (root / f"{folder}{k}.txt").write_text(_text(_matrix(k)))
        return want if layout == "hm3d-openeqa" else [_matrix(k) for k in range(n)]
    if layout == "realsense":
        (root / "poses").mkdir()
        for k in range(n):
            _images(root, f"rgb/{k}.jpg", f"depth/{k}.png")
            np.save(root / "poses" / f"{k}.npy", _matrix(k).astype("float32"))
        return want
    if layout == "hm3d":
        for k in range(n):
            _images(root, f"{k}_rgb.png")
            (root / f"{k}.json").write_text(json.dumps({"pose": _matrix(k).tolist()}))
        return want
    if layout == "azure":
        _images(root, *(f"color/{k}.jpg" for k in range(n)))
        (root / "poses.log").write_text("\n".join(f"{k} {k + 1}\n{_text(_matrix(k))}" for k in range(n)))
        return [_matrix(k) for k in range(n)]
    if layout == "icl":
        _images(root, *(f"rgb/{k}.png" for k in range(n)))
        (root / "traj.gt.sim").write_text("\n\n".join("\n".join(_text(_matrix(k)).split("\n")[:3]) for k in range(n)))
        return [np.array([*_matrix(k)[:3], [0, 0, 0, 3]]) for k in range(n)]
    if layout == "multiscan":  # three poses for each image
        _images(root, *(f"outputs/color/{k}.png" for k in range(n)))
        (root / "poses.jsonl").write_text("\n".join(json.dumps({"transform": (2 * _matrix(k / 3)).ravel(order="F").tolist()}) for k in range(3 * n)))
        return [_matrix(k) @ FLIP for k in range(n)]
    _images(root, *(f"results/frame{k:06d}.jpg" for k in range(n)))
    (root / "traj.txt").write_text("\n".join(_text(_matrix(k)).replace("\n", " ") for k in range(n)))
    return [_matrix(k) for k in range(n)]


@pytest.mark.parametrize("layout", ["replica", "icl", "scannet", "azure", "realsense", "multiscan", "hm3d", "hm3d-openeqa"])
def test_layouts(spark, tmp_path, layout):
    frames.register_frames(spark)
    want = _scene(tmp_path, layout, 23)
    got = _read(spark, tmp_path, layout, frames=5)
    assert sorted(got) == list(range(23))
    for k, m in enumerate(want):
        assert np.allclose(np.array(got[k].pose).reshape(4, 4), m) and f"{k}" in got[k].colour
    some = _read(spark, tmp_path, layout, start=2, end=20, stride=4, frames=2)
    assert sorted(some) == [2, 6, 10, 14, 18] and all(some[k].pose == got[k].pose for k in some)


def test_ranges_reach_the_reader(spark, tmp_path):
    frames.register_frames(spark)
    _scene(tmp_path, "scannet", 30)
    read = lambda **o: spark.read.format("scene_frames").options(layout="scannet", frames=4, stride=2, **o).load(str(tmp_path))
    assert read().rdd.getNumPartitions() == 4 and read(start=10, end=22).rdd.getNumPartitions() == 2
    table = read(start=10, end=22)
    assert sorted(r.frame_id for r in table.where("frame_id > 11").collect()) == [12, 14, 16, 18, 20] and table.count() == 6
    with pytest.raises(Exception, match="unknown scene layout"):
        spark.read.format("scene_frames").options(layout="none such").load(str(tmp_path)).count()
    assert spark.read.format("scene_frames").options(layout="scannet").load(str(tmp_path / "nothing")).count() == 0


def test_own_layouts(spark, tmp_path):
    class Centimetres(frames.ScanNet):
        def pose(self, data):
            m = super().pose(data)
            m[:3, 3] /= 100
            return m

    class Csv(frames.Layout):
        colour, trajectory = "img/*.png", "track.csv"

        def pose_of_lines(self, lines):
            import numpy

            m = numpy.eye(4)
            m[:3, 3] = [float(v) for v in lines[0].split(",")]
            return m

    frames.register_frames(spark, centimetres=Centimetres, csv=Csv)
    _scene(tmp_path, "scannet", 4)
    assert _read(spark, tmp_path, "centimetres")[3].pose[3::4] == [0.03, 0.06, 0.03, 1.0]
    _images(tmp_path, "img/9.png", "img/10.png")
    (tmp_path / "track.csv").write_text("1,2,3\n4,5,6\n")
    got = _read(spark, tmp_path, "csv")
    assert [(got[k].colour, got[k].pose[3::4]) for k in (0, 1)] == [("img/9.png", [1.0, 2.0, 3.0, 1.0]), ("img/10.png", [4.0, 5.0, 6.0, 1.0])]


def test_trajectory_scene_and_cloud(spark, tmp_path):
    frames.register_frames(spark)
    m = spark.createDataFrame([(k, _matrix(k).ravel().tolist()) for k in range(50)], "frame_id long, m array<double>").repartition(5)
    poses.write_trajectory(m, str(tmp_path / "s" / "traj.txt"))
    got = _read(spark, tmp_path / "s", "replica", frames=7)
    assert len(got) == 50 and all(np.allclose(np.array(got[k].pose).reshape(4, 4), _matrix(k)) for k in range(50))
    objects = spark.createDataFrame([(1, "cup"), (2, "mug")], "obj_id long, category string")
    regions = spark.createDataFrame([(0, [0.5, 1.0])], "region long, feat array<double>")
    members = spark.createDataFrame([(1, 0)], "obj_id long, region long")
    edges = spark.createDataFrame([(1, 2, "a on b"), (2, 1, None)], "i long, j long, relation string")
    sinks.write_scene(str(tmp_path / "w"), objects, regions, members, edges)
    back = sinks.read_scene(spark, str(tmp_path / "w"))
    for name, table in (("objects", objects), ("regions", regions), ("members", members), ("edges", edges)):
        assert sorted(map(str, back[name].collect())) == sorted(map(str, table.collect()))
    points = spark.createDataFrame([(k, k % 3, 0.0, 1.0, 2.0) for k in range(9)], "pt long, obj_id long, x double, y double, z double")
    sinks.write_cloud(points, spark.createDataFrame([(0, [0.5]), (1, None)], "obj_id long, feat array<double>"), str(tmp_path / "c"))
    assert sorted(r.pt for r in sinks.read_cloud(spark, str(tmp_path / "c")).collect()) == [0, 3, 6]
    assert {r.pt: r.has_feat for r in sinks.read_cloud(spark, str(tmp_path / "c"), dense=False).collect()} == {k: k % 3 == 0 for k in range(9)}
