"""Map fusion against a plain loop, as a batch and as a stream that is stopped and goes on."""

import math
import random

import pytest

from stratascene.operators import fusion
from stratascene.streaming import fusion as streams

R = random.Random(2)
SCHEMA = "scene_id long, frame_id long, det long, category string, points long, lo array<double>, hi array<double>, feat array<double>, contained boolean, ts timestamp"
RULES = fusion.Rules(threshold=1.1, bias=0.1, penalty=0.05, background=("wall",), filter_every=3, least_points=4, least_detections=2, merge_every=4, merge_share=0.3, merge_alike=0.5)


def _rows(scenes=3, frames=11):
    out = []
    for scene in range(scenes):
        things = [([R.uniform(0, 2) for _ in range(3)], [R.gauss(0, 1) for _ in range(4)]) for _ in range(9)]
        for frame in range(frames):
            for k in range(R.choice([0, 1, 4, 7])):
                at, feat = R.choice(things)
                lo = [x + R.uniform(-0.15, 0.15) for x in at]
                out.append((scene, frame, frame * 100 + k, R.choice(["wall", "cup", "mug", "mug"]), R.randint(1, 4), lo, [x + R.uniform(0.4, 1.0) for x in lo], [x + R.gauss(0, 0.2) for x in feat], R.random() < 0.3))
    return out


def _join(a, b):
    n = a["n"] + b["n"]
    f = [(x * a["n"] + y * b["n"]) / n for x, y in zip(a["f"], b["f"])]
    size = max(math.sqrt(sum(x * x for x in f)), 1e-8)
    return {**a, "n": n, "p": a["p"] + b["p"], "f": [x / size for x in f], "lo": list(map(min, a["lo"], b["lo"])), "hi": list(map(max, a["hi"], b["hi"])), "names": a["names"] + b["names"], "first": min(a["first"], b["first"]), "last": max(a["last"], b["last"])}


def _meet(a, b):
    return math.prod(max(0, min(h, k) - max(x, y)) for x, h, y, k in zip(a["lo"], a["hi"], b["lo"], b["hi"]))


def _size(a):
    return math.prod(h - x for x, h in zip(a["lo"], a["hi"]))


def _cosine(a, b):
    return sum(x * y for x, y in zip(a["f"], b["f"])) / math.sqrt(sum(x * x for x in a["f"]) * sum(x * x for x in b["f"]))


def _loop(rows, r):
    """Maps after every frame: (scene, frame) -> objects."""
    out = {}
    for scene in sorted({x[0] for x in rows}):
        objects, walls, seen = [], {}, 0
        for frame in sorted({x[1] for x in rows if x[0] == scene}):
            new = [{"id": d, "names": [c], "n": 1, "p": p, "lo": lo, "hi": hi, "f": f, "in": i, "first": frame, "last": frame} for s, t, d, c, p, lo, hi, f, i in sorted(x[:9] for x in rows) if (s, t) == (scene, frame)]
            for d in [d for d in new if d["names"][0] in r.background]:
                walls[d["names"][0]] = _join(walls[d["names"][0]], d) if d["names"][0] in walls else d
            new = [d for d in new if d["names"][0] not in r.background]
            if new:
                seen += 1
                if not objects:
                    objects = new
                else:
                    before, objects = list(objects), list(objects)
                    for d in new:
                        best, score = None, r.threshold
                        for k, o in enumerate(before):
                            inter = _meet(d, o)
                            s = round((1 + r.bias) * inter / (_size(d) + _size(o) - inter) + (1 - r.bias) * _cosine(d, o) - (r.penalty if d["in"] != o["in"] else 0), 9)
                            if s >= r.threshold and (best is None or s > score):
                                best, score = k, s
                        if best is None:
                            objects.append(d)
                        else:
                            objects[best] = _join(objects[best], d)
                    if r.filter_every and seen % r.filter_every == 0:
                        objects = [o for o in objects if o["p"] >= r.least_points and o["n"] >= r.least_detections]
                    if r.merge_every and seen % r.merge_every == 0:
                        pairs = sorted((-_meet(a, b) / _size(a), i, j) for i, a in enumerate(objects) for j, b in enumerate(objects) if i != j and _meet(a, b) / _size(a) > r.merge_share and _cosine(a, b) > r.merge_alike)
                        gone = set()
                        for _, i, j in pairs:
                            if j not in gone:
                                objects[j] = _join(objects[j], objects[i])
                                gone.add(i)
                        objects = [o for k, o in enumerate(objects) if k not in gone]
            out[scene, frame] = _plain(objects, walls)
    return out


def _plain(objects, walls):
    return sorted((o["id"], wall, tuple(sorted(o["names"])), o["n"], o["p"], o["first"], o["last"], *(round(x, 6) for x in (*o["lo"], *o["hi"], *o["f"]))) for wall, os in ((False, objects), (True, walls.values())) for o in os)


def _maps(rows):
    out = {}
    for r in rows:
        names = tuple(sorted(c for c, v in zip(r.categories, r.votes) for _ in range(v)))
        out.setdefault((r.scene_id, r.frame_id), []).append((r.object, r.background, names, r.n, r.points, r.first_frame, r.last_frame, *(round(x, 6) for x in (*r.lo, *r.hi, *r.feat))))
    return {k: sorted(v) for k, v in out.items()}


def _stamped(rows):
    from datetime import datetime, timedelta

    return [(*r, datetime(2020, 1, 1) + timedelta(seconds=r[1])) for r in rows]


@pytest.mark.parametrize("rules", [RULES, fusion.Rules(), fusion.Rules(threshold=0.4, bias=-0.5, filter_every=1), fusion.Rules(threshold=1.1, merge_every=3, merge_share=0.2, merge_alike=-1.0)])
def test_batch(spark, rules):
    rows = _rows()
    table = spark.createDataFrame(_stamped(rows), SCHEMA).repartition(5)
    want = {k: v for k, v in _loop(rows, rules).items() if v}
    assert _maps(fusion.fused_map(table, rules, every_frame=True).collect()) == want
    last = {s: max(t for z, t, *_ in rows if z == s) for s, *_ in rows}
    assert _maps(fusion.fused_map(table, rules).collect()) == {k: v for k, v in want.items() if last[k[0]] == k[1]}
    assert fusion.fused_map(table.limit(0), rules).count() == 0


def _written(spark, folder, name, rows):
    spark.createDataFrame(_stamped(rows), SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def _stream(spark, folder):
    return streams.with_state_store(spark).readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def test_stream_stopped_and_resumed(spark, tmp_path):
    rows = _rows(2, 8)
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    order = sorted(rows, key=lambda r: r[1] + R.choice([0, 0, 1.5]))  # some frames come up to two seconds late
    parts = [[r for k, r in enumerate(order) if k * 5 // len(order) == part] for part in range(5)]
    end = [(9, 1000, 1, "cup", 1, [0.0] * 3, [1.0] * 3, [1.0] * 4, False)]  # lets the watermark pass all frames

    def run(*files):
        for part in files:
            _written(spark, source, "rows", part)
            query = streams.snapshot_sink(streams.fused_stream(_stream(spark, source), RULES, late="3 seconds"), out, checkpoint).start()
            query.processAllAvailable()
            query.stop()

    run(parts[0] + parts[1])
    run(parts[2])
    run(parts[3] + parts[4], end)
    got = [r for r in streams.read_snapshots(spark, out).collect() if r.scene_id != 9]
    assert len(got) == len({(r.scene_id, r.frame_id, r.object) for r in got})
    want = {k: v for k, v in _loop(rows, RULES).items() if v}
    assert _maps(got) == want
    table = streams.read_snapshots(spark, out).where("scene_id <> 9")
    assert _maps(streams.last_snapshots(table).collect()) == _maps(fusion.fused_map(spark.createDataFrame(_stamped(rows), SCHEMA), RULES).collect())


def test_idle_scenes_are_forgotten(spark, tmp_path):
    row = lambda frame: (1, frame, frame, "cup", 1, [0.0] * 3, [1.0] * 3, [1.0] * 4, False)
    other = lambda frame: (2, frame, frame, "cup", 1, [0.0] * 3, [1.0] * 3, [1.0] * 4, False)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    query = None
    for part in ([row(0)], [row(1)], [other(2)], [other(30)], [other(31)], [row(40)], [other(60)], [other(61)]):
        _written(spark, source, "rows", part)
        query = streams.snapshot_sink(streams.fused_stream(_stream(spark, source), idle_ms=10_000), out, str(tmp_path / "c")).start()
        query.processAllAvailable()
        query.stop()
    got = {(r.scene_id, r.frame_id): r.n for r in streams.read_snapshots(spark, out).collect()}
    assert got[1, 1] == 2 and got[1, 40] == 1 and got[2, 30] == 1
