"""The object map of a scene, fused frame by frame: matching, merging, background classes, and upkeep every so many frames.

Detections of a frame are held against the objects as they stood before it, and merged in their order. The order of frames matters, so that a
scene is one sequence and scenes are what runs in parallel; a task holds the objects of one scene, never its detections.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rules:
    """How detections match objects, and how the map is kept."""

    #: ``(1 + bias) * IoU + (1 - bias) * cosine``, less ``penalty`` where one of the two is contained in others, must reach ``threshold``.
    threshold: float = 1.2
    bias: float = 0.0
    penalty: float = 0.0
    #: Classes of which a scene has one object each.
    background: tuple[str, ...] = ()
    #: Every so many frames (0: never) objects with fewer points or detections go ...
    filter_every: int = 0
    least_points: int = 0
    least_detections: int = 1
    #: ... and objects that lie in others, by more than this share of their box, are merged into them if their features are this alike.
    merge_every: int = 0
    merge_share: float = 0.7
    merge_alike: float = 0.7
    #: Similarities are rounded to so many digits, so that equal ones are equal however they were summed; the first object wins.
    digits: int = 9


#: An object of the map: ``object`` is the detection that started it. Classes are counted in order of appearance.
OBJECT = "object long, background boolean, categories array<string>, votes array<long>, n long, points long, lo array<double>, hi array<double>, feat array<double>, contained boolean, first_frame long, last_frame long"
FIELDS = [c.split()[0] for c in OBJECT.split(", ")]
#: What a detection needs; ``lo`` and ``hi`` are the corners of its box.
DETECTION = ("scene_id", "frame_id", "det", "category", "points", "lo", "hi", "feat", "contained")


def _merge(a: dict, b: dict) -> None:
    """``b`` goes into ``a``: counts and classes add up, the box covers both, features are weighted by detections and have unit length."""
    votes = dict(zip(a["categories"], a["votes"]))
    for c, v in zip(b["categories"], b["votes"]):
        votes[c] = votes.get(c, 0) + v
    feat = (np.asarray(a["feat"]) * a["n"] + np.asarray(b["feat"]) * b["n"]) / (a["n"] + b["n"])
    a |= {"categories": list(votes), "votes": list(votes.values()), "n": a["n"] + b["n"], "points": a["points"] + b["points"], "feat": feat / max(np.sqrt(feat @ feat), 1e-8)}
    a |= {"lo": np.minimum(a["lo"], b["lo"]), "hi": np.maximum(a["hi"], b["hi"]), "first_frame": min(a["first_frame"], b["first_frame"]), "last_frame": max(a["last_frame"], b["last_frame"])}


class SceneMap:
    """The objects of a scene in the order in which they began, with their boxes and features as matrices."""

    def __init__(self, rules: Rules, objects: Iterator[tuple] = (), frames: int = 0) -> None:
        self.rules, self.frames = rules, frames
        every = [dict(zip(FIELDS, o)) for o in objects]
        self.objects = [o for o in every if not o["background"]]
        self.background = {o["categories"][0]: o for o in every if o["background"]}
        self._stack()

    def _stack(self) -> None:
        self.lo, self.hi, self.feat = (np.array([o[c] for o in self.objects], dtype=float) for c in ("lo", "hi", "feat"))

    def rows(self) -> list[tuple]:
        return [tuple(list(o[f]) if isinstance(o[f], np.ndarray) else o[f] for f in FIELDS) for o in itertools.chain(self.objects, self.background.values())]

    def similarities(self, lo: np.ndarray, hi: np.ndarray, feat: np.ndarray, contained: np.ndarray) -> np.ndarray:
        """Detections by objects; what is below the threshold is minus infinity. Only boxes that meet are compared by features if the others can't match."""
        r = self.rules
        edges = np.minimum(hi[:, None], self.hi) - np.maximum(lo[:, None], self.lo)
        inter = np.prod(np.maximum(edges, 0), axis=2)
        iou = inter / (np.prod(hi - lo, axis=1)[:, None] + np.prod(self.hi - self.lo, axis=1) - inter + 1e-10)
        sims = np.full(inter.shape, -np.inf)
        i, j = np.nonzero(inter > 0) if r.threshold > 1 - r.bias + 1e-9 and -1 <= r.bias <= 1 and r.penalty >= 0 else np.indices(inter.shape).reshape(2, -1)
        norms = [np.sqrt(np.einsum("ij,ij->i", x, x)) for x in (feat, self.feat)]
        visual = np.einsum("ij,ij->i", feat[i], self.feat[j]) / np.maximum(norms[0][i] * norms[1][j], 1e-8)
        apart = contained[i] != np.array([o["contained"] for o in self.objects], dtype=bool)[j]
        s = np.round((1 + r.bias) * iou[i, j] + (1 - r.bias) * visual - r.penalty * apart, r.digits)
        sims[i, j] = np.where(s >= r.threshold, s, -np.inf)
        return sims

    def add(self, frame: int, detections: list[dict]) -> None:
        """Fuse a frame."""
        front = []
        for d in detections:
            o = {"object": d["det"], "background": d["category"] in self.rules.background, "categories": [d["category"]], "votes": [1], "n": 1, "points": d["points"], "lo": np.array(d["lo"]), "hi": np.array(d["hi"]), "feat": np.array(d["feat"]), "contained": d["contained"], "first_frame": frame, "last_frame": frame}
            if not o["background"]:
                front.append(o)
            elif d["category"] in self.background:
                _merge(self.background[d["category"]], o)
            else:
                self.background[d["category"]] = o
        if not front:
            return
        self.frames += 1
        if not self.objects:
            self.objects = front
            self._stack()
            return
        sims = self.similarities(*(np.array([o[c] for o in front]) for c in ("lo", "hi", "feat", "contained")))
        best = np.where(sims.max(axis=1) > -np.inf, sims.argmax(axis=1), -1)
        for o, k in zip(front, best.tolist()):
            if k < 0:
                self.objects.append(o)
            else:
                _merge(self.objects[k], o)
                self.lo[k], self.hi[k], self.feat[k] = (self.objects[k][c] for c in ("lo", "hi", "feat"))
        new = [o for o, k in zip(front, best) if k < 0]
        if new:
            self.lo, self.hi, self.feat = (np.concatenate([x, [o[c] for o in new]]) for x, c in ((self.lo, "lo"), (self.hi, "hi"), (self.feat, "feat")))
        self.upkeep()

    def upkeep(self) -> None:
        """What is due after so many frames with detections."""
        r = self.rules
        if r.filter_every and self.frames % r.filter_every == 0:
            self.objects = [o for o in self.objects if o["points"] >= r.least_points and o["n"] >= r.least_detections]
            self._stack()
        if r.merge_every and self.frames % r.merge_every == 0:
            self.merge_overlapping()

    def merge_overlapping(self) -> None:
        """Objects go into others by falling share, ties in the order of objects; features are compared as they were before any merge."""
        if len(self.objects) < 2:
            return
        r = self.rules
        edges = np.minimum(self.hi[:, None], self.hi) - np.maximum(self.lo[:, None], self.lo)
        share = np.round(np.prod(np.maximum(edges, 0), axis=2) / np.maximum(np.prod(self.hi - self.lo, axis=1)[:, None], 1e-10), r.digits)
        np.fill_diagonal(share, 0)
        i, j = np.nonzero(share > r.merge_share)
        norms = np.sqrt(np.einsum("ij,ij->i", self.feat, self.feat))
        alike = np.einsum("ij,ij->i", self.feat[i], self.feat[j]) / np.maximum(norms[i] * norms[j], 1e-8) > r.merge_alike
        i, j = i[alike], j[alike]
        gone = set()
        for a, b in zip(*(x[np.lexsort((j, i, -share[i, j]))].tolist() for x in (i, j))):
            if b not in gone:
                _merge(self.objects[b], self.objects[a])
                gone.add(a)
        self.objects = [o for k, o in enumerate(self.objects) if k not in gone]
        self._stack()


def _fold(rules: Rules, every: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["scene_id", "frame_id", *FIELDS]

        def made(scene: int, frame: int, world: SceneMap) -> pa.RecordBatch:
            rows = world.rows()
            columns = [[scene] * len(rows), [frame] * len(rows), *([r[k] for r in rows] for k in range(len(FIELDS)))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names)

        world, at, held = SceneMap(rules), None, []
        for batch in batches:
            for row in batch.to_pylist():
                key = row["scene_id"], row["frame_id"]
                if key != at and at is not None:
                    world.add(at[1], held)
                    held = []
                    if every or key[0] != at[0]:
                        yield made(*at, world)
                    if key[0] != at[0]:
                        world = SceneMap(rules)
                at = key
                held.append(row)
        if at is not None:
            world.add(at[1], held)
            yield made(*at, world)

    return run


_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.int64(), pa.int64(), *[pa.list_(pa.float64())] * 3, pa.bool_(), pa.int64(), pa.int64()]


def fused_map(detections: DataFrame, rules: Rules = Rules(), every_frame: bool = False) -> DataFrame:
    """``scene_id, frame_id`` and the objects (``OBJECT``) of each scene after its last frame, or after every frame.

    Detections (``DETECTION``) are taken by frame and ``det``. Scenes run in parallel; each passes through one task as a sorted stream.
    """
    rows = detections.select(*DETECTION).repartition("scene_id").sortWithinPartitions("scene_id", "frame_id", "det")
    return rows.mapInArrow(_fold(rules, every_frame), f"scene_id long, frame_id long, {OBJECT}")


def category_of(categories: str = "categories", votes: str = "votes"):
    """The class with the most votes, ties by name."""
    return F.sort_array(F.transform(F.arrays_zip(categories, votes), lambda x: F.struct((-x[votes]).alias("v"), x[categories].alias("c"))))[0]["c"]
