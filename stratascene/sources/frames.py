"""A data source for folders of scenes: ``spark.read.format("scene_frames")``.

Each layout says where a scene keeps its colour and depth images and its camera poses. Frames are numbered in natural order of their names;
a partition is a range of frames, and reads the poses of its own range only. ``start``, ``end`` and ``stride`` are options, as filters that Spark hands to a
Python source would stay in force for other uses of the same DataFrame.

    register_frames(spark)
    spark.read.format("scene_frames").option("layout", "scannet").option("start", 10).option("end", 200).option("stride", 5).load(folder)
"""

from __future__ import annotations

import fnmatch
import io
import itertools
import json
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "frame_id long, colour string, depth string, pose array<double>"
#: Frames of a partition.
FRAMES = 1000
#: Turns y-up axes into z-up ones, from both sides.
_FLIP = np.diag([1.0, -1.0, -1.0, 1.0])


def natural(name: str) -> list:
    """A key that orders numbers in names by their value."""
    return [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", name)]


class Folder:
    """A folder of any file system that Arrow knows."""

    def __init__(self, path: str) -> None:
        from pyarrow import fs  # in the process that reads

        self.types = fs
        self.fs, self.root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def find(self, pattern: str | None) -> list[str]:
        """Paths, below the folder, of files that fit a pattern of ``folder/name``, in natural order."""
        if not pattern:
            return []
        folder, _, name = pattern.rpartition("/")
        found = self.fs.get_file_info(self.types.FileSelector(f"{self.root}/{folder}".rstrip("/"), allow_not_found=True))
        names = [f.base_name for f in found if f.type == self.types.FileType.File and fnmatch.fnmatchcase(f.base_name, name) and not f.base_name.startswith((".", "_"))]
        return [f"{folder}/{n}".lstrip("/") for n in sorted(names, key=natural)]

    def read(self, path: str) -> bytes:
        with self.fs.open_input_stream(f"{self.root}/{path}") as f:
            return f.read()

    def lines(self, path: str) -> Iterator[str]:
        """Lines of a file, or of all parts of a folder, that aren't empty."""
        parts = [path] if self.fs.get_file_info(f"{self.root}/{path}").type == self.types.FileType.File else self.find(f"{path}/part-*")
        for p in parts:
            with self.fs.open_input_stream(f"{self.root}/{p}") as f:
                yield from (line for line in io.TextIOWrapper(f, "utf-8") if line.strip())


class Layout:
    """Where a scene's files are, and how its poses are written: one file a frame (``pose_files``) or all in ``trajectory``. Subclass it for others."""

    colour: str | None = None
    depth: str | None = None
    pose_files: str | None = None
    trajectory: str | None = None
    #: Lines of a trajectory for each frame, and how many of them come before its matrix.
    lines, skipped = 1, 0

    def pose(self, data: bytes) -> np.ndarray:
        """The matrix in a frame's own file."""
        return np.array(data.split(), dtype=float).reshape(4, 4)

    def pose_of_lines(self, lines: list[str]) -> np.ndarray:
        """The matrix in a frame's lines of the trajectory."""
        return np.array(" ".join(lines).split(), dtype=float).reshape(4, 4)

    def step(self, n_lines: int, n_frames: int) -> int:
        """Every how many poses of the trajectory there is a frame."""
        return 1


class _Flipped(Layout):
    def pose(self, data: bytes) -> np.ndarray:
        return _FLIP @ super().pose(data) @ _FLIP.T


class _Npy(Layout):
    pose_files = "poses/*.npy"

    def pose(self, data: bytes) -> np.ndarray:
        return _FLIP @ np.load(io.BytesIO(data)).astype(float) @ _FLIP.T


class Rows(Layout):
    colour, depth, trajectory = "results/frame*.jpg", "results/depth*.png", "traj.txt"


class Icl(Layout):
    """Three rows of four a frame; the last row is 0 0 0 3."""

    colour, depth, trajectory, lines = "rgb/*.png", "depth/*.png", "traj.gt.sim", 3

    def pose_of_lines(self, lines: list[str]) -> np.ndarray:
        rows = [[float(v) for v in line.split()[:4]] for line in lines]
        return np.array([*rows, [0, 0, 0, 3]], dtype=float)


class ScanNet(Layout):
    colour, depth, pose_files = "color/*.jpg", "depth/*.png", "pose/*.txt"


class Azure(Layout):
    """A line of frame numbers and four rows a frame."""

    colour, depth, trajectory, lines, skipped = "color/*.jpg", "depth/*.png", "poses.log", 5, 1


class RealSense(_Npy):
    colour, depth = "rgb/*.jpg", "depth/*.png"


class Record3D(_Npy):
    colour, depth = "rgb/*.png", "depth/*.png"


class MultiScan(Layout):
    """A line of JSON a pose, its ``transform`` by columns; images are of every few poses."""

    colour, depth, trajectory = "outputs/color/*.png", "outputs/depth/*.png", "poses.jsonl"

    def pose_of_lines(self, lines: list[str]) -> np.ndarray:
        m = np.array(json.loads(lines[0])["transform"], dtype=float).reshape(4, 4, order="F") @ _FLIP
        return m / m[3, 3]

    def step(self, n_lines: int, n_frames: int) -> int:
        return max(1, round(n_lines / n_frames)) if n_frames else 1


class Hm3d(Layout):
    colour, depth, pose_files = "*_rgb.png", "*_depth.png", "*.json"

    def pose(self, data: bytes) -> np.ndarray:
        return _FLIP @ np.array(json.loads(data)["pose"], dtype=float).reshape(4, 4) @ _FLIP.T


class Hm3dQuestions(_Flipped):
    colour, depth, pose_files = "*-rgb.png", "*-depth.png", "[0-9]*.txt"


LAYOUTS: dict[str, type[Layout]] = {"replica": Rows, "icl": Icl, "scannet": ScanNet, "azure": Azure, "realsense": RealSense, "record3d": Record3D, "multiscan": MultiScan, "hm3d": Hm3d, "hm3d-openeqa": Hm3dQuestions}


@dataclass
class _Range(InputPartition):
    first: int
    last: int

    def __init__(self, first: int, last: int) -> None:
        super().__init__(None)
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], layouts: dict[str, type[Layout]]) -> None:
        name = options.get("layout", "replica").lower()
        if name not in layouts:
            raise ValueError(f"unknown scene layout {name!r}")
        self.layout = layouts[name]()
        self.path = options["path"]
        self.start, self.end, self.stride = (int(options.get(k, d)) for k, d in (("start", 0), ("end", -1), ("stride", 1)))
        if self.start < 0 or self.stride < 1:
            raise ValueError("start is 0 at least, and stride 1")
        self.per = int(options.get("frames", FRAMES))

    def _scene(self) -> tuple[Folder, list[str], list[str], list[str]]:
        folder = Folder(self.path)
        return folder, folder.find(self.layout.colour), folder.find(self.layout.depth), folder.find(self.layout.pose_files)

    def partitions(self) -> list[_Range]:
        folder, colour, _, poses = self._scene()
        n = len(colour) or len(poses)
        if not n and self.layout.trajectory:
            n = sum(1 for _ in folder.lines(self.layout.trajectory)) // self.layout.lines
        last = n if self.end < 0 else min(n, self.end)
        wide = max(1, self.per) * self.stride
        return [_Range(lo, min(lo + wide, last)) for lo in range(self.start, last, wide)]

    def read(self, partition: _Range | None) -> Iterator[tuple]:
        if partition is None:  # there are no frames
            return
        folder, colour, depth, poses = self._scene()
        wanted = range(partition.first, partition.last, self.stride)
        at = lambda names, k: names[k] if k < len(names) else None
        if self.layout.pose_files:
            for k in wanted:
                yield k, at(colour, k), at(depth, k), self.layout.pose(folder.read(poses[k])).ravel().tolist() if k < len(poses) else None
            return
        size, step = self.layout.lines, 1
        if colour:
            step = self.layout.step(sum(1 for _ in folder.lines(self.layout.trajectory)) // size, len(colour))
        lines = itertools.islice(folder.lines(self.layout.trajectory), partition.first * size * step, None)
        for k in range(partition.first, partition.last):
            own = list(itertools.islice(lines, size * step))[:size]
            if (k - partition.first) % self.stride == 0:
                yield k, at(colour, k), at(depth, k), self.layout.pose_of_lines(own[self.layout.skipped :]).ravel().tolist() if len(own) == size else None


class SceneFrames(DataSource):
    """``frame_id, colour, depth, pose`` (16 numbers, by rows) of a scene's folder; missing images and poses are null."""

    layouts = LAYOUTS

    @classmethod
    def name(cls) -> str:
        return "scene_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options, self.layouts)


def register_frames(spark: SparkSession, **own: type[Layout]) -> None:
    """Make the format known to a session, with layouts of one's own by name."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the processes that plan and read needn't have this package
    kind = type("SceneFrames", (SceneFrames,), {"layouts": LAYOUTS | {k.lower(): v for k, v in own.items()}}) if own else SceneFrames
    spark.dataSource.register(kind)
