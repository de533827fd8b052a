"""Readers of camera trajectories from text files, and the sinks for scene tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.matrices import flipped_axes
from ..storage import cut


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines of each file in order, numbered from 0 within the file; a file is read by one task, as its order demands."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("line", "value"))
    return lines.where(F.trim("value") != "").withColumn("line", F.row_number().over(Window.partitionBy("file").orderBy("line")) - 1)


def _numbers(text: F.Column) -> F.Column:
    return F.transform(F.split(F.trim(text), r"\s+"), lambda x: x.cast("double"))


def read_pose_rows(spark: SparkSession, path: str) -> DataFrame:
    """``file, frame_id, m`` from 16 numbers a line, the row-major 4x4 matrix."""
    return _numbered(spark, path).select("file", F.col("line").alias("frame_id"), _numbers(F.col("value")).alias("m")).where(F.size("m") == 16)


def read_pose_blocks(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """``file, frame_id, m`` from four lines a pose, or five when each pose has a header line."""
    step = 5 if header else 4
    rows = _numbered(spark, path).select("file", F.floor(F.col("line") / step).alias("frame_id"), (F.col("line") % step).alias("k"), _numbers(F.col("value")).alias("v"))
    rows = rows.where("k > 0") if header else rows
    return rows.groupBy("file", "frame_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"])).alias("m")).where(F.size("m") == 16)


def read_pose_quaternions(spark: SparkSession, path: str) -> DataFrame:
    """``file, frame_id, m`` from ``tx ty tz qw qx qy qz`` at the start of a line; lines of 16 numbers are matrices."""
    rows = _numbered(spark, path).select("file", F.col("line").alias("frame_id"), _numbers(F.col("value")).alias("v")).where(F.size("v") >= 7)
    t = [F.col("v")[k] for k in range(3)]
    w, x, y, z = (F.col("v")[k] for k in range(3, 7))
    n = w * w + x * x + y * y + z * z
    s = F.when(n > 0, 2.0 / n).otherwise(0.0)
    m = [1 - s * (y * y + z * z), s * (x * y - z * w), s * (x * z + y * w), t[0], s * (x * y + z * w), 1 - s * (x * x + z * z), s * (y * z - x * w), t[1], s * (x * z - y * w), s * (y * z + x * w), 1 - s * (x * x + y * y), t[2]]
    return rows.select("file", "frame_id", F.when(F.size("v") == 16, F.col("v")).otherwise(F.array(*m, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))).alias("m"))


READERS = {"rows": read_pose_rows, "blocks": read_pose_blocks, "blocks_with_header": lambda s, p: read_pose_blocks(s, p, True), "quaternions": read_pose_quaternions}


def read_poses(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """Dispatch on the layout's name; an unknown one is a ValueError."""
    if layout.lower() not in READERS:
        raise ValueError(f"unknown pose layout {layout!r}")
    return READERS[layout.lower()](spark, path)


def frame_range(frames: DataFrame, start: int = 0, end: int = -1, stride: int = 1, by: str = "frame_id") -> DataFrame:
    """Every ``stride``-th frame from ``start`` to before ``end`` (-1: all)."""
    kept = frames.where((F.col(by) >= start) & ((F.col(by) - start) % stride == 0))
    return kept if end == -1 else kept.where(F.col(by) < end)


def write_ply(points: DataFrame, path: str) -> None:
    """ASCII PLY of ``x, y, z, r, g, b``: each part is a PLY file of its own, with a header that states its number of points.

    Lines are sorted by part and written in order, a part's header with its number of points first; ``points.coalesce(1)`` makes one part. No task holds
    more of its part than a batch.
    """
    cols = [F.col(c).cast("double").alias(c) for c in "xyz"] + [F.col(c).cast("int").alias(c) for c in "rgb"]
    rows = cut(points.select(*cols).withColumn("part", F.spark_partition_id()), "ply")
    counts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    texts = ["ply", "format ascii 1.0", None, *(f"property float {c}" for c in "xyz"), *(f"property uchar {c}" for c in ("red", "green", "blue")), "end_header"]
    head = F.array(*[F.lit(t) if t else F.format_string("element vertex %d", "n") for t in texts])
    heads = counts.select("part", F.posexplode(head).alias("line", "value"))
    body = rows.select("part", F.lit(len(texts)).alias("line"), F.format_string("%.6f %.6f %.6f %d %d %d", *"xyzrgb").alias("value"))
    parts = max(1, counts.count())
    heads.unionByName(body).repartitionByRange(parts, "part").sortWithinPartitions("part", "line").select("value").write.text(path)


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    """``x, y, z, r, g, b`` of ASCII PLY files; header lines aren't six numbers."""
    v = spark.read.text(path).select(F.split(F.trim("value"), " ").alias("v")).where(F.size("v") == 6).select(*(F.col("v")[k].try_cast("double" if k < 3 else "int").alias(c) for k, c in enumerate("xyzrgb")))
    return v.where("x IS NOT NULL AND b IS NOT NULL")


def read_pose_files(spark: SparkSession, path: str, flip: bool = False) -> DataFrame:
    """``file, m`` from one matrix a file, its sixteen numbers on any number of lines; ``flip`` turns y-up axes into z-up ones."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), _numbers(F.col("value")).alias("m")).where(F.size("m") == 16)
    return files.withColumn("m", flipped_axes(F.col("m"))) if flip else files


def read_pose_json(spark: SparkSession, path: str, flip: bool = True) -> DataFrame:
    """``file, m`` from JSON files with a ``pose`` of four rows."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.flatten(F.from_json("value", "pose array<array<double>>")["pose"]).alias("m")).where(F.size("m") == 16)
    return whole.withColumn("m", flipped_axes(F.col("m"))) if flip else whole


READERS |= {"files": read_pose_files, "json": read_pose_json}


def register_reader(layout: str, reader: Callable[[SparkSession, str], DataFrame]) -> None:
    """Make ``read_poses`` know another layout."""
    READERS[layout.lower()] = reader


def write_trajectory(poses: DataFrame, path: str, by: str = "frame_id", matrix: str = "m") -> None:
    """A trajectory of sixteen numbers a line, in an order; its part files follow each other."""
    poses.repartitionByRange(by).sortWithinPartitions(by).select(F.array_join(F.transform(matrix, lambda v: v.cast("string")), " ").alias("value")).write.text(path)
