"""A spatial index that is built once: points in Morton order, in files of about equally many, and a table of the files' bounds.

A ball or the nearest rows of a place are read from the files that can have some; inside them Parquet's own bounds skip row groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.relations import norm
from ..functions.trees import morton

XYZ = ("x", "y", "z")


def build(points: DataFrame, path: str, rows_per_file: int = 1_000_000, bits: int = 20) -> "SpatialIndex":
    """Write the index of ``points`` (``pt, x, y, z`` and more) under ``path``; points without a place are left out."""
    placed = points.where(" AND ".join(f"{a} IS NOT NULL" for a in XYZ))
    bounds = placed.agg(*(f(a) for a in XYZ for f in (F.min, F.max)), F.count(F.lit(1))).first()
    code = morton([F.col(a) for a in XYZ], list(bounds[:-1:2]), list(bounds[1:-1:2]), bits) if bounds[-1] else F.lit(0).cast("long")
    files = max(1, -(-bounds[-1] // rows_per_file))
    placed.withColumn("__code", code).repartitionByRange(files, "__code").sortWithinPartitions("__code").drop("__code").write.parquet(f"{path}/rows")
    spark = points.sparkSession
    rows = spark.read.schema(placed.schema).parquet(f"{path}/rows")
    manifest = rows.groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file")).agg(F.count(F.lit(1)).alias("n"), *(f(a).alias(f"{a}_{s}") for a in XYZ for s, f in (("lo", F.min), ("hi", F.max))))
    manifest.coalesce(1).write.parquet(f"{path}/files")
    return SpatialIndex(spark, path)


class SpatialIndex:
    """An index that has been built."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.files = spark.read.parquet(f"{path}/files")
        self.schema = spark.read.parquet(f"{path}/rows").schema

    def _apart(self, place: tuple[float, float, float], farthest: bool) -> Column:
        """How far a file's bounds are from a place, at least or at most."""
        edges = []
        for a, p in zip(XYZ, place):
            lo, hi = F.col(f"{a}_lo") - F.lit(float(p)), F.lit(float(p)) - F.col(f"{a}_hi")
            edges.append(F.greatest(F.abs(lo), F.abs(hi)) if farthest else F.greatest(F.lit(0.0), lo, hi))
        return norm(*edges)

    def read(self, names: list[str]) -> DataFrame:
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*[f"{self.path}/rows/{n}" for n in sorted(names)]) if names else self.spark.createDataFrame([], self.schema)

    def files_in(self, place: tuple[float, float, float], radius: float) -> list[str]:
        """The files with bounds no further than ``radius`` from a place."""
        return [r.file for r in self.files.where(self._apart(place, False) <= radius).select("file").collect()]

    def ball(self, place: tuple[float, float, float], radius: float) -> DataFrame:
        """Points no further than ``radius`` from a place, with their ``distance``."""
        inside = self.read(self.files_in(place, radius))
        for a, p in zip(XYZ, place):
            inside = inside.where((F.col(a) >= p - radius) & (F.col(a) <= p + radius))
        return inside.withColumn("distance", norm(*(F.col(a) - F.lit(float(p)) for a, p in zip(XYZ, place)))).where(F.col("distance") <= radius)

    def nearest(self, place: tuple[float, float, float], k: int) -> DataFrame:
        """The ``k`` points nearest to a place, ties by ``pt``. The files nearest by their far corners hold ``k`` points, and no further ones are read."""
        sure = self.files.select("n", self._apart(place, True).alias("far")).orderBy("far").limit(k).collect()
        reach, seen = 0.0, 0
        for r in sure:
            reach, seen = r.far, seen + r.n
            if seen >= k:
                break
        found = self.read(self.files_in(place, reach * (1 + 1e-12)))
        return found.withColumn("distance", norm(*(F.col(a) - F.lit(float(p)) for a, p in zip(XYZ, place)))).orderBy("distance", "pt").limit(k)
