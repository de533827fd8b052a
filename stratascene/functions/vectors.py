"""Vector expressions on ``array<double>`` columns, without UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def l2(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a: Column) -> Column:
    n = F.greatest(l2(a), F.lit(1e-8))
    return F.transform(a, lambda x: x / n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (l2(a) * l2(b))


def literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])
