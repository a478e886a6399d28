"""Vector distance and the ranks that fuse."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """1 - cosine similarity in double; norms can be given where they are stored."""
    return F.lit(1.0) - dot(a, b) / ((norm_a if norm_a is not None else norm(a)) * (norm_b if norm_b is not None else norm(b)))


def literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])
