"""Vector arithmetic on ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def unit(v: Column) -> Column:
    return F.transform(v, lambda x: F.try_divide(x, norm(v)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def literal(values: list[float]) -> Column:
    return F.lit([float(x) for x in values]).cast("array<double>")


def disposition_similarity(a: Column, b: Column, style_a: Column | None = None, style_b: Column | None = None) -> Column:
    """1 - L2 / sqrt(18), plus 0.05 for an equal style, held within 0..1."""
    base = 1 - distance(a, b) / (18**0.5)
    if style_a is not None:
        base = base + F.when(style_a == style_b, 0.05).otherwise(0.0)
    return F.least(F.greatest(base, F.lit(0.0)), F.lit(1.0))
