"""Vectors: arrays of numbers, or structs of x, y and z."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector(*parts: Column) -> Column:
    """A struct of two or three components."""
    return F.struct(*(p.cast("double").alias(n) for p, n in zip(parts, "xyz", strict=False)))


def components(v: Column, names: str = "xyz") -> list[Column]:
    return [v[n] for n in names]


def dot(a: Column, b: Column) -> Column:
    return reduce(lambda s, t: s + t, (x * y for x, y in zip(components(a), components(b), strict=True)))


def magnitude(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def array_dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def array_magnitude(v: Column) -> Column:
    return F.sqrt(array_dot(v, v))
