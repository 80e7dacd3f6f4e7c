"""Vectors as array columns: unit length, cosine, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def unit(v: Column, dims: int) -> Column:
    """v cut or padded with zeros to dims, at length 1; a zero vector stays."""
    fit = F.slice(F.concat(v.cast("array<double>"), F.array_repeat(F.lit(0.0), dims)), 1, dims)
    length = norm(fit)
    return F.transform(fit, lambda x: F.when(length > 0, x / length).otherwise(x))


def cosine(v: Column, w: Column) -> Column:
    """In double precision; null if either is zero or lengths differ."""
    dot = _sum(F.zip_with(v.cast("array<double>"), w.cast("array<double>"), lambda a, b: a * b))
    size = norm(v) * norm(w)
    return F.when((F.size(v) == F.size(w)) & (size > 0), dot / size)


def vector_key(provider: str, model: str, dims: int) -> str:
    return f"{provider}/{model}/{dims}"
