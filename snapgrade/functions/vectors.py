"""Vector expressions on ``array<float>`` columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def vector_to_text(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(v.cast("array<string>"), ","), F.lit("]"))


def text_to_vector(c: Column) -> Column:
    return F.from_json(c, "array<float>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine_similarity(a: Column, b: Column) -> Column:
    """1 − cosine distance; null when either vector has no direction."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)
