"""Vector functions in double precision, built from higher-order functions (no Python on the executors)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column, b: Column) -> Column:
    """NaN where either vector is zero."""
    length = norm(a) * norm(b)
    return F.when(length == 0, F.lit(float("nan"))).otherwise(dot(a, b) / length)


def vector_literal(values: list[float]) -> Column:
    """A query vector as one constant of the plan."""
    return F.from_json(F.lit("[" + ",".join(map(repr, map(float, values))) + "]"), "array<double>")


def parse_vector(text: Column) -> Column:
    return F.from_json(text, "array<float>")


def checked_dimensions(vector: Column, dimensions: int) -> Column:
    """The vector; an error where it has another number of dimensions."""
    wrong = F.raise_error(F.format_string(f"expected {dimensions} dimensions, not %d", F.size(vector)))
    return F.when(F.size(vector) == dimensions, vector).otherwise(F.when(vector.isNotNull(), wrong.cast("array<float>")))
