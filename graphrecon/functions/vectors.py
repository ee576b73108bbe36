"""Vector arithmetic on array columns, kept on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphrecon.functions.keys import let


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p)


def norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, a: s + a * a))


def cosine(x: Column, y: Column) -> Column:
    return dot(x, y) / (norm(x) * norm(y))


def smoothed_cosine(x: Column, y: Column, epsilon: float = 1e-8) -> Column:
    """Cosine with epsilon under each root, so that zero vectors stay defined."""
    return dot(x, y) / (F.sqrt(dot(x, x) + epsilon) * F.sqrt(dot(y, y) + epsilon))


def scaled_dot(x: Column, y: Column, epsilon: float = 1e-8) -> Column:
    return dot(x, y) / (F.sqrt(F.size(x).cast("double")) + epsilon)


def abs_difference(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: F.abs(a - b))


def product(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a * b)


def pair_features(x: Column, y: Column) -> Column:
    """Both vectors, their absolute difference and their product, one after the other."""
    return F.concat(x, y, abs_difference(x, y), product(x, y))


def unit(x: Column, epsilon: float = 0.0) -> Column:
    length = F.greatest(norm(x), F.lit(epsilon)) if epsilon > 0 else norm(x)
    return let(length, lambda n: F.transform(x, lambda a: a / n))


def mean_pool(rows: Column) -> Column:
    """Mean over the rows of an array of equally long arrays."""
    first = F.transform(F.get(rows, F.lit(0)), lambda a: F.lit(0.0))
    total = F.aggregate(rows, first, lambda s, r: F.zip_with(s, r, lambda a, b: a + b))
    count = F.greatest(F.size(rows), F.lit(1))
    return let(count, lambda n: F.transform(total, lambda a: a / n))


def max_pool(rows: Column) -> Column:
    return F.aggregate(
        rows,
        F.get(rows, F.lit(0)),
        lambda s, r: F.zip_with(s, r, lambda a, b: F.greatest(a, b)),
    )


def first_row(rows: Column) -> Column:
    return F.get(rows, F.lit(0))


def slice_matrix(vector: Column, width: int) -> Column:
    """Cut a flat vector into rows of ``width`` numbers."""
    last = F.floor((F.size(vector) - 1) / width).cast("int")
    return let(
        vector,
        lambda v: F.transform(
            F.sequence(F.lit(0), last), lambda i: F.slice(v, i * width + 1, F.lit(width))
        ),
    )


def vector_error(rows: Column, dim: int, max_length: int) -> Column:
    """Why a stored matrix is unusable, or NULL: empty, wrong width, too long."""
    width = F.size(F.get(rows, F.lit(0)))
    return (
        F.when(rows.isNull(), F.lit("no matrix"))
        .when(F.size(rows) <= 0, F.lit("empty length"))
        .when(
            F.exists(rows, lambda r: F.size(r) != dim),
            F.concat(F.lit(f"width is not {dim}: "), width.cast("string")),
        )
        .when(
            F.size(rows) > max_length,
            F.concat(F.lit(f"longer than {max_length}: "), F.size(rows).cast("string")),
        )
    )
