"""Column functions on ``array<float>`` vectors, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(vector: Column) -> Column:
    return F.aggregate(_doubles(vector), F.lit(0.0), lambda acc, x: acc + x * x, F.sqrt)


def l2_normalize(vector: Column) -> Column:
    """Unit vector; null for a zero vector."""
    # The length is bound as a lambda variable, else it would be computed anew for every value.
    unit = F.transform(
        F.array(norm(vector)), lambda n: F.when(n > 0, F.transform(vector, lambda x: (x / n).cast("float")))
    )
    return F.element_at(unit, 1)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where either vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))
