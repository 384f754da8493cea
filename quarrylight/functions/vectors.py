"""Vector functions as column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, clamp: bool = False) -> Column:
    """0 where lengths differ or a vector is null, empty or zero."""
    below = norm(a) * norm(b)
    value = dot(a, b) / below
    if clamp:
        value = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))
    return F.when((F.size(a) == F.size(b)) & (below > 0), value).otherwise(F.lit(0.0))
