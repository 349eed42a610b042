"""Column expressions over vectors and neighbour sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ, a vector is empty or a norm is 0."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


def jaccard(shared: Column, left: Column, right: Column) -> Column:
    """From the sizes of the intersection and of both sets; 0 if both are empty."""
    union = left + right - shared
    return F.when(union == 0, 0.0).otherwise(shared / union)
