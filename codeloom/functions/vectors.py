"""Column functions over dense vectors; sums run in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Similarity of a row without a distance.
UNKNOWN_SIMILARITY = 0.7


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector is null or zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def similarity(distance: Column) -> Column:
    return F.coalesce(1 - distance, F.lit(UNKNOWN_SIMILARITY))


def rendered(a: Column) -> Column:
    """A vector as text, [a,b,...]."""
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: x.cast("string")), ","), F.lit("]"))
