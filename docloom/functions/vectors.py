"""Vector functions over array Columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalise(v: Column) -> Column:
    """Null for a zero vector."""
    size = norm(v)
    return F.when(size > 0, F.transform(v, lambda x: x.cast("double") / size))


def fault(v: Column, dimension: int) -> Column:
    """First thing wrong with a vector, in this order: missing, empty, dimension, not_finite, zero_norm; null if sound."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(v.isNull(), "missing").when(F.size(v) == 0, "empty").when(F.size(v) != dimension, "dimension").when(~F.coalesce(finite, F.lit(False)), "not_finite").when(norm(v) == 0, "zero_norm")
