"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def usable(v: Column, dims: int | None = None) -> Column:
    """True for a non-empty vector of finite numbers with a non-zero norm."""
    size = F.coalesce(F.size(v), F.lit(0)) if dims is None else F.lit(dims)
    return fault(v, size).isNull()


def fault(v: Column, dims: int | Column) -> Column:
    """Why a vector cannot be compared: null, empty, dimension, not_finite or zero; NULL if it can."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)
                      & (F.abs(x.cast("double")) != float("inf")))
    return (F.when(v.isNull(), "null").when(F.size(v) == 0, "empty").when(F.size(v) != dims, "dimension")
            .when(~finite, "not_finite").when(~F.exists(v, lambda x: x != 0), "zero"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; NULL when dimensions differ or a norm is zero."""
    norm = F.nullif(F.sqrt(dot(a, a) * dot(b, b)), F.lit(0.0))
    return F.when(F.size(a) == F.size(b), dot(a, b) / norm)
