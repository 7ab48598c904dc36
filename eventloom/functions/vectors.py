"""Vector functions as column expressions over arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, clip: bool = False, guard: bool = True) -> Column:
    """0 where the norms' product is next to nothing (null without guard); clip to 0..1."""
    length = norm(a) * norm(b)
    c = F.when(length > 1e-8, dot(a, b) / length).otherwise(0.0) if guard else F.try_divide(dot(a, b), length)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) if clip else c


def unit_score(c: Column) -> Column:
    """The score that search indexes give for a cosine."""
    return (1 + c) / 2


def hybrid(title: Column, content: Column, content_weight: float = 0.7) -> Column:
    """Weighted cosine; a missing title counts as the content."""
    return content_weight * content + (1 - content_weight) * F.coalesce(title, content)


def is_valid(v: Column) -> Column:
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
