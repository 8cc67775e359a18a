"""Vector functions as Column expressions: sequential sums in double, for every numeric element type.

Vectors of different length are an error; so is, as Spark reads it, a comparison of
arrays of unlike element types without a common one.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ALPHA = 0.1


def _same(a: Column, b: Column) -> Column:
    wrong = F.raise_error(F.concat(F.lit("vectors of dimensions "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string")))
    return F.when(F.size(a) == F.size(b), a).otherwise(wrong)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def l2_sq(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return _sum(F.zip_with(_same(a, b), b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt(l2_sq(a, b))


def similarity(a: Column, b: Column, alpha: float = ALPHA) -> Column:
    """exp(-alpha * l2): 1 for equal vectors and for empty ones, towards 0 with the distance."""
    return F.exp(-F.lit(float(alpha)) * l2(a, b))


def radius(threshold: float, alpha: float = ALPHA) -> float:
    """The distance at which the similarity equals the threshold."""
    import math

    return math.inf if threshold <= 0 else -math.log(threshold) / alpha


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_same(a, b), b, lambda x, y: x.cast("double") * y.cast("double")))


def sq_norm(a: Column) -> Column:
    return _sum(F.transform(a, lambda x: x.cast("double") * x.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(sq_norm(a))


def normalize(a: Column) -> Column:
    """The vector at length one; one of length zero stays."""
    length = norm(a)
    return F.when(length == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / length))


def cosine(a: Column, b: Column) -> Column:
    """Null if either length is zero."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths)


def equal(a: Column, b: Column) -> Column:
    """Same dimension and elements; NaN equals NaN, and 0.0 equals -0.0."""
    return a.eqNullSafe(b)


def concat(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def mean2(a: Column, b: Column) -> Column:
    """Element-wise mean of two vectors."""
    return F.zip_with(_same(a, b), b, lambda x, y: (x.cast("double") + y.cast("double")) / 2)


def combined_uid(left: Column, right: Column, factor: int = 1_000_000) -> Column:
    return left * factor + right


def split_uid(uid: Column, factor: int = 1_000_000) -> tuple[Column, Column]:
    return F.floor(uid / factor).cast("bigint"), F.pmod(uid, F.lit(factor))


def render(uid: Column, ts: Column, vec: Column) -> Column:
    """A record as text, elements with six decimals."""
    numbers = F.transform(vec, lambda x: F.format_string("%.6f", x.cast("double")))
    return F.concat(F.lit("uid="), uid.cast("string"), F.lit(" ts="), ts.cast("string"), F.lit(" ["), F.array_join(numbers, ", "), F.lit("]"))
