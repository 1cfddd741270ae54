"""Vector expressions over ``ARRAY`` columns. All arithmetic is in doubles; built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Norms below this count as this in cosines.
LEAST_NORM = 1e-9


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(LEAST_NORM)) * F.greatest(norm(b), F.lit(LEAST_NORM)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def manhattan(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


def renormalize(v: Column) -> Column:
    """The vector over its norm; a zero vector stays as it is.

    The norm is bound to the vector in a struct first: an expression inside the lambda would be evaluated for every element."""
    n = norm(v)
    bound = F.array(F.struct(doubles(v).alias("v"), F.when(n == 0, 1.0).otherwise(n).alias("n")))
    return F.get(F.transform(bound, lambda s: F.transform(s["v"], lambda x: x / s["n"])), F.lit(0))


def prefix(v: Column, k: int) -> Column:
    return F.slice(v, 1, k)


def truncated(v: Column, k: int) -> Column:
    """The first ``k`` elements, brought back to norm one."""
    return renormalize(prefix(v, k))


def has_vector(v: Column) -> Column:
    return F.coalesce(F.size(v) > 0, F.lit(False))


def has_nan(v: Column) -> Column:
    return F.exists(doubles(v), lambda x: F.isnan(x))


def has_inf(v: Column) -> Column:
    return F.exists(doubles(v), lambda x: F.abs(x) == F.lit(float("inf")))


def is_usable(v: Column, dimension: int | None = None) -> Column:
    """Whether the vector has (``dimension``) elements, all finite and not all zero. NaN is the greatest element in Spark."""
    greatest, least = F.array_max(v), F.array_min(v)
    finite = (greatest < F.lit(float("inf"))) & (least > F.lit(float("-inf")))
    right = (F.size(v) == dimension) if dimension else (F.size(v) > 0)
    return F.coalesce(right & (F.size(F.array_compact(v)) == F.size(v)) & finite & ((greatest != 0) | (least != 0)), F.lit(False))


def dequantize(v: Column, datatype: str) -> Column:
    """int8: over 127; binary: +1 above zero, else -1; others: as they are."""
    if datatype == "int8":
        return F.transform(doubles(v), lambda x: x / 127.0)
    if datatype == "binary":
        return F.transform(doubles(v), lambda x: F.when(x > 0, 1.0).otherwise(-1.0))
    return doubles(v)


def quantize_int8(v: Column) -> Column:
    return F.transform(doubles(v), lambda x: F.round(x * 127.0).cast("int"))
