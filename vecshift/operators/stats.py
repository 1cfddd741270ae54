"""Statistics of vectors and checks of copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecshift.functions.vectors import cosine, doubles, euclidean, has_inf, has_nan, has_vector, norm

#: Absolute and relative tolerance by datatype (fixed values); others have those of float32.
TOLERANCES = {"float32": (1e-5, 1e-5), "float16": (1e-2, 1e-2), "bfloat16": (1e-2, 1e-2), "int8": (0.05, 0.0), "binary": (0.0, 0.0)}
#: Norms this near to one are unit norms; so many of them confirm that vectors are normalised.
UNIT_TOLERANCE, UNIT_SHARE = 0.01, 0.95
#: Payload keys that may hold the language, in order of precedence (fixed values).
LANGUAGE_KEYS = ("language", "lang", "language_code", "locale")


def tolerance(datatype: Column) -> tuple[Column, Column]:
    atol = rtol = None
    for name, (a, r) in TOLERANCES.items():
        atol = F.when(datatype == name, a) if atol is None else atol.when(datatype == name, a)
        rtol = F.when(datatype == name, r) if rtol is None else rtol.when(datatype == name, r)
    return atol.otherwise(TOLERANCES["float32"][0]), rtol.otherwise(TOLERANCES["float32"][1])


def distribution(df: DataFrame, vector: str = "vector", by: tuple[str, ...] = ()) -> DataFrame:
    """``count, dimension, mean_norm, std_norm, has_nan, has_inf`` of the vectors there are (null and empty ones left
    out), for each group. Norms that aren't finite are left out of mean and population deviation."""
    v = F.col(vector)
    finite = F.when(~has_nan(v) & ~has_inf(v), norm(v))
    return df.where(has_vector(v)).groupBy(*by).agg(
        F.count("*").alias("count"), F.max(F.size(v)).cast("bigint").alias("dimension"), F.avg(finite).alias("mean_norm"), F.stddev_pop(finite).alias("std_norm"),
        F.coalesce(F.bool_or(has_nan(v)), F.lit(False)).alias("has_nan"), F.coalesce(F.bool_or(has_inf(v)), F.lit(False)).alias("has_inf"),
    )


def fidelity(df: DataFrame, vector: str = "vector", by: tuple[str, ...] = ()) -> DataFrame:
    """``rejected, n_bad`` for each group: whether, and how many of its vectors hold NaN or infinity."""
    v = F.col(vector)
    bad = has_nan(v) | has_inf(v)
    return df.where(has_vector(v)).groupBy(*by).agg(F.coalesce(F.bool_or(bad), F.lit(False)).alias("rejected"), F.count_if(bad).alias("n_bad"))


def normalization(df: DataFrame, vector: str = "vector", by: tuple[str, ...] = ()) -> DataFrame:
    """``confidence, status, method, confirmed, mean_norm, std_norm``: whether vectors have unit norm, as measured.

    status: ``detected`` if at least UNIT_SHARE have, else ``not_normalized``, ``unknown`` without vectors."""
    n = F.when(~has_nan(F.col(vector)) & ~has_inf(F.col(vector)), norm(F.col(vector)))
    unit = F.coalesce((F.abs(n - 1.0) < UNIT_TOLERANCE).cast("double"), F.lit(0.0))
    rows = df.where(has_vector(F.col(vector))).groupBy(*by).agg(F.avg(unit).alias("confidence"), F.avg(n).alias("mean_norm"), F.stddev_pop(n).alias("std_norm"))
    status = F.when(F.col("confidence").isNull(), "unknown").when(F.col("confidence") >= UNIT_SHARE, "detected").otherwise("not_normalized")
    rows = rows.withColumn("status", status)
    return rows.withColumn("method", F.when(F.col("status") == "detected", "l2").otherwise("none")).withColumn("confirmed", F.col("status") == "detected")


def integrity(source: DataFrame, target: DataFrame, key: str = "id", vector: str = "vector", datatype: str = "float32") -> DataFrame:
    """One row: ``ids_checked, ids_missing, shape_mismatches, max_abs_diff, mean_abs_diff, within_tolerance`` of the vectors of
    the source and those of the same key in the target. The tolerance is relative to the target; NaN is never
    close. Vectors of different lengths are counted, and never within tolerance."""
    atol, rtol = TOLERANCES.get(datatype, TOLERANCES["float32"])
    pairs = source.select(key, doubles(F.col(vector)).alias("s")).join(target.select(key, doubles(F.col(vector)).alias("t"), F.lit(1).alias("there")), key, "left")
    common = F.col("there").isNotNull()
    same = F.coalesce(F.size("s") == F.size("t"), F.col("s").isNull() & F.col("t").isNull())
    diffs = F.when(common & same, F.zip_with("s", "t", lambda x, y: F.abs(x - y)))
    close = F.when(common & same & F.col("s").isNotNull(), F.forall(F.zip_with("s", "t", lambda x, y: F.coalesce(F.abs(x - y) <= atol + rtol * F.abs(y), F.lit(False)) & ~F.isnan(F.abs(x - y))), lambda ok: ok))
    finite = F.filter(diffs, lambda d: ~F.isnan(d) & (d < F.lit(float("inf"))))
    return pairs.agg(
        F.count_if(common).alias("ids_checked"), F.count_if(~common).alias("ids_missing"), F.count_if(common & ~same).alias("shape_mismatches"),
        F.max(F.array_max(finite)).alias("max_abs_diff"), (F.sum(F.aggregate(finite, F.lit(0.0), lambda a, x: a + x)) / F.nullif(F.sum(F.size(finite)), F.lit(0))).alias("mean_abs_diff"),
        (F.coalesce(F.bool_and(close), F.lit(True)) & (F.count_if(common & ~same) == 0)).alias("within_tolerance"),
    )


def reconstruction(original: Column, rebuilt: Column) -> tuple[Column, Column]:
    """(L2 error, cosine) of a row; a zero norm counts as one in the cosine."""
    return euclidean(original, rebuilt), cosine(original, rebuilt)


def language(payload: Column) -> Column:
    """The first of LANGUAGE_KEYS that holds a non-empty string; values of other types are passed over."""
    tree = F.try_parse_json(payload)
    found = []
    for key in LANGUAGE_KEYS:
        value = F.try_variant_get(tree, f"$.{key}", "variant")
        found.append(F.when((F.schema_of_variant(value) == "STRING"), F.nullif(F.try_variant_get(tree, f"$.{key}", "string"), F.lit(""))))
    return F.coalesce(*found)


def validation_mode(has_golden: bool, has_model: bool, has_documents: bool) -> str:
    """golden queries, else synthetic ones (which need a model and documents), else none."""
    return "golden" if has_golden else "synthetic" if has_model and has_documents else "unavailable"
