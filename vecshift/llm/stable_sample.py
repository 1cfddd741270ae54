"""A reproducible sample that only grows as data are added (problem 2).

Consistent weighted Poisson sampling: a record is selected when the hash of its identifier and the seed is
below weight x rate. The weight of a record is the greatest it ever had (its running maximum), so that its
probability of inclusion never falls. ``hash < max(w) * rate`` holds just when ``hash < w * rate`` holds for
some row, so rows are filtered before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecshift.functions.hashing import unit_hash
from vecshift.functions.staging import within

DEFAULT_SEED = 42
#: Contexts up to which they are broadcast to the records; more are joined by resource and one of SALTS parts of its records.
CONTEXT_ROWS, SALTS = 10_000, 32


def sample_contexts(contexts: DataFrame) -> DataFrame:
    """Distinct contexts with the default seed filled in and a usable rate. Null, NaN and negative rates are 0."""
    rate = F.when(F.isnan("sample_rate"), 0.0).otherwise(F.greatest(F.coalesce("sample_rate", F.lit(0.0)), F.lit(0.0)))
    return contexts.select("context_id", "resource_name", F.coalesce("seed", F.lit(DEFAULT_SEED)).cast("bigint").alias("seed"), rate.alias("rate")).distinct()


def stable_sample(records: DataFrame, contexts: DataFrame, weight: Column | None = None, weights: DataFrame | None = None) -> DataFrame:
    """``(context_id, seed, resource_name, id, weight, first_load)``: the records selected for each context.

    records: ``resource_name, id, load_no``, in any order, repeated or split at will. ``weight`` is an expression
    over them, 1 if not given; null, NaN or negative weights are 0. ``weights`` is the stored table of
    ``running_weights`` of earlier runs (``resource_name, id, weight``): it keeps records selected whose
    weight has fallen since. ``first_load`` is the load that first brought the record into the sample (null
    for records known from ``weights`` only). Records without an id or resource are left out; a context whose
    resource has no records, or with a rate of 0, selects none."""
    drawn = _weighted(records, weight).withColumnRenamed("load_no", "load")
    if weights is not None:
        drawn = drawn.unionByName(weights.select("resource_name", "id", "weight", F.lit(None).cast("int").alias("load")))
    asked = sample_contexts(contexts)
    few = within(asked, CONTEXT_ROWS)
    if few is not None:
        joined = drawn.join(F.broadcast(few), "resource_name")
    else:  # a resource may hold a third of all records: its records are spread, its contexts repeated
        salted = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = drawn.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, ["resource_name", "salt"])
    chosen = joined.where(unit_hash(F.col("seed"), F.col("id")) < F.col("weight") * F.col("rate"))
    return chosen.groupBy("context_id", "seed", "resource_name", "id").agg(F.max("weight").alias("weight"), F.min("load").alias("first_load"))


def running_weights(records: DataFrame, weight: Column | None = None, weights: DataFrame | None = None) -> DataFrame:
    """``(resource_name, id, weight)``: the greatest weight each record ever had; to be stored between runs."""
    now = _weighted(records, weight).select("resource_name", "id", "weight")
    return (now if weights is None else now.unionByName(weights.select("resource_name", "id", "weight"))).groupBy("resource_name", "id").agg(F.max("weight").alias("weight"))


def _weighted(records: DataFrame, weight: Column | None) -> DataFrame:
    value = F.lit(1.0) if weight is None else weight.cast("double")
    value = F.when(F.isnan(value), 0.0).otherwise(F.greatest(F.coalesce(value, F.lit(0.0)), F.lit(0.0)))
    return records.select("resource_name", "id", value.alias("weight"), F.col("load_no").cast("int").alias("load_no")).where("resource_name is not null and id is not null")
