"""Copying a collection into another: collisions, upserts, the ledger of what was written, and undoing it.

Collections are DataFrames keyed by ``id`` (or several columns). All operators are joins on the key, so that both
sides are shuffled once at most; nothing is collected but counts and, on failure, five ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecshift.functions.current import current_rows
from vecshift.functions.vectors import has_vector

#: What to do with records whose key the target has; ``prefix`` is another name of ``rename``.
POLICIES = ("overwrite", "fail", "skip", "rename", "prefix")
SUFFIX = "__migrated"


class CollisionError(ValueError):
    """Records exist in the target although the policy forbids it."""


def colliding(source: DataFrame, target: DataFrame, key: str = "id") -> DataFrame:
    """The source's records whose key the target has."""
    return source.join(target.select(key).distinct(), key, "left_semi")


def resolve(source: DataFrame, target: DataFrame, policy: str, key: str = "id", written: DataFrame | None = None) -> DataFrame:
    """The records to write under a policy.

    ``written``: keys this migration wrote before (its ledger); they don't count as collisions, so that a step
    can be repeated under any policy. ``fail`` raises with the five smallest colliding keys."""
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}, got {policy!r}")
    if policy == "overwrite":
        return source
    taken = target.select(key).distinct()
    if written is not None:
        taken = taken.join(written.select(key).distinct(), key, "left_anti")
    if policy == "skip":
        return source.join(taken, key, "left_anti")
    if policy == "fail":
        first = [r[0] for r in colliding(source, taken, key).select(key).distinct().orderBy(key).limit(5).collect()]
        if first:
            raise CollisionError(f"the target already has {', '.join(map(str, first))}")
        return source
    columns = source.columns
    marked = source.join(taken.withColumn("__taken", F.lit(True)), key, "left")
    renamed = F.when(F.col("__taken"), F.concat(F.col(key).cast("string"), F.lit(SUFFIX))).otherwise(F.col(key).cast("string"))
    return marked.withColumn(key, renamed).select(*columns)


def latest(records: DataFrame, key: str = "id", version: str | None = "updated_at", arrival: str | None = "ingested_at") -> DataFrame:
    """One record per key: the latest version."""
    return records.dropDuplicates([key]) if version is None else current_rows(records, key, version, arrival)


def upsert(target: DataFrame, records: DataFrame, key: str = "id") -> DataFrame:
    """The target with the records in the place of those of the same key. ``records`` has one row per key."""
    return target.join(records.select(key), key, "left_anti").unionByName(records.select(*target.columns))


def delete(target: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """The target without exactly these keys."""
    return target.join(keys.select(key).distinct(), key, "left_anti")


def ledger(target: DataFrame, records: DataFrame, migration_id: str, batch: int, key: str = "id") -> DataFrame:
    """``(migration_id, batch, key, existed, ...)``: what a step writes, with the record it replaces, for undoing it."""
    before = target.select(F.col(key), F.struct(*target.columns).alias("before"))
    rows = records.select(key).join(before, key, "left")
    return rows.select(F.lit(migration_id).alias("migration_id"), F.lit(batch).cast("bigint").alias("batch"), key, F.col("before").isNotNull().alias("existed"), "before")


def rollback(target: DataFrame, entries: DataFrame, key: str = "id") -> DataFrame:
    """The target as it was before the ledger's entries: written keys removed, replaced records back.

    Of several entries of a key the first batch's holds the original."""
    first = entries.groupBy(key).agg(F.min_by(F.struct("before"), "batch").alias("first"))
    restored = first.where("first.before is not null").select("first.before.*").select(*target.columns)
    return delete(target, entries, key).unionByName(restored)


def progress(entries: DataFrame, batches: DataFrame) -> DataFrame:
    """``(batch, vectors_read, vectors_written, total_read, total_written)`` by batch, with running totals.

    batches: ``(batch, vectors_read)``, one row for each; a migration has one row per batch, not per record."""
    counts = entries.groupBy("batch").agg(F.count("*").alias("vectors_written"))
    return totals(batches.join(counts, "batch", "left").fillna(0, ["vectors_written"]))


def totals(rows: DataFrame) -> DataFrame:
    """``(batch, vectors_read, vectors_written)`` with running totals ``total_read, total_written``."""
    from pyspark.sql import Window

    upto = Window.partitionBy(F.lit(0)).orderBy("batch")
    return rows.select("batch", "vectors_read", "vectors_written", F.sum("vectors_read").over(upto).alias("total_read"), F.sum("vectors_written").over(upto).alias("total_written"))


def page(records: DataFrame, after=None, size: int = 200, key: str = "id") -> DataFrame:
    """The next ``size`` records by key after a cursor: keyset paging, no offset, a top-n per partition."""
    rows = records if after is None else records.where(F.col(key) > F.lit(after))
    return rows.orderBy(key).limit(size)


def dry_run(records: DataFrame, sample: int = 400, queries: int = 40, key: str = "id", vector: str = "vector") -> DataFrame:
    """The first ``sample`` records with a vector, by key, the first ``queries`` of them marked as queries."""
    from pyspark.sql import Window

    rows = records.where(has_vector(F.col(vector))).orderBy(key).limit(sample)
    return rows.withColumn("is_query", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(key)) <= queries)
