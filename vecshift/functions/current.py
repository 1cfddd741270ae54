"""The current row of each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def current_rows(df: DataFrame, key: str | Column = "id", version: str = "updated_at", arrival: str | None = "ingested_at") -> DataFrame:
    """One row per key: the one with the greatest ``version``, ties going to the latest ``arrival``.

    Null versions are oldest; rows with a null key are no records and are left out. The rank filter lets
    Spark cut each key to one row before the shuffle, so a key with very many versions stays small."""
    column = F.col(key) if isinstance(key, str) else key
    order = [F.col(version).desc_nulls_last()] + ([F.col(arrival).desc_nulls_last()] if arrival else [])
    rank = "__rank_of_version"
    ranked = df.where(column.isNotNull()).withColumn(rank, F.row_number().over(Window.partitionBy(column).orderBy(*order)))
    return ranked.where(F.col(rank) == 1).drop(rank)
