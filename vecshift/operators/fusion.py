"""Reciprocal rank fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The constant added to every rank.
RANK_OFFSET = 60


def fuse(rankings: list[DataFrame], weights: list[float] | None = None, offset: int = RANK_OFFSET) -> DataFrame:
    """``(query_id, id, score, rank)``: the sum of weight / (offset + rank) over the rankings an id is in.

    Ties go to the smallest rank in any ranking, then to the smaller id."""
    weights = weights or [1.0] * len(rankings)
    if len(weights) != len(rankings):
        raise ValueError("one weight for each ranking")
    parts = [r.select("query_id", "id", "rank", (F.lit(float(w)) / (offset + F.col("rank"))).alias("part")) for r, w in zip(rankings, weights, strict=True)]
    summed = reduce(DataFrame.unionByName, parts).groupBy("query_id", "id").agg(F.sum("part").alias("score"), F.min("rank").alias("best"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "best", "id")
    return summed.withColumn("rank", F.row_number().over(order).cast("bigint")).drop("best")


def recover(dense: DataFrame, sparse: DataFrame, k: int, offset: int = RANK_OFFSET) -> DataFrame:
    """The first k of a dense ranking fused with a sparse one."""
    return fuse([dense, sparse], offset=offset).where(F.col("rank") <= k)
