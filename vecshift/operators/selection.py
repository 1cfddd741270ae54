"""Choice among candidate strategies by gated, weighted scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values closer than this are no difference.
TIE = 1e-4
#: Measures, whether greater is better, and weights (fixed values).
WEIGHTS = {"quality": (True, 0.50), "cost": (False, 0.15), "latency_ms": (False, 0.15), "migration_time_s": (False, 0.10), "storage_bytes": (False, 0.05), "risk": (False, 0.05)}


def minmax(value: Column, maximize: bool, over: Window | None = None) -> Column:
    """The value's place between the least and the greatest of the group, 1 being best; 1 for all if they tie."""
    w = over if over is not None else Window.partitionBy(F.lit(0))
    low, high = F.min(value).over(w), F.max(value).over(w)
    span = high - low
    return F.when(span <= TIE, 1.0).otherwise((value - low if maximize else high - value) / F.nullif(span, F.lit(0.0)))


def normalize(value: Column, direction: str, over: Window | None = None) -> Column:
    if direction not in ("maximize", "minimize"):
        raise ValueError(f"direction must be 'maximize' or 'minimize', got {direction!r}")
    return minmax(value, direction == "maximize", over)


def score(candidates: DataFrame, weights: dict[str, float] | None = None, by: str | None = None) -> DataFrame:
    """``(by, benchmark_id, strategy, score)`` of the candidates that passed the gate, measures being normalised among
    those only. Measures that are missing or null count as 0. One candidate set, or one for each value of ``by``:
    a set is a handful of rows."""
    over = Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))
    passed = candidates.where("passed_quality_gate")
    total = F.lit(0.0)
    for name, (maximize, weight) in WEIGHTS.items():
        value = F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in candidates.columns else F.lit(0.0)
        total = total + (weights or {}).get(name, weight) * minmax(value, maximize, over)
    return passed.select(*([by] if by else []), "benchmark_id", "strategy", total.alias("score"))


def select(candidates: DataFrame, benchmark_id: str | None = None, by: str | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """The chosen row of ``score``: the asked one if it passed, else a direct copy if one passed, else the best score;
    ties by strategy and id. No row if none passed."""
    rows = score(candidates, weights, by)
    if benchmark_id is not None:
        return rows.where(F.col("benchmark_id") == benchmark_id)
    order = [F.desc(F.col("strategy") == "direct_copy"), F.desc(F.round("score", 9)), "strategy", "benchmark_id"]
    if not by:
        return rows.orderBy(*order).limit(1)
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where("__n = 1").drop("__n")


def require_executed(benchmark_id: str, results: DataFrame) -> None:
    """Only a result that exists may be selected."""
    if results.where(F.col("benchmark_id") == benchmark_id).isEmpty():
        raise ValueError(f"no benchmark {benchmark_id!r} was run")


def confidence(*measures: Column, within: Column | None = None) -> Column:
    """The mean of what was measured: nulls are left out; null if nothing was."""
    parts = list(measures) + ([F.when(within, 1.0).when(~within, 0.0)] if within is not None else [])
    known = F.array_compact(F.array(*[p.cast("double") for p in parts]))
    return F.try_divide(F.aggregate(known, F.lit(0.0), lambda s, x: s + x), F.nullif(F.size(known), F.lit(0)))


@dataclass(frozen=True)
class AdaptiveRetrieval:
    shortlist_dimension: int
    full_dimension: int
    strategy: str = "mrl_prefetch_rerank"


def adaptive_retrieval(mrl_capable: bool, target_reranks: bool, shortlist_dimension: int, full_dimension: int) -> AdaptiveRetrieval | None:
    """A two-stage search, offered only where model and target both support it; ``knn.two_stage`` carries it out."""
    return AdaptiveRetrieval(shortlist_dimension, full_dimension) if mrl_capable and target_reranks else None
