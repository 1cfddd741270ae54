"""How well one ranking reproduces another.

Rankings are long tables ``(query_id, id, rank[, score])`` with ranks from 1. ``source`` defines relevance. Every
measure has one row per query that is in either ranking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def paired(source: DataFrame, target: DataFrame) -> DataFrame:
    """``(query_id, id, rs, rt[, ss, st])``: both ranks of each id, null where it isn't ranked."""
    def side(df, rank, score):
        return df.select("query_id", "id", F.col("rank").alias(rank), (F.col("score") if "score" in df.columns else F.lit(None).cast("double")).alias(score))

    return side(source, "rs", "ss").join(side(target, "rt", "st"), ["query_id", "id"], "full_outer")


def _discount(rank: Column) -> Column:
    return F.log2(rank + 1)


def per_query(source: DataFrame, target: DataFrame, k: int = 10) -> DataFrame:
    """``(query_id, recall_at_k, ndcg_at_k, topk_overlap, mrr, rank_correlation, score_drift)``.

    recall: share of the source's first k among the target's first k, 0 without any. overlap: Jaccard of the two
    sets, 1 if both are empty. ndcg: the item at source rank r has gain k - r + 1, discounted by log2(rank + 1).
    mrr: 1 over the target rank of the first item that is in the source's first k. rank_correlation: Spearman
    over the items ranked by both, whatever their rank, null below two. score_drift: mean absolute
    difference of the scores of items in both, null without any."""
    pairs = paired(source, target).withColumn("s", F.col("rs") <= k).withColumn("t", F.col("rt") <= k)
    both = F.col("rs").isNotNull() & F.col("rt").isNotNull()
    at = lambda rank: F.row_number().over(Window.partitionBy("query_id", "both").orderBy(rank))
    pairs = pairs.withColumn("both", both).withColumn("ds", F.when(both, at("rs"))).withColumn("dt", F.when(both, at("rt")))
    gain = k + 1 - F.col("rs")
    hit = F.coalesce(F.col("s") & F.col("t"), F.lit(False))
    sums = pairs.groupBy("query_id").agg(
        F.count_if("s").alias("n_s"),
        F.count_if(hit).alias("n_hit"),
        F.count_if(F.coalesce("s", F.lit(False)) | F.coalesce("t", F.lit(False))).alias("n_any"),
        F.sum(F.when(hit, gain / _discount(F.col("rt")))).alias("dcg"),
        F.sum(F.when(F.col("s"), gain / _discount(F.col("rs")))).alias("ideal"),
        F.min(F.when(hit, F.col("rt"))).alias("first"),
        F.count_if("both").alias("n_both"),
        F.sum(F.when(F.col("both"), (F.col("ds") - F.col("dt")) * (F.col("ds") - F.col("dt")))).alias("d2"),
        F.avg(F.when(F.col("both"), F.abs(F.col("ss") - F.col("st")))).alias("score_drift"),
    )
    n = F.col("n_both").cast("double")
    return sums.select(
        "query_id",
        F.coalesce(F.try_divide("n_hit", "n_s"), F.lit(0.0)).alias("recall_at_k"),
        F.coalesce(F.try_divide("dcg", "ideal"), F.lit(0.0)).alias("ndcg_at_k"),
        F.coalesce(F.try_divide("n_hit", "n_any"), F.lit(1.0)).alias("topk_overlap"),
        F.coalesce(F.try_divide(F.lit(1.0), "first"), F.lit(0.0)).alias("mrr"),
        F.when(n >= 2, 1.0 - 6.0 * F.col("d2") / F.nullif(n * (n * n - 1), F.lit(0.0))).alias("rank_correlation"),
        "score_drift",
    )


def equivalence(measures: DataFrame) -> DataFrame:
    """One row: the number of queries and the mean of each measure; 0 without queries, but null for the last two,
    whose means leave out the queries where they are null."""
    zero = lambda c: F.coalesce(F.avg(c), F.lit(0.0)).alias(c)
    return measures.agg(F.count("*").alias("sample_size"), zero("recall_at_k"), zero("ndcg_at_k"), zero("topk_overlap"), zero("mrr"), F.avg("rank_correlation").alias("rank_correlation"), F.avg("score_drift").alias("score_drift"))


def expected_recall(expected: DataFrame, target: DataFrame, k: int = 10) -> DataFrame:
    """``(query_id, expected_id_recall)``: share of the distinct expected ids ``(query_id, id)`` in the target's
    first k; queries that expect nothing have no row."""
    wanted = expected.select("query_id", "id").where("id is not null").distinct()
    found = wanted.join(target.where(F.col("rank") <= k).select("query_id", "id", F.lit(1).alias("hit")).distinct(), ["query_id", "id"], "left")
    return found.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("expected_id_recall"))


#: Thresholds of the default gate.
GATE = {"recall": 0.80, "ndcg": 0.90, "overlap_drop": 0.15, "latency_percent": 20.0}


def gate(metrics: DataFrame, recall: float = GATE["recall"], ndcg: float = GATE["ndcg"], overlap_drop: float = GATE["overlap_drop"], latency: Column | None = None, latency_percent: float | None = None) -> DataFrame:
    """``metrics`` with ``passed`` and ``reasons``: the thresholds missed, with values to four digits. A measure that
    is null or NaN misses its threshold."""
    def missed(value, bad, text):
        unknown = value.isNull() | F.isnan(value)
        return F.when(unknown | bad, F.concat(F.lit(text[0]), F.coalesce(F.format_string("%.4f", value), F.lit("null")), F.lit(text[1])))

    drop = 1.0 - F.col("topk_overlap")
    reasons = [
        missed(F.col("recall_at_k"), F.col("recall_at_k") < recall, ("recall ", f" < {recall}")),
        missed(F.col("ndcg_at_k"), F.col("ndcg_at_k") < ndcg, ("ndcg ", f" < {ndcg}")),
        missed(drop, drop > overlap_drop, ("overlap drop ", f" > {overlap_drop}")),
    ]
    if latency is not None and latency_percent is not None:
        reasons.append(F.when(latency > latency_percent, F.concat(F.lit("latency increase "), F.format_string("%.1f", latency), F.lit(f" > {latency_percent}"))))
    listed = metrics.withColumn("reasons", F.array_compact(F.array(*reasons)))
    return listed.withColumn("passed", F.size("reasons") == 0)
