"""Exact top-k search of a query set in a collection, and its variants.

The query set is taken in blocks small enough to be broadcast; every partition of the collection computes the
block's scores by matrix products and keeps the k best of each query, so what is shuffled is the number of
partitions times the queries times k rows, whatever the collection's size. A window ranks these. Ties go to the smaller id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecshift.functions.vectors import LEAST_NORM, is_usable, prefix, renormalize

METRICS = ("cosine", "dot", "euclidean", "manhattan")
#: Queries broadcast at a time.
BLOCK_QUERIES = 4_096
#: Scores held at a time.
BLOCK_SCORES = 4_000_000


def scores(queries: np.ndarray, corpus: np.ndarray, metric: str) -> np.ndarray:
    """(queries, corpus) of scores; greater is nearer: distances come negated."""
    if metric == "dot":
        return queries @ corpus.T
    if metric == "cosine":
        q = queries / np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), LEAST_NORM)
        c = corpus / np.maximum(np.linalg.norm(corpus, axis=1, keepdims=True), LEAST_NORM)
        return q @ c.T
    if metric == "euclidean":
        return -np.sqrt(np.stack([np.square(corpus - q).sum(1) for q in queries]))
    if metric == "manhattan":
        return -np.stack([np.abs(corpus - q).sum(1) for q in queries])
    raise ValueError(f"metric must be one of {METRICS}, got {metric!r}")


def _best(score: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """The places of the k greatest scores of each row, best first, ties by the least ``order`` (one of each place);
    rows of places."""
    if score.shape[1] > k:
        kth = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
        row, place = np.nonzero(score >= kth)
    else:
        row, place = np.divmod(np.arange(score.size), max(score.shape[1], 1))
    sort = np.lexsort((order[row, place], -score[row, place], row))
    row, place = row[sort], place[sort]
    return place[np.arange(len(row)) - np.searchsorted(row, row) < k].reshape(len(score), -1)


def knn(corpus: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", id_column: str = "id", vector: str = "vector", same: str | None = None, narrow: Sketch | None = None) -> DataFrame:
    """``(query_id, id, score, rank)``: for each query its k nearest rows of ``corpus``, itself included if it is one.

    Both sides: ``id_column`` and ``vector``; rows whose vector is null, empty or not finite are no candidates and no
    queries, and a query's candidates are the rows of its length: queries of each length are searched apart. ``same`` names a column that candidate and query must
    share (a namespace); ``narrow`` keeps some rows of each batch for exact ranking (``ann``). ``score`` is the similarity, or the distance for euclidean and manhattan. Rows
    repeated with an id count as often as they are there."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, got {metric!r}")
    spark = corpus.sparkSession
    kind = corpus.schema[id_column].dataType.simpleString()
    columns = [F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("vector"), (F.col(same).cast("string") if same else F.lit("")).alias("same")]
    good = F.size(F.filter("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))) == 0
    asked = queries.select(*columns).where(good & F.col("id").isNotNull()).where(F.size("vector") > 0)
    held = corpus.select(*columns).where(good & F.col("id").isNotNull())
    sizes = asked.groupBy(F.size("vector").alias("d")).count().collect()  # one row for each length
    out_schema = f"query_id {kind}, id {kind}, score double"
    found = spark.createDataFrame([], out_schema)
    for dimension, count in sizes:
        mine, candidates = asked.where(F.size("vector") == dimension), held.where(F.size("vector") == dimension)
        blocks = max(1, -(-count // BLOCK_QUERIES))
        for block in range(blocks):
            rows = mine.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).toArrow()
            if rows.num_rows:
                found = found.unionByName(candidates.mapInArrow(_searcher(spark.sparkContext.broadcast(rows), k, metric, dimension, narrow), out_schema))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    score = -F.col("score") if metric in ("euclidean", "manhattan") else F.col("score")
    return ranked.select("query_id", "id", score.alias("score"), F.col("rank").cast("bigint").alias("rank"))


def _searcher(shared, k: int, metric: str, dimension: int, narrow: Sketch | None):
    def search(batches):
        rows = shared.value
        vectors = rows["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
        spaces = np.array(rows["same"].to_pylist(), object)
        kept = {space: [np.flatnonzero(spaces == space), None, None] for space in set(spaces)}
        number = None
        for batch in batches:
            corpus = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
            ids, space_of = batch.column(0), np.array(batch.column(2).to_pylist(), object) if len(kept) > 1 or "" not in kept else None
            for space, best in kept.items():
                own = best[0]
                inside = np.arange(len(corpus)) if space_of is None else np.flatnonzero(space_of == space)
                step = max(1, BLOCK_SCORES // max(len(own), 1))
                for start in range(0, len(inside), step):
                    at = inside[start : start + step]
                    names = ids.take(pa.array(at))
                    if narrow is None:
                        score = scores(vectors[own], corpus[at], metric)
                        chosen = np.broadcast_to(np.arange(len(at)), score.shape)
                    else:
                        chosen, number = narrow(vectors[own], corpus[at], number)
                        score = np.einsum("qd,qnd->qn", vectors[own], corpus[at][chosen]) if chosen.shape[1] < len(at) else scores(vectors[own], corpus[at], metric)
                    # the running lists of all queries, then the new rows: places in one column of ids
                    flat = names if best[1] is None else pa.concat_arrays([best[2], names])
                    place = chosen + (len(flat) - len(at))
                    if best[1] is not None:
                        score = np.concatenate([best[1], score], axis=1)
                        place = np.concatenate([np.arange(best[1].size).reshape(best[1].shape), place], axis=1)
                    rank = np.empty(len(flat), np.int64)
                    rank[pc.sort_indices(flat).to_numpy()] = np.arange(len(flat))
                    # equal ids have equal ranks only if the sort says so; their order doesn't matter
                    chosen = _best(score, rank[place], k)
                    best[1] = np.take_along_axis(score, chosen, 1)
                    best[2] = flat.take(pa.array(np.take_along_axis(place, chosen, 1).ravel()))
        for own, score, names in kept.values():
            if score is not None:
                yield pa.RecordBatch.from_arrays([rows["id"].combine_chunks().take(pa.array(np.repeat(own, score.shape[1]))), names, pa.array(score.ravel())], names=["query_id", "id", "score"])

    return search


def two_stage(corpus: DataFrame, queries: DataFrame, k: int, shortlist: int, dimension: int, id_column: str = "id", vector: str = "vector") -> DataFrame:
    """``(query_id, id, score, rank)``: a shortlist by the cosine of vector prefixes, ranked again by the full cosine."""
    short = lambda df: df.select(id_column, renormalize(prefix(F.col(vector), dimension)).alias(vector))
    listed = knn(short(corpus), short(queries), shortlist, "cosine", id_column, vector).select("query_id", "id")
    from vecshift.functions.vectors import cosine

    q = queries.select(F.col(id_column).alias("query_id"), F.col(vector).alias("q"))
    c = corpus.select(F.col(id_column).alias("id"), F.col(vector).alias("c"))
    scored = listed.join(q, "query_id").join(c, "id").select("query_id", "id", cosine(F.col("q"), F.col("c")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k)


@dataclass(frozen=True)
class Sketch:
    """Narrows the rows of a batch by their products within ``dimension`` random directions (the same for all tasks).

    How many are kept is found out on the batch itself: enough that ``recall`` of the exact nearest ``k`` of some of the queries
    are among them, at worst all."""

    k: int
    recall: float
    dimension: int
    seed: int = 42

    def __call__(self, queries: np.ndarray, corpus: np.ndarray, kept: int | None) -> tuple[np.ndarray, int]:
        """(places of the rows kept for each query, their number, to be given again with the next batch)."""
        n = len(corpus)
        turn = np.linalg.qr(np.random.default_rng(self.seed).normal(size=(queries.shape[1], queries.shape[1])))[0][:, : self.dimension]
        near = (queries @ turn) @ (corpus @ turn).T
        if kept is None:
            probe = np.arange(0, len(queries), max(1, len(queries) // PROBED))
            best = np.argpartition(-(queries[probe] @ corpus.T), min(self.k, n - 1), axis=1)[:, : self.k]
            order = np.argsort(np.argsort(-near[probe], axis=1), axis=1)
            place = np.sort(np.take_along_axis(order, best, axis=1).ravel())
            kept = 2 * int(place[min(int(np.ceil(self.recall * len(place))), len(place) - 1)]) + self.k
        if kept >= n:
            return np.broadcast_to(np.arange(n), near.shape), kept
        return np.argpartition(-near, kept - 1, axis=1)[:, :kept], kept


#: Queries of a task on which the number of kept rows is found out.
PROBED = 32


def ann(corpus: DataFrame, queries: DataFrame, k: int, id_column: str = "id", vector: str = "vector", recall: float = 0.97) -> DataFrame:
    """``(query_id, id, distance, rank)``: approximate search of unit vectors by random sketches of half their length.

    Every row is looked at through its sketch; those kept are ranked exactly in the same task, so that the plan is that of ``knn``,
    with one pass and no shuffle but of the best. ``recall`` is what the sketches are made to reach, see ``Sketch``."""
    unit = lambda df: df.where(is_usable(F.col(vector))).select(F.col(id_column).alias("id"), renormalize(F.col(vector)).alias("vector"))
    longest = queries.agg(F.max(F.size(vector))).first()[0] or 2
    found = knn(unit(corpus), unit(queries), k, "dot", narrow=Sketch(k, recall, max(1, longest // 2)))
    return found.select("query_id", "id", F.sqrt(F.greatest(2 - 2 * F.col("score"), F.lit(0.0))).alias("distance"), "rank")


def in_namespace(records: DataFrame, namespace: Column | str) -> DataFrame:
    """The records of one namespace; the comparison reaches the scan."""
    return records.where(F.col("namespace") == namespace)
