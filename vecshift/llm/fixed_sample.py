"""A uniform sample of fixed size from data of unknown length that arrives in pieces (problem 1).

Arriving pieces are staged as files in the shared folder. After the arrival has ended the staged records are
made distinct and written once more, as numbered pieces; the records of each resource in each piece are
counted, distinct global ranks are drawn uniformly, and the records at these ranks are fetched through the
prefix sums of the counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecshift.functions.staging import broadcast_within, checkpoint, stage, staging_path
from vecshift.llm.stable_sample import DEFAULT_SEED

#: Ranks drawn at once; a longer draw is spread over several rows.
PART_RANKS = 500_000
#: Rounds of the permutation's Feistel network.
ROUNDS = 6
#: Rows up to which the prefix sums and the drawn ranks are broadcast; beyond, both are joined by shuffle.
OFFSET_ROWS, RANK_ROWS = 200_000, 500_000


class PieceStage:
    """Collects pieces of unknown number and size; ``finish`` makes them one table to draw from.

    ``add`` takes a DataFrame with ``resource_name, id`` and any other columns, one piece (or micro-batch) after
    the other. A task that is repeated writes its part again, never twice."""

    def __init__(self, spark: SparkSession, key: tuple[str, ...] = ("resource_name", "id"), newest: str | None = None):
        self.spark, self.key, self.newest = spark, key, newest
        self.path, self.schema = staging_path(spark, "pieces"), None

    def add(self, piece: DataFrame) -> None:
        self.schema = self.schema or piece.schema
        piece.select(*self.schema.names).write.mode("append").parquet(self.path)

    def finish(self) -> StagedRecords:
        """One row per key: of several, the one with the greatest ``newest`` (a struct column)."""
        if self.schema is None:
            raise ValueError("no piece has arrived")
        rows = self.spark.read.schema(self.schema).parquet(self.path)
        rest = F.struct(*([self.newest] if self.newest else []), *[c for c in self.schema.names if c not in self.key and c != self.newest])
        one = rows.where(" and ".join(f"{k} is not null" for k in self.key)).groupBy(*self.key).agg(F.max(rest).alias("__rest"))
        kept = [c for c in self.schema.names if c not in self.key and c != self.newest]
        return StagedRecords(one.select(*self.key, *[F.col(f"__rest.{c}").alias(c) for c in kept]))


class StagedRecords:
    """Distinct records in numbered pieces, each piece ordered by resource."""

    def __init__(self, records: DataFrame):
        staged = stage(records.sortWithinPartitions("resource_name", "id"), "staged")
        self.columns = staged.columns
        self.records = staged.select("*", F.col("_metadata.file_name").alias("__piece"), F.col("_metadata.row_index").alias("__row"))
        # one small row per piece and resource; the rows of a resource lie side by side in a piece
        self.counts = checkpoint(self.records.groupBy("resource_name", "__piece").agg(F.count("*").alias("n"), F.min("__row").alias("first")))

    def totals(self) -> DataFrame:
        """``(resource_name, records)``: the distinct records of each resource."""
        return self.counts.groupBy("resource_name").agg(F.sum("n").alias("records"))

    def draw(self, contexts: DataFrame) -> DataFrame:
        """``(context_id, resource_name, rank, ...)``: ``sample_size`` records of each context's resource.

        contexts: ``context_id, resource_name, seed, sample_size``; repeated rows count once. Ranks number the
        records of a resource from 0. The ranks drawn are the first values of a random permutation keyed by
        the seed and the resource: distinct, each equally likely, made without a list of all ranks. If there are fewer
        records than wished all come out; null or negative sizes and resources without records draw none."""
        size = F.least(F.coalesce("sample_size", F.lit(0)).cast("bigint"), F.col("records"))
        asked = contexts.select("context_id", "resource_name", F.coalesce("seed", F.lit(DEFAULT_SEED)).cast("bigint").alias("seed"), "sample_size").distinct()
        asked = asked.join(self.totals(), "resource_name").withColumn("size", size).where("size > 0")
        parts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("size") - 1) / PART_RANKS)))
        # resources of one size draw independently of each other; contexts of one seed and resource draw the same
        key = F.xxhash64("seed", "resource_name").alias("seed")
        ranks = asked.select("context_id", "resource_name", key, "records", "size", parts.alias("part")).mapInArrow(_draw, "context_id bigint, resource_name string, rank bigint")
        before = Window.partitionBy("resource_name").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
        offsets = self.counts.select("resource_name", "__piece", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
        ranked = self.records.join(broadcast_within(offsets, OFFSET_ROWS), ["resource_name", "__piece"]).withColumn("rank", F.col("__row") + F.col("shift"))
        kept = [c for c in self.columns if c != "resource_name"]
        return ranked.join(broadcast_within(ranks, RANK_ROWS), ["resource_name", "rank"]).select("context_id", "resource_name", "rank", *kept)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, total: int, seed: int) -> np.ndarray:
    """The values at ``index`` of a permutation of ``range(total)`` keyed by ``seed``: a balanced Feistel
    network over the next power of four, walked until the value falls below ``total``."""
    half = np.uint64(max(1, (max(total - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = _mix(np.uint64(seed & (2**64 - 1)) + np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    value, out = index.astype(np.uint64), np.zeros(len(index), np.int64)
    waiting = np.arange(len(index))
    while len(waiting):
        left, right = value >> half, value & mask
        for key in keys:
            left, right = right, left ^ (_mix(right + key) & mask)
        value = (left << half) | right
        inside = value < np.uint64(total)
        out[waiting[inside]] = value[inside].astype(np.int64)
        waiting, value = waiting[~inside], value[~inside]
    return out


def _draw(batches):
    for batch in batches:
        for row in batch.to_pylist():
            low = row["part"] * PART_RANKS
            index = np.arange(low, min(low + PART_RANKS, row["size"]))
            rank = permuted(index, row["records"], row["seed"])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(index), row["context_id"])), pa.array([row["resource_name"]] * len(index), pa.string()), pa.array(rank)], names=["context_id", "resource_name", "rank"])


def page_records(pages: DataFrame) -> DataFrame:
    """The records of scan pages, with the page and place they were received at; broken pages have none."""
    rows = pages.select("resource_name", F.struct("scanned_at", "scan_id", "page_no", "attempt").alias("page"), F.posexplode("records").alias("place", "record"))
    return rows.select("resource_name", F.col("record.id").alias("id"), F.struct("page", "place").alias("received"), F.col("record.namespace").alias("namespace"), F.col("record.payload").alias("payload"))


def sample_pages(pages: DataFrame, contexts: DataFrame) -> DataFrame:
    """``(context_id, resource_name, rank, id, namespace, payload)``: for each context a uniform sample of the
    distinct records in the pages of its resource, each in the form received last.

    Pages may come repeatedly, overlap or be null; records without an id are left out. How many records a
    resource holds is counted, never taken from its metadata."""
    stage_of_pages = PieceStage(pages.sparkSession, newest="received")
    stage_of_pages.add(page_records(pages))
    return stage_of_pages.finish().draw(contexts)


def sample_report(pages: DataFrame, contexts: DataFrame, infos: DataFrame) -> DataFrame:
    """``(context_id, resource_name, wished, records, drawn, reported)``: for each context the wished and the
    drawn number of records, the records there are, and the count the resource last reported of itself."""
    staged = PieceStage(pages.sparkSession, newest="received")
    staged.add(page_records(pages))
    totals = staged.finish().totals()
    latest = infos.groupBy(F.col("name").alias("resource_name")).agg(F.max_by("approximate_count", F.struct("observed_at", "approximate_count")).alias("reported"))
    asked = contexts.select("context_id", "resource_name", F.coalesce("sample_size", F.lit(0)).cast("bigint").alias("wished")).distinct()
    joined = asked.join(totals, "resource_name", "left").join(latest, "resource_name", "left").withColumn("records", F.coalesce("records", F.lit(0)))
    return joined.select("context_id", "resource_name", "wished", "records", F.greatest(F.least("wished", "records"), F.lit(0)).alias("drawn"), "reported")
