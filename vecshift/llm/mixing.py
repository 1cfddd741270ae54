"""Mixtures of sources by target weights (problem 7).

Tokens are summed by source and bucket of a document hash. For each (mix, source) the budget is used up by
whole copies of the source as far as allowed, and a last partial copy: the documents whose hash lies below
a threshold. The threshold is found in the histogram: the bucket in which the running sum passes the budget
is cut into finer buckets, and so on, until it holds one hash; only its documents are read again. All
thresholds cut the same hash order, so a smaller budget's documents are among a larger one's. The selection
itself is a filter; documents are never sorted.
"""

from __future__ import annotations

import base64
import functools

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecshift.functions.staging import broadcast_within, checkpoint

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern published with the vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bits of the 60-bit document hash, and bits resolved by one histogram.
HASH_BITS, STEP_BITS = 60, 10
#: Rows of the table of targets up to which it is broadcast.
TARGET_ROWS = 100_000


@functools.cache
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("mixing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, path: str = TOKENIZER) -> int:
    """Tokens of a whole text; null has none."""
    return len(_encoding(path).encode_ordinary(text)) if text else 0


def plain_source(column) -> F.Column:
    """The plain form of a source name: trimmed, lower case, blanks and hyphens as ``_``."""
    return F.regexp_replace(F.lower(F.trim(column)), r"[\s-]+", "_")


def token_table(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(doc_id, source, tokens, place)``: ``place`` is a 60-bit hash of the id. Documents without an id,
    a source or any token can't be part of a mixture and are left out; repeated ids count once."""

    def tokens(batches):
        for batch in batches:
            counts = [count_tokens(t, tokenizer) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["doc_id", "source", "tokens"])

    rows = documents.where("doc_id is not null and source is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), plain_source(F.col("source")).alias("source"), "text")
    counted = rows.mapInArrow(tokens, "doc_id bigint, source string, tokens bigint").where("tokens > 0")
    one = counted.groupBy("doc_id").agg(F.min(F.struct("source", "tokens")).alias("doc"))
    return one.select("doc_id", "doc.source", "doc.tokens", F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - HASH_BITS).alias("place"))


def budgets(targets: DataFrame, available: DataFrame) -> DataFrame:
    """``(mix_id, source, share, budget, available, copies, rest)``: each source's share of the wished size, the
    whole copies it takes, and the tokens left for a partial one (0 where the limit of repeats is reached).

    Null or negative weights are 0, null sizes 0; a source listed twice in a mix has the sum of its weights
    and the smaller limit. A null ``max_repeats`` is no limit, one below 1 keeps the source out."""
    weight = F.greatest(F.coalesce("target_weight", F.lit(0.0)), F.lit(0.0))
    limit = F.coalesce("max_repeats", F.lit(2**31 - 1))
    rows = targets.where("mix_id is not null and source is not null").distinct().groupBy("mix_id", plain_source(F.col("source")).alias("source")).agg(F.sum(F.when(F.isnan(weight), 0.0).otherwise(weight)).alias("weight"), F.min(limit).alias("limit"), F.max(F.coalesce("total_tokens", F.lit(0))).alias("total"))
    mix = Window.partitionBy("mix_id")
    rows = rows.withColumn("share", F.coalesce(F.try_divide("weight", F.sum("weight").over(mix)), F.lit(0.0))).withColumn("budget", F.floor(F.col("share") * F.greatest("total", F.lit(0))))
    rows = rows.join(available, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    whole = F.least(F.coalesce(F.expr("budget div nullif(available, 0)"), F.lit(0)), F.greatest("limit", F.lit(0)).cast("bigint"))
    rows = rows.withColumn("copies", whole)
    rest = F.when((F.col("copies") < F.col("limit")) & (F.col("available") > 0), F.col("budget") - F.col("copies") * F.col("available")).otherwise(0)
    return rows.select("mix_id", "source", "share", "budget", "available", "copies", rest.alias("rest"))


def thresholds(tokens: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` with ``below``: the documents of the source with ``place < below`` are the most whose tokens
    fit into ``rest``. Each round sums, by STEP_BITS more bits, the documents of the boundary buckets only, which from the
    second round on are all that is kept."""
    open_ = wanted.where("rest > 0").select("mix_id", "source", "rest", F.lit(0).cast("bigint").alias("prefix"))
    for shift in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        bounds = open_.select("source", "prefix").distinct()
        inside = tokens.select("source", "tokens", "place", F.shiftright("place", shift + STEP_BITS).alias("prefix")).join(broadcast_within(bounds, TARGET_ROWS), ["source", "prefix"])
        if shift < HASH_BITS - STEP_BITS:
            inside = tokens = checkpoint(inside)
        sums = inside.groupBy("source", "prefix", F.shiftright("place", shift).alias("bucket")).agg(F.sum("tokens").alias("tokens"))
        running = Window.partitionBy("source", "prefix").orderBy("bucket")
        sums = sums.withColumn("upto", F.sum("tokens").over(running))
        # the first bucket whose running sum exceeds the rest is refined; the buckets before it are taken
        over = open_.join(sums, ["source", "prefix"]).where("upto > rest").groupBy("mix_id", "source").agg(F.min_by(F.struct("bucket", (F.col("rest") - F.col("upto") + F.col("tokens")).alias("rest")), "bucket").alias("next"))
        open_ = checkpoint(over.select("mix_id", "source", "next.rest", F.col("next.bucket").alias("prefix")))
    return wanted.join(open_.select("mix_id", "source", F.col("prefix").alias("below")), ["mix_id", "source"], "left").withColumn("below", F.coalesce("below", F.lit(0)))


class Mixture:
    """The mixtures of ``targets`` over ``documents``; tokens are counted once."""

    def __init__(self, documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER):
        self.tokens = checkpoint(token_table(documents, tokenizer))
        available = self.tokens.groupBy("source").agg(F.sum("tokens").alias("available"))
        self.plan = checkpoint(thresholds(self.tokens, budgets(targets, available)))

    def selection(self) -> DataFrame:
        """``(mix_id, doc_id, source, tokens, repeats)``: the documents of each mix and how often each is used."""
        rows = self.tokens.join(broadcast_within(self.plan.select("mix_id", "source", "copies", "below"), TARGET_ROWS), "source")
        repeats = F.col("copies") + (F.col("place") < F.col("below")).cast("bigint")
        return rows.withColumn("repeats", repeats).where("repeats > 0").select("mix_id", "doc_id", "source", "tokens", "repeats")

    def shares(self) -> DataFrame:
        """``(mix_id, source, target_share, budget, available, tokens, documents, max_repeats_used, actual_share)``."""
        used = self.selection().groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("max_repeats_used"))
        rows = self.plan.join(used, ["mix_id", "source"], "left").fillna(0, ["tokens", "documents", "max_repeats_used"])
        actual = F.coalesce(F.try_divide("tokens", F.sum("tokens").over(Window.partitionBy("mix_id"))), F.lit(0.0))
        return rows.select("mix_id", "source", F.col("share").alias("target_share"), "budget", "available", "tokens", "documents", "max_repeats_used", actual.alias("actual_share"))
