"""Scan pages kept as JSON files, one page each: ``{"records": [{"id", "namespace", "vector", "payload"}, ...]}``.

Read in batch or as a stream of pages. Spark's own file source lists and reads the files, of any file system its
executors reach, and keeps a log of those seen in the query's checkpoint, which takes the place of a scan cursor: a page that comes
late is read whatever its name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = "records array<struct<id: string, namespace: string, vector: array<float>, payload: string>>"


def _records(files: DataFrame) -> DataFrame:
    """``(id, namespace, vector, payload, page)``; a page that is no JSON, or whose records are null, has none."""
    rows = files.select(F.from_json("value", PAGE).alias("page"), F.col("_metadata.file_name").alias("name"))
    rows = rows.select(F.explode("page.records").alias("r"), "name").where("r is not null")
    return rows.select("r.id", "r.namespace", "r.vector", F.coalesce("r.payload", F.lit("{}")).alias("payload"), F.col("name").alias("page"))


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    return _records(spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True))


def stream_pages(spark: SparkSession, folder: str, pages_a_batch: int | None = None) -> DataFrame:
    """The pages as they come; ``pages_a_batch`` bounds a micro-batch."""
    reader = spark.readStream.option("pathGlobFilter", "*.json").option("wholetext", "true")
    return _records((reader.option("maxFilesPerTrigger", pages_a_batch) if pages_a_batch else reader).text(folder))
