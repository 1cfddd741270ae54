"""Keeping a target collection in step with a stream of records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from vecshift.operators.migrate import latest, resolve
from vecshift.sources.contract import Store


def sync(stream: DataFrame, store: Store, name: str, checkpoint: str, policy: str = "overwrite", transform: Callable[[DataFrame], DataFrame] | None = None, first_batch: int = 1, namespace: str | None = None, version: str | None = None, once: bool = True) -> StreamingQuery:
    """Write each micro-batch of records into a collection.

    Within a micro-batch the latest version of an id counts. The batch number is that of the stream, shifted by
    ``first_batch``, and stores replace a batch that comes again, so every record is written once whatever fails;
    what this stream wrote before is no collision. ``once``: take what is there, in bounded micro-batches, and stop."""

    def write(records: DataFrame, number: int) -> None:
        rows = latest(records.where("id is not null"), "id", version, None)
        rows = transform(rows) if transform else rows
        if policy != "overwrite":
            log = getattr(store, "log", None)
            written = log(name).where(f"batch >= {first_batch}").select("id") if log else None
            rows = resolve(rows, store.read(name, namespace), policy, "id", written)
        store.upsert(name, rows, first_batch + number, namespace)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
