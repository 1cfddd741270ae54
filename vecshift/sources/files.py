"""Collections kept as Parquet logs.

A collection is a folder of batches; a record's current form is in its newest batch. Writes append, so that a step of a
migration costs what it writes; a batch written again replaces itself; undoing batches removes their folders, which
brings the records they replaced back as they were. ``compact`` folds the log.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecshift.functions.current import current_rows
from vecshift.functions.staging import checkpoint
from vecshift.sources.contract import FALSE, RECORD, TRUE, ResourceInfo, Store

LOG = T.StructType([*RECORD.fields, T.StructField("deleted", T.BooleanType()), T.StructField("batch", T.LongType())])


class FileStore(Store):
    """Collections below a folder of any file system Spark can reach. ``endpoint`` is the folder."""

    provider = "files"
    abilities = {
        "connectivity": {"tls": FALSE},
        "data": {"list_vectors": TRUE, "scan_vectors": TRUE, "retrieve_vectors": TRUE, "retrieve_payload": TRUE, "cdc": FALSE},
        "representation": {"dimension": TRUE, "metric": TRUE, "datatype": TRUE, "dense_vectors": TRUE, "sparse_vectors": TRUE, "named_vectors": FALSE},
        "index": {"retrieve_config": FALSE, "configure_index": FALSE},
        "migration": {"resumable_scan": TRUE, "export": TRUE, "cdc": FALSE},
    }

    def __init__(self, spark: SparkSession, endpoint: str):
        super().__init__(spark)
        self.root = endpoint.rstrip("/")

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self, path):
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        path = self._path(name)
        return self._fs(path).exists(path)

    def _drop(self, name: str) -> None:
        path = self._path(name)
        self._fs(path).delete(path, True)

    def validate(self) -> bool:
        try:
            path = self._path("")
            return self._fs(path).exists(path) or self._fs(path).mkdirs(path)
        except Exception:
            return False

    def create(self, name: str, metric: str = "cosine", datatype: str = "float32", dimension: int | None = None) -> None:
        """Vectors of any dimension are taken; ``dimension`` isn't kept."""
        self.spark.createDataFrame([(json.dumps({"metric": metric, "datatype": datatype}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/{name}/about")

    def drop(self, name: str) -> None:
        self._drop(name)

    def log(self, name: str) -> DataFrame:
        """The collection's log: every written form of every record, with its batch."""
        if self._exists(f"{name}/folded"):
            self._settle(name)
        if not self._exists(f"{name}/log"):
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).parquet(f"{self.root}/{name}/log")

    def read(self, name: str, namespace: str | None = None) -> DataFrame:
        rows = self.log(name)
        if namespace is not None:
            rows = rows.where(F.col("namespace") == namespace)
        rows = rows.withColumn("__key", F.struct("namespace", "id"))
        return current_rows(rows, "__key", "batch", None).where(~F.col("deleted")).select(*RECORD.names)

    def info(self, name: str, namespace: str | None = None) -> ResourceInfo:
        about = {"metric": "unknown", "datatype": "unknown"}
        if self._exists(f"{name}/about"):
            about |= json.loads(self.spark.read.text(f"{self.root}/{name}/about").first()[0])
        row = self.read(name, namespace).agg(F.count("*").alias("n"), F.mode(F.nullif(F.size("vector"), F.lit(-1))).alias("d")).first()
        return ResourceInfo(name, row["d"] if row["d"] and row["d"] > 0 else None, about["metric"], about["datatype"], TRUE if about["datatype"] in ("int8", "binary") else FALSE, row["n"])

    def scan(self, name: str, size: int, cursor: str | None = None, namespace: str | None = None) -> tuple[DataFrame, str | None]:
        """Pages in order of (id, namespace), null namespaces first; the cursor holds both, as JSON."""
        rows = self.read(name, namespace).where("id is not null")
        if cursor is not None:
            last_id, last_space = json.loads(cursor)
            within = F.col("namespace").isNotNull() if last_space is None else F.col("namespace") > F.lit(last_space)
            rows = rows.where((F.col("id") > F.lit(last_id)) | (F.col("id") == F.lit(last_id)) & F.coalesce(within, F.lit(False)))
        rows = checkpoint(rows.orderBy("id", F.asc_nulls_first("namespace")).limit(size))
        last = rows.agg(F.count("*").alias("n"), F.max(F.struct("id", "namespace")).alias("last")).first()
        return rows, json.dumps([last["last"]["id"], last["last"]["namespace"]]) if last["n"] == size and size else None

    def fetch(self, name: str, ids: DataFrame, namespace: str | None = None) -> DataFrame:
        return self.read(name, namespace).join(ids.select("id").distinct(), "id", "left_semi")

    def batches(self, name: str) -> list[int]:
        """The numbers of the batches in the log, in order."""
        path = self._path(f"{name}/log")
        if not self._fs(path).exists(path):
            return []
        return sorted(int(f.getPath().getName().split("=")[1]) for f in self._fs(path).listStatus(path) if f.getPath().getName().startswith("batch="))

    def _owner(self, name: str, batch: int) -> str | None:
        path = f"{name}/owners/batch={int(batch)}"
        return self.spark.read.text(f"{self.root}/{path}").first()[0] if self._exists(path) else None

    def reserve(self, name: str, owner: str) -> int:
        """A batch number above all others of the collection, which only ``owner`` may write; the one it
        holds and hasn't written yet, if there is one."""
        taken, path = set(self.batches(name)), self._path(f"{name}/owners")
        held = [int(f.getPath().getName().split("=")[1]) for f in self._fs(path).listStatus(path)] if self._fs(path).exists(path) else []
        for batch in held:
            if batch not in taken and self._owner(name, batch) == owner:
                return batch
        batch = max([0, *taken, *held]) + 1
        self.spark.createDataFrame([(owner,)], "value string").coalesce(1).write.text(f"{self.root}/{name}/owners/batch={batch}")
        return batch

    def _append(self, name: str, rows: DataFrame, batch: int, owner: str | None) -> int:
        holder = self._owner(name, batch)
        if holder is not None and holder != owner:
            raise ValueError(f"batch {batch} of {name!r} is held by {holder!r}")
        target = f"{self.root}/{name}/log/batch={int(batch)}"
        rows.write.mode("overwrite").parquet(target)
        return self.spark.read.schema(rows.schema).parquet(target).count()

    def upsert(self, name: str, records: DataFrame, batch: int, namespace: str | None = None, owner: str | None = None) -> int:
        """Records without an id can't be kept and are refused. Of rows repeated within the batch one is kept. A batch that
        another owner reserved is refused."""
        if not records.where("id is null").isEmpty():
            raise ValueError("records without an id")
        known = set(records.columns)
        columns = [(F.col(f.name).cast(f.dataType) if f.name in known else F.lit(None).cast(f.dataType)).alias(f.name) for f in RECORD.fields]
        rows = records.select(*columns)
        if namespace is not None:
            rows = rows.withColumn("namespace", F.lit(namespace))
        rows = rows.dropDuplicates(["namespace", "id"])
        return self._append(name, rows.withColumn("deleted", F.lit(False)), batch, owner)

    def delete(self, name: str, ids: DataFrame, batch: int, namespace: str | None = None, owner: str | None = None) -> int:
        gone = self.fetch(name, ids, namespace).select("id", "namespace")
        columns = [(F.col(f.name) if f.name in ("id", "namespace") else F.lit(None).cast(f.dataType)).alias(f.name) for f in RECORD.fields]
        return self._append(name, gone.select(*columns).withColumn("deleted", F.lit(True)), batch, owner)

    def undo(self, name: str, batches: list[int]) -> None:
        """Remove batches: the collection is as if they had never been written."""
        for batch in batches:
            self._drop(f"{name}/log/batch={int(batch)}")
            self._drop(f"{name}/owners/batch={int(batch)}")

    def compact(self, name: str, batch: int = 0) -> None:
        """Fold the log into one batch. What was replaced or deleted can't be brought back after that.

        The folded log is whole before the old one moves away, and the old one is there until the new one is in its
        place, so a failure at any point loses nothing (``_settle``)."""
        self._settle(name)
        self.read(name).withColumn("deleted", F.lit(False)).write.mode("overwrite").parquet(f"{self.root}/{name}/folding/batch={int(batch)}")
        self._move(f"{name}/folding", f"{name}/folded")  # from here on the fold is complete
        self._settle(name)

    def _move(self, old: str, new: str) -> None:
        path = self._path(old)
        if not self._fs(path).rename(path, self._path(new)):
            raise OSError(f"{old} can't be moved to {new}")

    def _settle(self, name: str) -> None:
        """Carry on what a broken-off ``compact`` left: a complete fold takes the place of the log."""
        if self._exists(f"{name}/folded"):
            if self._exists(f"{name}/log"):
                self._drop(f"{name}/replaced")
                self._move(f"{name}/log", f"{name}/replaced")
            self._move(f"{name}/folded", f"{name}/log")
        self._drop(f"{name}/replaced")
        self._drop(f"{name}/folding")
