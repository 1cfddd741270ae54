"""Where intermediate results live, and how large a side may be broadcast."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a counted side is broadcast; wider rows pass a smaller bound.
BROADCAST_ROWS = 1_000_000

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else the checkpoint folder set in the context. Where
    neither is set (tests, one machine) a temporary folder is made and set as the checkpoint folder, and removed when
    the driver ends; on a cluster that is refused."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    app = context.applicationId
    if app not in _own_dir:
        kept = context.getCheckpointDir()
        if kept:
            return kept.rstrip("/")
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        _own_dir[app] = tempfile.mkdtemp(prefix="vecshift-")
        context.setCheckpointDir(_own_dir[app])
        atexit.register(shutil.rmtree, _own_dir[app], ignore_errors=True)
    return _own_dir[app]


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone at exit
        pass


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again."""
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def within(df: DataFrame, max_rows: int) -> DataFrame | None:
    """``df``, evaluated once into a checkpoint, if it has at most ``max_rows`` rows, else null."""
    few = checkpoint(df.limit(max_rows + 1))
    return few if few.count() <= max_rows else None


def broadcast_within(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``max_rows`` rows, else unmarked, so that the join shuffles.

    What is broadcast is a checkpoint of its rows; only a side beyond the bound is evaluated again."""
    few = within(df, max_rows)
    return df if few is None else F.broadcast(few)
