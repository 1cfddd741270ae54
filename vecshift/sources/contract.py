"""What every store of collections offers, and what is known of its abilities."""

from __future__ import annotations

import os
import uuid
from abc import ABC, abstractmethod
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TRUE, FALSE, UNKNOWN = "TRUE", "FALSE", "UNKNOWN"

#: Records as all stores give and take them. Sparse vectors are carried along.
RECORD = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("namespace", T.StringType()),
        T.StructField("vector", T.ArrayType(T.FloatType())),
        T.StructField("sparse_indices", T.ArrayType(T.IntegerType())),
        T.StructField("sparse_values", T.ArrayType(T.FloatType())),
        T.StructField("payload", T.StringType()),
    ]
)

# The groups of abilities; what isn't reported is unknown, never false.
CAPABILITIES = {
    "connectivity": ("connect", "tls"),
    "data": ("list_vectors", "scan_vectors", "retrieve_vectors", "retrieve_payload", "retrieve_documents", "cdc"),
    "representation": ("dimension", "metric", "datatype", "dense_vectors", "sparse_vectors", "named_vectors", "normalization", "embedding_model", "quantized_storage"),
    "index": ("retrieve_config", "configure_index"),
    "migration": ("resumable_scan", "export", "cdc"),
}


@dataclass(frozen=True)
class ResourceInfo:
    name: str
    dimension: int | None
    metric: str
    datatype: str
    quantized: str
    count: int | None


class CredentialError(RuntimeError):
    """A named secret is not there."""


def resolve_secret(reference: str | None) -> str | None:
    """The environment variable of that name, if set, else the text itself. Only ever used on the driver."""
    return os.environ.get(reference, reference) if reference else reference


def require_secret(reference: str) -> str:
    if not os.environ.get(reference):
        raise CredentialError(f"environment variable {reference!r} is not set")
    return os.environ[reference]


class Store(ABC):
    """A store of named collections. Bulk reads and writes are DataFrames; nothing is collected."""

    provider: str
    abilities: dict[str, dict[str, str]] = {}

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __getstate__(self):
        """Without the session: what executors get of a store."""
        return {k: v for k, v in self.__dict__.items() if k != "spark"}

    @abstractmethod
    def validate(self) -> bool:
        """Whether the store can be reached; errors count as no."""

    def capabilities(self) -> DataFrame:
        """``(provider, group, capability, state)``, one row per ability; ``connect`` is measured."""
        rows = []
        for group, names in CAPABILITIES.items():
            for name in names:
                state = self.abilities.get(group, {}).get(name, UNKNOWN)
                rows.append((self.provider, group, name, (TRUE if self.validate() else FALSE) if name == "connect" else state))
        return self.spark.createDataFrame(rows, "provider string, `group` string, capability string, state string")

    @abstractmethod
    def info(self, name: str, namespace: str | None = None) -> ResourceInfo: ...

    @abstractmethod
    def read(self, name: str, namespace: str | None = None) -> DataFrame:
        """All records, as RECORD."""

    @abstractmethod
    def scan(self, name: str, size: int, cursor: str | None = None, namespace: str | None = None) -> tuple[DataFrame, str | None]:
        """The next ``size`` records and the cursor after them, null at the end."""

    @abstractmethod
    def fetch(self, name: str, ids: DataFrame, namespace: str | None = None) -> DataFrame:
        """The records whose id is in the column ``id`` of ``ids``."""

    @abstractmethod
    def upsert(self, name: str, records: DataFrame, batch: int, namespace: str | None = None) -> int:
        """Write records, replacing those of the same (namespace, id). Writing a batch again changes nothing."""

    @abstractmethod
    def delete(self, name: str, ids: DataFrame, batch: int, namespace: str | None = None) -> int: ...

    @abstractmethod
    def create(self, name: str, metric: str = "cosine", datatype: str = "float32", dimension: int | None = None) -> None: ...

    @abstractmethod
    def drop(self, name: str) -> None: ...

    def query(self, name: str, queries: DataFrame, k: int = 10, width: int | None = None, namespace: str | None = None) -> DataFrame:
        """``(query_id, id, score, rank)``: the k nearest records of each query ``(id, vector)``, by the collection's metric.

        ``width`` is the search width of stores with an approximate index: how many candidates a search looks at.
        Stores without one search exactly."""
        from vecshift.operators.knn import METRICS, knn

        metric = self.info(name, namespace).metric
        return knn(self.read(name, namespace), queries, k, metric if metric in METRICS else "cosine")

    @contextmanager
    def ephemeral(self, metric: str = "cosine", dimension: int | None = None):
        """The name of a new collection, dropped at the end of the block whatever happens in it."""
        name = f"ephemeral_{uuid.uuid4().hex}"
        self.create(name, metric, dimension=dimension)
        try:
            yield name
        finally:
            self.drop(name)

    def sample(self, name: str, n: int, namespace: str | None = None) -> DataFrame:
        """The first ``n`` records in scan order."""
        return self.scan(name, n, None, namespace)[0]

    def close(self) -> None:
        """Let go of connections."""

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()


def build_store(spark: SparkSession, provider: str, endpoint: str | None = None, credential: str | None = None, **options) -> Store:
    """The store of a provider, by its name in any case: ``files``, ``memory`` (files in the shared folder, gone when the
    driver ends) or one of the remote kinds."""
    from vecshift.functions.staging import staging_path
    from vecshift.sources import files, remote

    kinds = {"files": files.FileStore, "memory": files.FileStore, "index": remote.PagedIndex, "points": remote.PointStore}
    kind = kinds.get((provider or "").strip().lower())
    if kind is None:
        raise ValueError(f"unknown provider {provider!r}; known are {', '.join(kinds)}")
    if kind is files.FileStore:
        return kind(spark, resolve_secret(endpoint) if provider.strip().lower() == "files" else staging_path(spark, "store"), **options)
    return kind(spark, resolve_secret(endpoint), resolve_secret(credential), **options)
