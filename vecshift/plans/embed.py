"""Making vectors from text."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecshift.sources.remote import Transport, https, retried

#: Texts sent by one request.
BATCH_TEXTS = 100


class Embedder(Protocol):
    """Turns texts into rows of a matrix. Shipped to the executors, so it must be picklable."""

    dimension: int

    def __call__(self, texts: Sequence[str]) -> np.ndarray: ...


@dataclass(frozen=True)
class HashEmbedder:
    """Signed feature hashing of words: needs no model and no network, and gives equal vectors for equal words."""

    dimension: int = 64

    def __call__(self, texts):
        out = np.zeros((len(texts), self.dimension))
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.md5(word.encode("utf-8", "surrogatepass")).digest()[:8], "big")
                row[h % self.dimension] += 1.0 if h >> 63 else -1.0
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms == 0, 1.0, norms)


@dataclass(frozen=True)
class RemoteEmbedder:
    """An embeddings service; time-outs, 429 and server errors are tried again."""

    endpoint: str
    model: str
    dimension: int
    credential: str | None = None
    transport: Transport = https

    def __call__(self, texts):
        headers = {"Authorization": f"Bearer {self.credential}"} if self.credential else {}
        body = {"model": self.model, "input": list(texts)} | ({"dimensions": self.dimension} if resolve_dimension(self.model, None, self.dimension) else {})
        answer = retried(lambda: self.transport("POST", f"{self.endpoint.rstrip('/')}/embeddings", headers, body))
        return np.array([d["embedding"] for d in sorted(answer["data"], key=lambda d: d["index"])])


def resolve_dimension(model: str, asked: int | None, target: int | None) -> int | None:
    """The dimension to ask a model for: the explicit one, else the target's for models that can be cut, else none."""
    return asked if asked is not None else target if model.startswith("text-embedding-3-") else None


def embed(df: DataFrame, text: str, embedder: Embedder, vector: str = "vector") -> DataFrame:
    """``df`` with the vectors of its texts, BATCH_TEXTS at a time. Rows without text have a null vector: they are for the
    caller to set aside (``without_text``), never vectors of the empty text."""

    @F.arrow_udf("array<float>")
    def vectors(column: pa.Array) -> pa.Array:
        texts = column.to_pylist()
        there = [i for i, t in enumerate(texts) if t and t.strip()]
        out = [None] * len(texts)
        for start in range(0, len(there), BATCH_TEXTS):
            part = there[start : start + BATCH_TEXTS]
            for i, row in zip(part, embedder([texts[i] for i in part]), strict=True):
                out[i] = row.astype(np.float32)
        return pa.array(out, pa.list_(pa.float32()))

    return df.withColumn(vector, vectors(F.col(text)))


def without_text(df: DataFrame, text: str) -> DataFrame:
    return df.where(F.col(text).isNull() | (F.trim(text) == ""))
