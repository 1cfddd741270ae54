"""Strategies that carry vectors from one space to another: fit on a sample, apply to all.

Fits need means and (cross) products only, which one pass sums up partition by partition; what reaches the driver
is a few d x d matrices. Applying is one matrix product per Arrow batch.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of the calibration pairs; fits use at most the second number, drawn by key hash.
LEAST_PAIRS, MOST_PAIRS = 200, 500
ALPHA = 1.0
SEED = 42


@dataclass(frozen=True)
class Affine:
    """``x -> (x - before) @ matrix + after``, with what is reported of it."""

    strategy: str
    before: np.ndarray
    matrix: np.ndarray
    after: np.ndarray
    report: dict = field(default_factory=dict)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (np.asarray(x, np.float64) - self.before) @ self.matrix + self.after

    def inverse(self, z: np.ndarray) -> np.ndarray:
        """The least-squares way back; exact for orthonormal columns."""
        return (np.asarray(z, np.float64) - self.after) @ np.linalg.pinv(self.matrix) + self.before

    def apply(self, df: DataFrame, vector: str = "vector", element: str = "float") -> DataFrame:
        """``df`` with its vectors mapped, as float (or double) arrays. Null vectors and vectors of another length become null."""
        width = len(self.before)

        kind = np.float32 if element == "float" else np.float64

        @F.arrow_udf(f"array<{element}>")
        def mapped(column: pa.Array) -> pa.Array:
            right = np.asarray(pa.compute.fill_null(pa.compute.equal(pa.compute.list_value_length(column), width), False))
            out = self(column.filter(pa.array(right)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)).astype(kind)
            ends = np.concatenate([[0], np.cumsum(right)]).astype(np.int32) * out.shape[1]
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()), mask=pa.array(~right))

        return df.withColumn(vector, mapped(F.col(vector).cast("array<double>")))

    def to_json(self) -> str:
        return json.dumps({"strategy": self.strategy, "before": self.before.tolist(), "matrix": self.matrix.tolist(), "after": self.after.tolist(), "report": self.report})

    @staticmethod
    def from_json(text: str) -> Affine:
        d = json.loads(text)
        return Affine(d["strategy"], np.array(d["before"]), np.array(d["matrix"]), np.array(d["after"]), d["report"])

    def checksum(self) -> str:
        return hashlib.sha256(np.concatenate([self.before.ravel(), self.matrix.ravel(), self.after.ravel()]).astype("<f8").tobytes()).hexdigest()


@dataclass(frozen=True)
class Moments:
    """Number, sums and products of paired vectors (of one kind: ``y`` is ``x``)."""

    n: int
    x: np.ndarray
    y: np.ndarray
    xx: np.ndarray
    xy: np.ndarray

    @property
    def cross(self) -> np.ndarray:
        return self.xy - np.outer(self.x, self.y) / self.n

    @property
    def own(self) -> np.ndarray:
        return self.xx - np.outer(self.x, self.x) / self.n


def moments(df: DataFrame, x: str = "vector", y: str | None = None) -> Moments:
    """Sums over all rows whose vectors have the most frequent lengths and are finite, in one pass."""
    y = y or x
    rows = df.select(F.col(x).cast("array<double>").alias("x"), F.col(y).cast("array<double>").alias("y"))
    bad = lambda c: F.exists(c, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf"))))
    rows = rows.where(F.col("x").isNotNull() & F.col("y").isNotNull()).where(~bad(F.col("x")) & ~bad(F.col("y")) & (F.size("x") > 0) & (F.size("y") > 0))
    shapes = rows.groupBy(F.size("x").alias("p"), F.size("y").alias("q")).count().orderBy(F.desc("count"), "p", "q").limit(1).collect()
    if not shapes:
        raise ValueError("no vectors to fit on")
    p, q = shapes[0]["p"], shapes[0]["q"]

    def partial(batches):
        n, total = 0, np.zeros(p + q + p * p + p * q)
        for batch in batches:
            a = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            b = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, q)
            n += len(a)
            total += np.concatenate([a.sum(0), b.sum(0), (a.T @ a).ravel(), (a.T @ b).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tobytes()])], names=["n", "sums"])

    parts = rows.where((F.size("x") == p) & (F.size("y") == q)).mapInArrow(partial, "n bigint, sums binary")
    n, total = 0, np.zeros(p + q + p * p + p * q)
    for row in parts.toLocalIterator():  # one small row per partition
        n += row["n"]
        total += np.frombuffer(bytes(row["sums"]))
    cut = np.cumsum([p, q, p * p])
    sx, sy, xx, xy = np.split(total, cut)
    return Moments(n, sx, sy, xx.reshape(p, p), xy.reshape(p, q))


def identity(dimension: int) -> Affine:
    return Affine("direct_copy", np.zeros(dimension), np.eye(dimension), np.zeros(dimension))


def fit_pca(df: DataFrame, components: int, vector: str = "vector") -> Affine:
    """Projection onto the principal components of the centred vectors. Each component's greatest loading is positive."""
    m = moments(df, vector)
    if m.n < components or components > len(m.x):
        raise ValueError(f"{components} components need as many rows and dimensions; there are {m.n} and {len(m.x)}")
    values, vectors = np.linalg.eigh(m.own / max(m.n - 1, 1))
    basis = vectors[:, ::-1][:, :components]
    basis = basis * np.sign(basis[np.abs(basis).argmax(0), np.arange(components)])
    explained = values[::-1][:components].sum() / max(values.sum(), 1e-300)
    return Affine("pca", m.x / m.n, basis, np.zeros(components), {"components": components, "explained_variance": float(explained)})


def fit_random_projection(source: int, target: int, seed: int = SEED) -> Affine:
    """A Gaussian projection, scaled by the root of the target dimension; into as many or more dimensions a random
    isometry, which keeps dot products exactly. Needs no data."""
    random = np.random.default_rng(seed)
    if target < source:
        matrix = random.normal(size=(source, target)) / np.sqrt(target)
    else:
        matrix = np.linalg.qr(random.normal(size=(target, source)))[0].T
    return Affine("random_projection", np.zeros(source), matrix, np.zeros(target), {"seed": seed})


def _enough(m: Moments) -> None:
    if m.n < LEAST_PAIRS:
        raise ValueError(f"calibration needs {LEAST_PAIRS} pairs, there are {m.n}")


def fit_ridge(df: DataFrame, x: str = "vector", y: str = "target", alpha: float = ALPHA) -> Affine:
    """Least squares with an L2 penalty of ``alpha`` on the coefficients, not on the intercept."""
    m = moments(df, x, y)
    _enough(m)
    matrix = np.linalg.solve(m.own + alpha * np.eye(len(m.x)), m.cross)
    return Affine("ridge_mapping", m.x / m.n, matrix, m.y / m.n, {"alpha": alpha, "pairs": m.n})


def fit_procrustes(df: DataFrame, x: str = "vector", y: str = "target") -> Affine:
    """The rotation of the centred vectors that comes nearest to the target."""
    m = moments(df, x, y)
    _enough(m)
    if len(m.x) != len(m.y):
        raise ValueError("a rotation needs equal dimensions")
    u, _, v = np.linalg.svd(m.cross)
    return Affine("procrustes_mapping", m.x / m.n, u @ v, m.y / m.n, {"pairs": m.n})


def fit_procrustes_diagonal(df: DataFrame, x: str = "vector", y: str = "target") -> Affine:
    """A sign for each axis: +1 where source and target agree on the whole."""
    m = moments(df, x, y)
    _enough(m)
    if len(m.x) != len(m.y):
        raise ValueError("axis signs need equal dimensions")
    return Affine("procrustes_diag", m.x / m.n, np.diag(np.where(np.diag(m.cross) >= 0, 1.0, -1.0)), m.y / m.n, {"pairs": m.n})


def fit_low_rank(df: DataFrame, x: str = "vector", y: str = "target", rank: int | None = None, alpha: float = ALPHA) -> Affine:
    """The ridge map cut to its greatest singular values."""
    full = fit_ridge(df, x, y, alpha)
    pairs = full.report["pairs"]
    rank = rank or max(1, min(*full.matrix.shape, pairs // 5))
    u, s, v = np.linalg.svd(full.matrix, full_matrices=False)
    return Affine("low_rank_affine", full.before, (u[:, :rank] * s[:rank]) @ v[:rank], full.after, {"rank": rank, "alpha": alpha, "pairs": pairs})


def calibration_pairs(df: DataFrame, key: str = "id", most: int = MOST_PAIRS) -> DataFrame:
    """At most ``most`` pairs, those of the smallest key hashes: the same for any order or partitioning."""
    return df.orderBy(F.xxhash64(key), key).limit(most)
