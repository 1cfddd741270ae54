"""Cells of vectors by p-stable hashing, and work on the rows that meet in them.

Vectors are projected onto random Gaussian directions (a 2-stable family: the projection of a difference is as wide as
the difference is long), shifted and quantised; the integers of the directions of a level name a cell within the cell
of the level above. A cell is divided by the directions of the next level as long as it has more rows than wished for,
so that dense regions have finer cells; directions beyond the usual depth are narrower, level by level. A vector visits its home cell
and perturbed cells in order of their estimated success, the distance to the borders crossed, up to a fixed number.

It is done twice. Cells of the outer hash (one table) are what is shuffled: a vector is sent once for each visit, and
their number is bounded whatever the size of the data. Within a cell, rows meet by an inner hash of several
tables, fitted to the rows at hand, whose visits cost no shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecshift.functions.current import current_rows
from vecshift.functions.staging import broadcast_within, checkpoint

#: Rows on which directions and depths are fitted, drawn by id hash. Every row is indexed.
FIT_ROWS = 16_384
#: Least and greatest number of rows wished for in an outer cell, and the number of such cells a small table is divided into.
LEAST_ROWS, MOST_ROWS, PARTS = 2_000, 50_000, 10
#: An outer cell of more home rows than this times the wished number is divided further, whatever the sample said.
OVERFULL = 2
#: Rows in a group of rows that no hash can divide, beyond which it is cut into chunks; every pair of chunks meets.
BLOCK_ROWS = 50_000
#: Rows up to which lists of cells cut into chunks are broadcast.
HOT_ROWS = 100_000
#: Directions of a level, levels below the usual depth, and the factor of their widths.
PER, DEEPER, SHRINK = 2, 16, 0.7
#: Nats by which one direction of the usual width divides the rows, for estimating the usual depth.
NATS = 0.43
#: Seed of the random directions and shifts.
SEED = 20_240_607


def usable(vector: Column, dimension: int) -> Column:
    """Whether a vector has ``dimension`` elements, all finite, not all zero. Built-in functions only, so that
    the rows stay partitioned as they are. NaN counts as the greatest element."""
    greatest, least = F.array_max(vector), F.array_min(vector)
    finite = (greatest < F.lit(float("inf"))) & (least > F.lit(float("-inf")))
    return F.coalesce((F.size(vector) == dimension) & (F.size(F.array_compact(vector)) == dimension) & finite & ((greatest != 0) | (least != 0)), F.lit(False))


def matrix_of(column, dtype=np.float32, width: int = 64) -> np.ndarray:
    """The matrix whose rows are the elements (or the bytes) of a list (or binary) column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks else pa.array([], column.type)
    if not len(column):
        return np.empty((0, width), dtype)
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    first = int(np.frombuffer(column.buffers()[1], np.int32, 1, column.offset * 4)[0])
    return np.frombuffer(column.buffers()[2], dtype, len(column) * width, first).reshape(-1, width)


def binary_of(matrix: np.ndarray) -> pa.Array:
    ends = np.arange(len(matrix) + 1, dtype=np.int32) * (matrix.itemsize * matrix.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(matrix).tobytes())])


def units(matrix: np.ndarray) -> np.ndarray:
    """Rows as double unit vectors; scaled by the greatest element first, so that no square overflows."""
    wide = matrix.astype(np.float64)
    wide /= np.abs(wide).max(1, keepdims=True)
    return wide / np.sqrt(np.einsum("ij,ij->i", wide, wide))[:, None]


def _deeper(key: np.ndarray, *coordinates: np.ndarray) -> np.ndarray:
    """The keys of the cells that have these coordinates within the cells ``key``."""
    for c in coordinates:
        key = (key ^ np.ascontiguousarray(c).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key = key ^ (key >> np.uint64(29))
    return key


@dataclass
class Cells:
    """Parameters of a hash. directions: for each table an array (dimension, levels * PER), in units of the width;
    divided: for each level the sorted keys of the cells that are divided further."""

    mean: np.ndarray
    directions: list[np.ndarray]
    shifts: list[np.ndarray]
    widths: np.ndarray
    divided: list[np.ndarray]
    visits: int
    reach: float

    @staticmethod
    def fit(sample: np.ndarray, rows: int, target: int, tables: int = 1, visits: int = 3, reach: float = 0.08, width: float = 0.4, subspace: int = 8) -> Cells:
        """Cells of about ``target`` rows for ``rows`` unit vectors of which ``sample`` is a part.

        The usual depth grows with the logarithm of the rows; its directions lie within the principal subspace of the
        sample. Cells of the first level are always divided by it. ``visits``: cells visited by a row at most, the
        home cells of all tables among them; ``reach``: a perturbed cell is visited if its border is no further
        away (in units of length of a unit vector)."""
        usual = max(1, math.ceil(math.log(max(rows / target, 1.0)) / (PER * NATS)))
        depth, size = (usual + DEEPER) * PER, sample.shape[1]
        mean = sample.mean(0)
        _, basis = np.linalg.eigh((sample - mean).T @ (sample - mean))
        inner = min(max(subspace, usual * PER), size)
        random = np.random.default_rng(SEED)
        widths = np.concatenate([np.full(usual * PER, width), np.repeat(width * SHRINK ** np.arange(1, DEEPER + 1), PER)])
        directions, shifts = [], []
        for _ in range(tables):
            turns = [np.linalg.qr(random.normal(size=(inner, inner)))[0] for _ in range(-(-usual * PER // inner))]
            above = basis[:, ::-1][:, :inner] @ np.concatenate(turns, axis=1)[:, : usual * PER]
            below = random.normal(size=(size, DEEPER * PER))
            directions.append(np.concatenate([above, below / np.linalg.norm(below, axis=0)], axis=1) / widths)
            shifts.append(random.random(depth))
        cells = Cells(mean, directions, shifts, widths, [np.empty(0, np.uint64)] * (usual + DEEPER), visits, reach)
        while True:  # a level more each time
            keys, levels = zip(*(cells._walk(cells._places(sample, t)[0], t) for t in range(tables)), strict=True)
            key, first, count = np.unique(np.concatenate(keys), return_index=True, return_counts=True)
            full = count * (rows / max(len(sample), 1)) > target
            if not cells.divide(key[full], np.concatenate(levels)[first[full]]):
                return cells

    def divide(self, keys: np.ndarray, levels: np.ndarray) -> bool:
        """Divide cells further; those of the last level stay as they are. Whether any was divided."""
        deep = levels < len(self.divided) - 1
        for level in np.unique(levels[deep]):
            self.divided[level] = np.union1d(self.divided[level], keys[deep & (levels == level)])
        return bool(deep.any())

    def _used(self) -> int:
        """Levels that some row reaches."""
        return 1 + max((level + 1 for level, keys in enumerate(self.divided) if len(keys)), default=0)

    def _places(self, vectors: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """(coordinates, distances to the lower border), for the levels in use."""
        n = self._used() * PER
        place = (vectors - self.mean) @ self.directions[table][:, :n] + self.shifts[table][:n]
        low = np.floor(place)
        return low.astype(np.int64), (place - low) * self.widths[:n]

    def _walk(self, coordinates: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """(key, level) of the undivided cell each row comes to."""
        key = np.full(len(coordinates), (table + 1) * 0xD6E8FEB86659FD93 % 2**64, np.uint64)
        level, going = np.zeros(len(key), np.int64), np.arange(len(key))
        for at in range(coordinates.shape[1] // PER):
            key[going] = _deeper(key[going], *(coordinates[going, at * PER + j] for j in range(PER)))
            level[going] = at
            divided = self.divided[at]
            if not len(divided):
                break
            going = going[divided[np.minimum(np.searchsorted(divided, key[going]), len(divided) - 1)] == key[going]]
        return key, level

    def homes(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(key, level) of the home cell of each row in each table, table after table."""
        keys, levels = zip(*(self._walk(self._places(vectors, t)[0], t) for t in range(len(self.shifts))), strict=True)
        return np.concatenate(keys), np.concatenate(levels)

    def keys(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell key) of each visit of each row; a row visits a cell once."""
        n, tables = len(vectors), len(self.shifts)
        rows, keys, places, scores = [], [], [], []
        for table in range(tables):
            coordinates, low = self._places(vectors, table)
            key, level = self._walk(coordinates, table)
            border = np.concatenate([low, self.widths[: low.shape[1]] - low], axis=1)
            unused = np.arange(low.shape[1]) >= (level[:, None] + 1) * PER
            border[np.concatenate([unused, unused], axis=1)] = np.inf
            rows, keys, places, scores = [*rows, np.arange(n)], [*keys, key], [*places, coordinates], [*scores, border]
        probes = min(self.visits - tables, tables * scores[0].shape[1]) if n else 0
        if probes > 0:
            score = np.concatenate(scores, axis=1)
            best = np.argpartition(score, probes - 1, axis=1)[:, :probes]
            row, nth = np.nonzero(np.take_along_axis(score, best, axis=1) <= self.reach)
            table, move = np.divmod(best[row, nth], scores[0].shape[1])
            m = scores[0].shape[1] // 2
            for t in range(tables):
                own = table == t
                moved = places[t][row[own]]
                moved[np.arange(len(moved)), move[own] % m] += np.where(move[own] < m, -1, 1)
                rows.append(row[own])
                keys.append(self._walk(moved, t)[0])
        return np.concatenate(rows), np.concatenate(keys)


def meetings(vectors: np.ndarray, target: int, **inner) -> Iterator[np.ndarray]:
    """The rows of each cell of an inner hash of these unit vectors, for cells that two rows or more visit."""
    if len(vectors) < 2:
        return
    sample = vectors[:: -(-len(vectors) // FIT_ROWS)]
    rows, keys = Cells.fit(sample, len(vectors), target, **inner).keys(vectors)
    del vectors
    order = np.lexsort((rows, keys))
    rows, keys = rows[order], keys[order]
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    for low, high in zip(start, np.append(start[1:], len(rows)), strict=True):
        if high - low > 1:
            yield rows[low:high]


class Vectors:
    """The current records with usable vectors: ``rows(id, num, vec)``, kept hash-partitioned by id.

    ``num`` numbers the ids in their order (by code point), so that ties can be broken by number and
    only numbers need be shuffled. ``vec`` holds the floats. Kept in memory and on disk; a lost part is
    computed again. Records with equal vectors are a class, represented by the least of them: ``members(id, num,
    rep)`` has the classes of several records, ``reps`` the rows without the other members."""

    def __init__(self, records: DataFrame, dimension: int = 64):
        self.dimension = dimension
        ids = records.select("id").where("id is not null").distinct()
        self.numbers = checkpoint(ids.repartitionByRange("id").sortWithinPartitions("id").select("id", F.monotonically_increasing_id().alias("num")))
        now = current_rows(records.select("id", "vector", "updated_at", "ingested_at"))
        now = now.select("id", F.col("vector").cast("array<float>").alias("vec")).where(usable(F.col("vec"), dimension))
        self.rows = now.join(self.numbers, "id").select("id", "num", "vec").persist()
        hashed = self.rows.select("id", "num", F.xxhash64("vec").alias("h"), F.xxhash64(F.lit(SEED), "vec").alias("g"))
        classes = checkpoint(hashed.groupBy("h", "g").agg(F.min("num").alias("rep"), F.count("*").alias("n")).where("n > 1"))
        self.copies = not classes.isEmpty()
        if self.copies:
            self.members = checkpoint(hashed.join(broadcast_within(classes.select("h", "g", "rep")), ["h", "g"]).select("id", "num", "rep"))
            # the vectors stay where they are; the ids come to them
            self.reps = self.rows.join(self.members.where("num <> rep").select("id"), "id", "left_anti")
        else:
            self.members, self.reps = classes.select(F.lit("").alias("id"), F.col("rep").alias("num"), "rep"), self.rows
        self.count = self.reps.count()

    def release(self) -> None:
        self.rows.unpersist()

    def sample(self, rows: int = FIT_ROWS) -> np.ndarray:
        """Unit vectors of about ``rows`` records, drawn by the hash of their id."""
        part = min(1.0, rows / max(self.count, 1))
        drawn = self.reps.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.lit(math.ceil(part * (1 << 20)))).select("vec").toArrow()
        matrix = matrix_of(drawn["vec"], width=self.dimension)
        return units(matrix) if len(matrix) else np.zeros((1, self.dimension))

    def outer(self, visits: int, reach: float, most: int | None = None) -> tuple[Cells, list[tuple[int, int]]]:
        """The outer hash, and (key, home rows) of cells that can't be divided although they are overfull.

        Depths are fitted on the sample; then the home rows of all cells are counted over all records, and
        overfull ones are divided until none is left. What comes to the driver are the overfull cells: at most
        the number of rows by OVERFULL * target."""
        target = max(LEAST_ROWS, min(most or MOST_ROWS, self.count // PARTS))
        cells, width = Cells.fit(self.sample(), self.count, target, visits=visits, reach=reach), self.dimension
        while True:
            shared = self.rows.sparkSession.sparkContext.broadcast(cells)

            def homes(batches, shared=shared):
                for batch in batches:
                    key, level = shared.value.homes(units(matrix_of(batch.column(0), width=width)))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(level)], names=["key", "level"])

            counted = self.reps.select("vec").mapInArrow(homes, "key bigint, level bigint").groupBy("key", "level").agg(F.count("*").alias("n"))
            full = counted.where(F.col("n") > OVERFULL * target).toArrow()
            key, level, n = (full[c].to_numpy() for c in ("key", "level", "n"))
            if not cells.divide(key.view(np.uint64), level):
                return cells, [(int(k), int(c)) for k, c in zip(key, n, strict=True) if c > BLOCK_ROWS]

    def visits(self, cells: Cells, kept: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
        """``(key, num, vec)``: a row for each visit of a cell, with the vector as ``kept`` makes it of the float matrix."""
        width, shared = self.dimension, self.rows.sparkSession.sparkContext.broadcast(cells)

        def visit(batches):
            for batch in batches:
                matrix = matrix_of(batch.column(1), width=width)
                at, keys = shared.value.keys(units(matrix))
                small = kept(matrix)
                for start in range(0, len(at), 20_000):
                    part = at[start : start + 20_000]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[start : start + 20_000].view(np.int64)), batch.column(0).take(pa.array(part)), binary_of(small[part])], names=["key", "num", "vec"])

        return self.reps.select("num", "vec").mapInArrow(visit, "key bigint, num bigint, vec binary")

    def named(self, pairs: DataFrame, *columns: str) -> DataFrame:
        """``pairs`` with the numbers in ``columns`` replaced by ids."""
        for column in columns:
            names = self.numbers.select(F.col("num").alias(column), F.col("id").alias(f"__{column}"))
            pairs = pairs.join(names, column).drop(column).withColumnRenamed(f"__{column}", column)
        return pairs


def in_blocks(rows: DataFrame, hot: DataFrame | None, work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``work`` over the rows of each key: ``(key, num, ...)`` joined by ``low, high, chunk``.

    hot: ``(key, chunks)`` of keys to be cut, or null for none. Such a key's rows are cut into chunks by the hash of ``num``;
    each pair of chunks ``low <= high`` is a group of its own, and every two rows of a key meet in exactly one
    group of ``low < high`` or ``low = high``."""
    zero = F.lit(0)
    if hot is None:
        placed = rows.select("*", zero.alias("low"), zero.alias("high"), zero.alias("chunk"))
    else:
        chunks = F.coalesce("chunks", F.lit(1))
        cut = rows.join(broadcast_within(hot, HOT_ROWS), "key", "left").withColumn("chunk", F.pmod(F.xxhash64("num"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(zero, chunks - 1)))
        placed = cut.withColumn("low", F.least("chunk", "other")).withColumn("high", F.greatest("chunk", "other")).drop("chunks", "other")
    return placed.groupBy("key", "low", "high").applyInArrow(work, schema)


def chunked(spark, stuck: list[tuple[int, int]]) -> DataFrame | None:
    """What ``in_blocks`` is told of cells that can't be divided; their list is bounded as ``Vectors.outer`` says."""
    rows = [(key, -(-n // BLOCK_ROWS)) for key, n in stuck]
    return spark.createDataFrame(rows, "key bigint, chunks int") if rows else None
