"""The k most similar vectors of every vector (problem 5).

Multiprobe p-stable hashing (``cells``): every record is indexed in its home bucket of each table and visits
perturbed buckets in order of estimated success; candidates of all tables are ranked by their exact cosine and
merged. Within a bucket similarities are computed in blocks; only the best of each record leave the task.
A class of equal vectors is represented by its least member, before anything is hashed, and stands for all of them after.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecshift.functions.staging import broadcast_within, checkpoint
from vecshift.llm.cells import Vectors, chunked, in_blocks, matrix_of, meetings, units

#: Digits to which cosines are rounded; they are compared as whole numbers of this unit.
DIGITS = 9
UNIT = 10**DIGITS
#: Allowance for the single-precision similarities that preselect candidates.
SLACK = 4e-6
#: Rows of a block of similarities, and columns of which one maximum is taken.
ROWS, STRIDE = 256, 16


def top_pairs(matrix: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, other, cosine in UNITs) of the k best others of each row with cosine >= least; ties go to the lower row.

    The rows must all be different vectors."""
    exact = units(matrix)
    single = exact.astype(np.float32)
    n, floor = len(single), round(least * UNIT)
    found: list[tuple[np.ndarray, ...]] = []
    for start in range(0, n, ROWS):
        near = single[start : start + ROWS] @ single.T
        own = np.arange(start, min(start + ROWS, n))
        near[np.arange(len(own)), own] = -2
        limit = np.full(len(own), np.float32(least - SLACK))
        whole = n // STRIDE
        if whole > k:
            best = near[:, : whole * STRIDE].reshape(len(own), STRIDE, whole).max(1)
            limit = np.maximum(limit, np.partition(best, whole - k, axis=1)[:, whole - k] - SLACK)
        row, other = np.divmod(np.flatnonzero(near >= limit[:, None]), n)
        if len(row) > 64 * k * len(own):  # very many all but equal similarities
            row, other, cosine = _dense(exact, own, k)
        else:
            cosine = np.rint(np.einsum("ij,ij->i", exact[own[row]], exact[other]) * UNIT).astype(np.int64)
        keep = cosine >= floor
        row, other, cosine = row[keep], other[keep], cosine[keep]
        order = np.lexsort((other, -cosine, row))
        row, other, cosine = row[order], other[order], cosine[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        found.append((own[row[place < k]], other[place < k], cosine[place < k]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3


def _dense(exact: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best others of the rows ``own`` by exact cosine and lower row."""
    cosine = np.rint(exact[own] @ exact.T * UNIT).astype(np.int64)
    cosine[np.arange(len(own)), own] = -2 * UNIT
    n = cosine.shape[1]
    rank = cosine * n - np.arange(n)
    other = np.argpartition(-rank, min(k, n - 1), axis=1)[:, : min(k, n)]
    row = np.repeat(np.arange(len(own)), other.shape[1])
    return row, other.ravel(), cosine[row, other.ravel()]


def best_of(row: np.ndarray, other: np.ndarray, cosine: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each row by cosine, ties by the lower other; a candidate found several times counts once."""
    order = np.lexsort((-cosine, other, row))
    row, other, cosine = row[order], other[order], cosine[order]
    new = np.append(True, (row[1:] != row[:-1]) | (other[1:] != other[:-1]))[: len(row)]
    row, other, cosine = row[new], other[new], cosine[new]
    order = np.lexsort((other, -cosine, row))
    row, other, cosine = row[order], other[order], cosine[order]
    best = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[best], other[best], cosine[best]


def cell_neighbours(nums: np.ndarray, matrix: np.ndarray, k: int, least: float, **inner) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(num, other num, cosine) of the k best others of each record among those it meets."""
    order = np.argsort(nums)
    nums, matrix = nums[order], matrix[order]
    found = [(np.empty(0, np.int64),) * 3]
    waiting = 0
    for rows in meetings(units(matrix), **inner):
        row, other, cosine = top_pairs(matrix[rows], k, least)
        found.append((rows[row], rows[other], cosine))
        waiting += len(row)
        if waiting > 4 * k * len(nums) + 1_000_000:
            found, waiting = [best_of(*(np.concatenate(x) for x in zip(*found, strict=True)), k)], 0
    row, other, cosine = best_of(*(np.concatenate(x) for x in zip(*found, strict=True)), k)
    return nums[row], nums[other], cosine


def _packed(source: np.ndarray, target: np.ndarray, cosine: np.ndarray) -> pa.Table:
    """One row per source: its candidates as bytes of (other num, cosine) records."""
    order = np.argsort(source, kind="stable")
    source, pairs = source[order], np.zeros(len(source), CANDIDATE)
    pairs["num"], pairs["cosine"] = target[order], cosine[order]
    own, start = np.unique(source, return_index=True)
    ends = (np.append(start, len(source)) * CANDIDATE.itemsize).astype(np.int32)
    return pa.table({"num": pa.array(own, pa.int64()), "near": pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(pairs.tobytes())])})


CANDIDATE = np.dtype([("num", "<i8"), ("cosine", "<i4")])


def neighbours(vectors: Vectors, k: int = 5, least: float = 0.85, visits: int = 3, reach: float = 0.08, target: int = 4_000, tables: int = 2, probes: int = 3, most: int | None = None) -> DataFrame:
    """``(num, other, cosine)``: of each class of equal vectors the at most k others of greatest cosine >= least.

    Cosines are of doubles, rounded to DIGITS digits; ties go to the smaller id. Approximate: a pair that
    shares no visited cell is missed. visits, reach, most: of the outer hash (cells of at most about ``most`` rows); target, tables,
    probes: of the inner one. Records without a usable vector have no row, nor have those without a similar one."""
    plan, stuck = vectors.outer(visits, reach, most)
    width = vectors.dimension

    def work(table: pa.Table) -> pa.Table:
        return _packed(*cell_neighbours(table["num"].to_numpy(), matrix_of(table["vec"], width=width), k, least, target=target, tables=tables, visits=tables + probes, reach=reach))

    def merge(batches):
        for batch in batches:
            own, lists = batch.column(0).to_numpy(), batch.column(1)
            flat = lists.flatten()
            pairs = np.frombuffer(b"".join(flat.to_pylist()), CANDIDATE)
            counts = np.array(pc.binary_length(flat), dtype=np.int64) // CANDIDATE.itemsize
            row = np.repeat(np.repeat(np.arange(len(own)), np.diff(np.asarray(lists.offsets))), counts)
            row, other, cosine = best_of(row, pairs["num"], pairs["cosine"].astype(np.int64), k)
            yield pa.RecordBatch.from_arrays([pa.array(own[row]), pa.array(np.ascontiguousarray(other)), pa.array(cosine / UNIT)], names=["num", "other", "cosine"])

    found = in_blocks(vectors.visits(plan, lambda matrix: matrix), chunked(vectors.rows.sparkSession, stuck), work, "num bigint, near binary")
    lists = found.groupBy("num").agg(F.collect_list("near").alias("near"))
    return lists.mapInArrow(merge, "num bigint, other bigint, cosine double")


def of_members(vectors: Vectors, near: DataFrame, k: int) -> DataFrame:
    """``(num, other, cosine)`` of records, from that of classes of equal vectors.

    Among the k best classes of a class, with the members of each, and its own members, are the k best records of each
    of its members. A class shows no more than its k + 1 least members, so nothing grows with its size but its own rows."""
    if not vectors.copies:
        return near
    members = vectors.members.select("num", "rep")
    several = broadcast_within(members.where("num = rep").select("num"))
    # classes that are several records or near such are worked out anew; the others stay as they are
    touched = near.join(several.withColumnRenamed("num", "other"), "other", "left_semi").select("num").unionByName(several).distinct()
    touched = broadcast_within(touched)
    first = F.row_number().over(Window.partitionBy("rep").orderBy("num"))
    shown = members.withColumn("nth", first).where(F.col("nth") <= k + 1).select(F.col("rep").alias("other"), F.col("num").alias("member"))
    own = members.where("num = rep").select("num", F.col("num").alias("other"), F.lit(1.0).alias("cosine"))
    listed = near.join(touched, "num", "left_semi").unionByName(own).join(shown, "other", "left").select("num", F.coalesce("member", "other").alias("other"), "cosine")
    nth = F.row_number().over(Window.partitionBy("num").orderBy(F.desc("cosine"), "other"))
    listed = checkpoint(listed.withColumn("nth", nth).where(F.col("nth") <= k + 1).drop("nth"))
    shared = broadcast_within(listed.join(several, "num", "left_semi").withColumnRenamed("num", "rep"))
    each = members.join(shared, "rep").where("num <> other").select("num", "other", "cosine")
    alone = listed.join(several, "num", "left_anti")
    return near.join(touched, "num", "left_anti").unionByName(alone.unionByName(each).withColumn("nth", nth).where(F.col("nth") <= k).drop("nth"))


def neighbour_pairs(records: DataFrame, k: int = 5, least: float = 0.85, dimension: int = 64, **cells) -> DataFrame:
    """``(id_a, id_b)`` with id_a < id_b: pairs of which at least one is a neighbour of the other.

    records: ``id, vector, updated_at, ingested_at``, several versions of a record being allowed. Rows with null
    ids and records whose current vector is not usable (null, another length, an element that is null or not
    finite, all zero) take no part. An empty table gives no pairs. ``cells``: see ``neighbours``."""
    vectors = Vectors(records, dimension)
    near = checkpoint(neighbours(vectors, k, least, **cells))
    vectors.release()
    pairs = of_members(vectors, near, k).select(F.least("num", "other").alias("id_a"), F.greatest("num", "other").alias("id_b")).distinct()
    return vectors.named(pairs, "id_a", "id_b").select("id_a", "id_b")
