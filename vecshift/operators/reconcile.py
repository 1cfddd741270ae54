"""Differences between two copies of a collection (problem 4).

Each side is reduced to (key hash, element hash) of its current rows. The elements are summed into
invertible Bloom lookup tables, one per key bucket; the tables of the two sides are subtracted and peeled,
which reveals the keys whose elements differ. Only the rows of those keys are then fetched and compared
field by field. Vector tolerance is no equivalence, so elements hash the exact vector: a key whose vector
moved within the tolerance is revealed, and dismissed by the comparison.
"""

from __future__ import annotations

import hashlib
import json
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecshift.functions.current import current_rows
from vecshift.functions.staging import BROADCAST_ROWS, broadcast_within, checkpoint

#: Payload keys the target system adds; not part of the record.
SOURCE_ID, NAMESPACE = "__source_id", "__namespace"
#: Absolute and relative tolerance of vector elements.
ATOL = RTOL = 1e-5
#: Cells of one table in each of its HASHES parts.
HASHES, CELLS = 3, 512
#: Elements a table of HASHES * CELLS cells is planned for; peeling works up to about 0.8 of its cells.
PLANNED = 900
#: Rows of either side, at most about so many, by which the number of differing elements is estimated; drawn by key hash.
ESTIMATED = 40_000
#: Factor of buckets from one attempt to the next, and number of attempts before keys are compared directly.
FINER, ATTEMPTS = 4, 4
#: A prime below 2^31; residues of it check that a cell holds one element.
PRIME = 2147483629


def _number(text: str) -> Decimal:
    return Decimal(text)


def _plain(value) -> str:
    """Text that is equal for equal JSON values only."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k)}:{_plain(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_plain, value)) + "]"
    if isinstance(value, Decimal):
        return "0" if value == 0 else _scientific(value)
    return json.dumps(value)


def _scientific(value: Decimal) -> str:
    sign, digits, exponent = value.as_tuple()
    text = "".join(map(str, digits)).lstrip("0")
    short = text.rstrip("0")
    return f"{'-' * sign}{short}e{exponent + len(text) - len(short)}"


def canonical_json(text: str | None, without: tuple[str, ...] = (SOURCE_ID, NAMESPACE)) -> str:
    """Equal for payloads that are equal as JSON values: order of keys, spacing, escapes and number
    notation don't matter. Null equals ``{}``; text that is no JSON equals only the same text."""
    if text is None:
        return "{}"
    try:
        value = json.loads(text, parse_int=_number, parse_float=_number)
    except (ValueError, RecursionError, ArithmeticError):
        return "!" + text
    if isinstance(value, dict):
        for key in without:
            value.pop(key, None)
    return _plain(value)


def _digest(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _vector_bytes(column: pa.Array) -> list[bytes | None]:
    """The elements of each vector as double bytes, equal for equal vectors: one NaN, one zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = np.asarray(column.offsets)
    flat = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False) + 0.0
    flat = np.where(np.isnan(flat), np.nan, flat)
    null = column.is_null().to_numpy(zero_copy_only=False)
    return [None if null[i] else flat[ends[i] : ends[i + 1]].tobytes() for i in range(len(column))]


def _content_hashes(batches):
    for batch in batches:
        at = {name: i for i, name in enumerate(batch.schema.names)}
        vectors = _vector_bytes(batch.column(at["vector"]))
        payloads = batch.column(at["payload"]).to_pylist()
        content = [_digest(b"\0" if v is None else b"\1" + v) ^ ((_digest(canonical_json(p).encode("utf-8", "surrogatepass")) << 1) & (2**63 - 1)) for v, p in zip(vectors, payloads, strict=True)]
        keep = [batch.column(at[n]) for n in ("key", "updated_at", "ingested_at")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(content, pa.int64())], names=["key", "updated_at", "ingested_at", "content"])


def record_key(id_column: Column, payload: Column) -> Column:
    """The record id of a row of the target system: ``__source_id`` of the payload where there is one."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(payload), f"$.{SOURCE_ID}", "string"), id_column)


def _element_table(side: DataFrame) -> DataFrame:
    """(hash, content): one row per current record. Only hashes and times are shuffled."""
    kind = side.schema["updated_at"].dataType.simpleString()
    hashed = side.select("key", "updated_at", "ingested_at", F.col("vector").cast("array<double>").alias("vector"), "payload").mapInArrow(_content_hashes, f"key string, updated_at {kind}, ingested_at {kind}, content bigint")
    current = current_rows(hashed, "key")
    return current.select(F.xxhash64("key").alias("hash"), "content")


def _cells(elements: DataFrame, sign: int, buckets: int, seed: int) -> DataFrame:
    """The lookup tables of one side: its elements, in HASHES cells each, summed before the shuffle."""
    element = F.xxhash64("hash", "content", F.lit(seed))
    slots = F.array(*[F.pmod(F.shiftrightunsigned(F.col("element"), 20 * j).bitwiseAND((1 << 20) - 1), F.lit(CELLS)) + j * CELLS for j in range(HASHES)])
    return (
        elements.select("hash", element.alias("element"), F.pmod("hash", F.lit(buckets)).alias("bucket"))
        .select("bucket", "hash", "element", F.explode(slots).alias("cell"))
        .groupBy("bucket", "cell")
        .agg(
            F.sum(F.lit(sign)).alias("n"),
            F.bit_xor("hash").alias("hashes"),
            F.bit_xor("element").alias("elements"),
            F.sum(F.pmod("element", F.lit(PRIME)) * sign).alias("checks"),
        )
    )


def peel(n: np.ndarray, hashes: np.ndarray, elements: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, bool]:
    """Empty a subtracted table of HASHES * CELLS cells: the key hashes found, and whether all came out."""
    found = []
    for _ in range(HASHES * CELLS):
        pure = np.flatnonzero((np.abs(n) == 1) & (n * checks == np.mod(elements, PRIME)))
        if not len(pure):
            break
        _, first = np.unique(elements[pure], return_index=True)
        pure = pure[first]
        h, e, sign = hashes[pure], elements[pure], n[pure]
        found.append(h)
        for j in range(HASHES):
            at = ((e.view(np.uint64) >> np.uint64(20 * j)) & np.uint64((1 << 20) - 1)).astype(np.int64) % CELLS + j * CELLS
            np.subtract.at(n, at, sign)
            np.bitwise_xor.at(hashes, at, h)
            np.bitwise_xor.at(elements, at, e)
            np.subtract.at(checks, at, sign * np.mod(e, PRIME))
    return (np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)), not (n.any() or elements.any())


def _peel_bucket(table: pa.Table) -> pa.Table:
    cell = table["cell"].to_numpy()
    columns = []
    for name in ("n", "hashes", "elements", "checks"):
        column = np.zeros(HASHES * CELLS, np.int64)
        column[cell] = table[name].to_numpy()
        columns.append(column)
    found, whole = peel(*columns)
    bucket = int(table["bucket"][0].as_py())
    if not whole:
        return pa.table({"bucket": [bucket], "hash": pa.array([None], pa.int64())})
    return pa.table({"bucket": np.full(len(found), bucket), "hash": found})


def expected_elements(left: DataFrame, right: DataFrame, rows: int) -> float:
    """An upper estimate of the number of elements that are on one side only, from all keys of a part of the hashes. The tables are sized by it, so
    that they grow with the differences and not with the data."""
    part = min(1.0, ESTIMATED / max(rows, 1))
    drawn = lambda side: side.where(F.pmod(F.xxhash64("hash", F.lit(1)), F.lit(1 << 20)) < F.lit(round(part * (1 << 20))))
    keys = drawn(left).unionByName(drawn(right)).groupBy("hash").agg(F.count("*").alias("n"), F.min("content").alias("low"), F.max("content").alias("high"))
    found = keys.where("n <> 2 or low <> high").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return (found + 3 * found**0.5 + 3) / part


def differing_hashes(left: DataFrame, right: DataFrame) -> DataFrame:
    """Key hashes whose elements are not the same on both sides. left, right: (hash, content)."""
    rows = left.count() + right.count()
    buckets = max(1, round(expected_elements(left, right, rows) / PLANNED))
    done = None
    for attempt in range(ATTEMPTS):
        cells = _cells(left, 1, buckets, attempt).unionByName(_cells(right, -1, buckets, attempt))
        cells = cells.groupBy("bucket", "cell").agg(F.sum("n").alias("n"), F.bit_xor("hashes").alias("hashes"), F.bit_xor("elements").alias("elements"), F.sum("checks").alias("checks"))
        cells = cells.where("n != 0 or hashes != 0 or elements != 0 or checks != 0")
        peeled = checkpoint(cells.groupBy("bucket").applyInArrow(_peel_bucket, "bucket bigint, hash bigint"))
        found = peeled.where("hash is not null").select("hash")
        done = found if done is None else done.unionByName(found)
        left_over = peeled.where("hash is null").select("bucket")
        if left_over.isEmpty():
            return done.distinct()
        # each bucket falls apart into FINER ones: hash mod (FINER * buckets) keeps hash mod buckets
        again = broadcast_within(left_over)
        left, right = (side.join(again, F.pmod(side["hash"], F.lit(buckets)) == again["bucket"], "left_semi") for side in (left, right))
        buckets *= FINER
    # what four attempts can't peel (keys colliding in all of their bits) is compared element by element
    rest = left.unionByName(right).groupBy("hash").agg(F.count("*").alias("n"), F.countDistinct("content").alias("kinds")).where("n != 2 or kinds != 1")
    return done.unionByName(rest.select("hash")).distinct()


def _compare(batches):
    for batch in batches:
        column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        ids, diffs = [], []
        rows = zip(column["key"].to_pylist(), column["in_source"].to_pylist(), column["in_target"].to_pylist(), _vector_bytes(column["s_vector"]), _vector_bytes(column["t_vector"]), column["s_payload"].to_pylist(), column["t_payload"].to_pylist(), strict=True)
        for key, in_source, in_target, s, t, p, q in rows:
            found = ["missing_in_target"] if not in_target else ["missing_in_source"] if not in_source else ["vector"] * vectors_differ(s, t) + ["payload"] * (canonical_json(p) != canonical_json(q))
            ids += [key] * len(found)
            diffs += found
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(diffs, pa.string())], names=["id", "diff"])


def vectors_differ(s: bytes | None, t: bytes | None) -> bool:
    """Whether double vectors differ beyond the tolerance; NaN equals NaN, an infinity itself."""
    if s is None or t is None or len(s) != len(t):
        return (s is None) != (t is None) or s is not None and len(s) != len(t)
    if s == t:
        return False
    a, b = np.frombuffer(s), np.frombuffer(t)
    with np.errstate(invalid="ignore"):
        return bool((~((np.abs(a - b) <= ATOL + RTOL * np.abs(b)) & np.isfinite(a) & np.isfinite(b) | (a == b) | np.isnan(a) & np.isnan(b))).any())


def differences(source: DataFrame, target: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``(id, diff)``: one row per difference between the current rows of two copies of a collection.

    source, target: ``id, vector, payload, updated_at, ingested_at``; other columns are ignored. ``diff`` is
    ``missing_in_target``, ``missing_in_source``, ``vector`` or ``payload``. Rows with a null id are no
    records. A null element of a vector counts as NaN; of several rows with the greatest time the latest
    arrival counts. Empty tables are copies without records."""
    columns = ["key", "vector", "payload", "updated_at", "ingested_at"]
    left = source.withColumn("key", F.col("id")).select(*columns)
    right = target.withColumn("key", record_key(F.col("id"), F.col("payload"))).select(*columns)
    keys = [checkpoint(_element_table(side)) for side in (left, right)]
    wanted = broadcast_within(differing_hashes(*keys), broadcast_rows)
    sides = []
    for side, prefix in ((left, "s"), (right, "t")):
        rows = current_rows(side.join(wanted, F.xxhash64(side["key"]) == wanted["hash"], "left_semi"), "key")
        sides.append(rows.select("key", F.lit(True).alias("there"), F.col("vector").cast("array<double>").alias("vector"), "payload").toDF("key", f"{prefix}_there", f"{prefix}_vector", f"{prefix}_payload"))
    both = sides[0].join(sides[1], "key", "full_outer")
    there = [F.coalesce(f"{p}_there", F.lit(False)).alias(n) for p, n in (("s", "in_source"), ("t", "in_target"))]
    return both.select("key", *there, "s_vector", "t_vector", "s_payload", "t_payload").mapInArrow(_compare, "id string, diff string")
