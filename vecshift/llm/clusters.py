"""Clusters of mutually similar records (problem 3).

Grid density clustering: vectors are quantised to the cells of hashed grids (``cells``). The records of a cell fall
into parts whose records are linked by similarity; the parts' records are counted, those of at least ``dense`` records
are kept, adjacent parts are joined where they share a record near the border, and the smallest label is propagated
over these joins, in SQL, until nothing changes. The result is a division into groups that no similar pair
crosses, but for pairs that met in no cell.

An exact check follows. A group all of whose records lie within half the bound of its mean direction is a cluster, since
angles add up at most. Otherwise the records too far out for that are compared: each gets a signature of all records
similar to it (their number and two sums of their hashes), and records of one signature, as many as it counts, are
similar to each other and to no other record.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecshift.functions.staging import broadcast_within, checkpoint
from vecshift.llm.cells import Vectors, chunked, in_blocks, matrix_of, meetings, units

#: Half-precision similarities differ from exact ones by less than this.
HALF_SLACK = 4e-4
#: Single-precision similarities this near to the bound are computed again in double precision.
SINGLE_SLACK = 4e-6
#: Rows of a block of similarities.
ROWS = 512
#: Rounds of label propagation at most; each halves the longest chain of links, so 60 are never needed.
ROUNDS = 60
#: Rows of a group up to which it is checked in one task.
GROUP_ROWS = 16_384
#: Angles (radians) closer to a bound than this are not decided by it.
ANGLE_SLACK = 1e-6
#: Features of a cluster's own grid, and the least step of it: deviations below are rounding.
AXES, LEAST_STEP = 2, 1e-7
#: Clusters up to which their sums (about half a KB each) are broadcast.
SUM_ROWS = 50_000


def local_groups(vectors: np.ndarray, least: float) -> np.ndarray:
    """For each row the first row of its connected component by similarity >= least; -1 for rows without a similar one."""
    n = len(vectors)
    label = np.full(n, -1, np.int64)
    linked = np.concatenate([(vectors[i : i + ROWS] @ vectors.T >= least).sum(1) > 1 for i in range(0, n, ROWS)]) if n > 1 else np.zeros(n, bool)
    rest = np.flatnonzero(linked)
    while len(rest):
        seed, frontier, rest = rest[0], rest[:1], rest[1:]
        label[seed] = seed
        while len(frontier) and len(rest):
            reached = []
            for i in range(0, len(frontier), ROWS):
                near = (vectors[frontier[i : i + ROWS]] @ vectors[rest].T >= least).any(0)
                reached.append(rest[near])
                rest = rest[~near]
                if not len(rest):
                    break
            frontier = np.concatenate(reached)
            label[frontier] = seed
    return label


def propagate_minimum(links: DataFrame) -> DataFrame:
    """``(node, label)`` of undirected ``(a, b)`` links: the smallest node each node is connected with.

    Alternates the large-star and small-star steps until the links stay the same; each step is one shuffle of
    the links, cut off by a checkpoint. No neighbourhood is collected: the smallest neighbour is an
    aggregate, joined to the links again."""
    links = checkpoint(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _fingerprint(links)
    for _ in range(ROUNDS):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        joined = large.join(lowest, "a")
        small = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").unionByName(lowest.select("a", F.col("low").alias("b"))).distinct()
        links = checkpoint(small)
        after = _fingerprint(links)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"labels still change after {ROUNDS} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def hang_together(vectors: np.ndarray, least: float) -> bool:
    """Whether the rows are one connected component by similarity >= least."""
    frontier, rest = np.arange(1), np.arange(1, len(vectors))
    while len(frontier) and len(rest):
        reached = []
        for i in range(0, len(frontier), ROWS):
            near = (vectors[frontier[i : i + ROWS]] @ vectors[rest].T >= least).any(0)
            reached.append(rest[near])
            rest = rest[~near]
            if not len(rest):
                break
        frontier = np.concatenate(reached)
    return not len(rest)


def _fingerprint(links: DataFrame) -> tuple[int, int, int]:
    """The number of links and two sums of their hashes: equal for equal sets of links."""
    h = F.xxhash64("a", "b")
    return tuple(links.agg(F.count("*"), F.coalesce(F.sum(F.pmod(h, F.lit(2**31))), F.lit(0)), F.coalesce(F.sum(F.shiftrightunsigned(h, 33)), F.lit(0))).first())


def joined_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n rows the least row it is connected with by links of rows a and b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        for side in (a, b, label[a], label[b]):
            np.minimum.at(after, side, low)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def _hashes(nums: np.ndarray) -> np.ndarray:
    """Two 31-bit hashes of each number, as doubles: sums of up to 2^22 of them are exact."""
    x = nums.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return np.stack([x >> np.uint64(33), x & np.uint64(2**31 - 1)], axis=1).astype(np.float64)


def signatures(nums: np.ndarray, matrix: np.ndarray, side: np.ndarray, crossing: bool, least: float) -> tuple[np.ndarray, np.ndarray]:
    """For each row the number and hash sums of its similar rows, itself included where it meets itself.

    crossing: only rows of the other ``side`` count."""
    exact = units(matrix)
    single, hashes = exact.astype(np.float32), _hashes(nums)
    sums = np.zeros((len(nums), 2), np.int64)
    count = np.zeros(len(nums), np.int64)
    parts = [(np.flatnonzero(side == s), np.flatnonzero(side != s)) for s in np.unique(side)] if crossing else [(np.arange(len(nums)),) * 2]
    for mine, others in parts:
        columns, added = single[others].T, hashes[others]
        for i in range(0, len(mine), ROWS):
            rows = mine[i : i + ROWS]
            near = single[rows] @ columns
            similar = near >= least
            row, column = np.divmod(np.flatnonzero(np.abs(near - np.float32(least)) < SINGLE_SLACK), max(len(others), 1))
            if len(row):
                similar[row, column] = np.einsum("ij,ij->i", exact[rows[row]], exact[others[column]]) >= least
            count[rows] += similar.sum(1)
            sums[rows] += (similar.astype(np.float64) @ added).astype(np.int64)
    return count, sums


def within_half(matrix: np.ndarray, least: float) -> bool:
    """Whether all rows lie so near to their mean direction that each two must be similar."""
    vectors = units(matrix)
    mean = vectors.sum(0)
    length = np.sqrt(mean @ mean)
    return bool(length > 0 and np.arccos(np.clip(vectors @ mean / length, -1, 1)).max() <= np.arccos(least) / 2 - ANGLE_SLACK)


class Clusters:
    """The clusters of the current records: sets of at least ``smallest`` records, each similar (cosine >= least)
    to every other of the set and to no record outside it.

    records: ``id, vector, updated_at, ingested_at``; rows with null ids and records whose current vector is
    not usable take no part. An empty table has no clusters; exact copies are similar to each other.
    visits, reach, most: of the outer hash (cells of at most about ``most`` rows); target, tables, probes: of the inner one;
    dense: the fewest records of a part of a cell that counts. Two is the least that links anything, and needed where
    a cluster may be as small as three; more make it a coarser, density-based clustering."""

    def __init__(self, records: DataFrame, least: float = 0.85, smallest: int = 3, dimension: int = 64, visits: int = 5, reach: float = 0.08, target: int = 4_000, tables: int = 2, probes: int = 4, most: int | None = None, dense: int = 2):
        self.vectors = Vectors(records, dimension)
        self.outer = (visits, reach, most)
        self.inner = {"target": target, "tables": tables, "visits": tables + probes, "reach": reach}
        self.least, self.smallest, self.dense = least, smallest, dense

    def parts(self) -> DataFrame:
        """``(num, part, sure)``: for each visit of a cell the part of the cell the record is in, named by a number; records
        without a similar one in the cell have none. ``sure``: 0 if the part hangs together only by similarities so near to
        the bound that half precision can't tell."""
        least, strict, width, inner = self.least - HALF_SLACK, self.least + HALF_SLACK, self.vectors.dimension, self.inner

        def link(table: pa.Table) -> pa.Table:
            nums = table["num"].to_numpy()
            order = np.argsort(nums)
            nums, halves = nums[order], matrix_of(table["vec"], np.float16, width)[order].astype(np.float32)
            a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            doubtful = np.zeros(len(nums), bool)
            for rows in meetings(halves.astype(np.float64), **inner):
                label = local_groups(halves[rows], least)
                found = np.flatnonzero(label >= 0)
                a.append(rows[found])
                b.append(rows[label[found]])
                found = found[np.argsort(label[found], kind="stable")]
                for part in np.split(found, np.flatnonzero(np.diff(label[found])) + 1) if len(found) else ():
                    doubtful[rows[part]] |= not hang_together(halves[rows[part]], strict)
            row = np.unique(np.concatenate(a))
            label = joined_labels(len(nums), np.concatenate(a), np.concatenate(b))
            return pa.table({"num": nums[row], "part": nums[label[row]], "sure": (~doubtful[row]).astype(np.int8)})

        plan, stuck = self.vectors.outer(*self.outer)
        visits = self.vectors.visits(plan, lambda matrix: units(matrix).astype(np.float16))
        return in_blocks(visits, chunked(visits.sparkSession, stuck), link, "num bigint, part bigint, sure tinyint")

    def groups(self) -> DataFrame:
        """``(num, label, sure)``: connected groups of classes of equal vectors, named by a number; with those classes of several
        records that are like no other. A group all of whose rows are sure holds no link but those of similar records."""
        # a part is named by its least record: parts of several cells with one name share that record
        placed = checkpoint(self.parts())
        counted = placed.groupBy("part").agg(F.count_distinct("num").alias("n")).where(F.col("n") >= self.dense)
        placed = placed.join(counted.select("part"), "part", "left_semi")
        # adjacent parts are joined by the records they share; such joins are few
        first = checkpoint(placed.groupBy("num").agg(F.min("part").alias("low"), F.collect_set("part").alias("parts"), F.min("sure").alias("sure")))
        labels = propagate_minimum(first.select("low", F.explode("parts").alias("part")).where("low <> part").distinct().toDF("b", "a"))
        named = first.select("num", "low", "sure").join(labels.toDF("low", "label"), "low", "left").select("num", F.coalesce("label", "low").alias("label"), "sure")
        if self.vectors.copies:
            several = self.vectors.members.where("num = rep").select("num", F.col("num").alias("label"), F.lit(1).cast("tinyint").alias("sure"))
            named = named.unionByName(several.join(first.select("num"), "num", "left_anti"))
        return checkpoint(named)

    def members(self) -> DataFrame:
        """``(num, cluster)``: the members of each cluster and the number of its smallest id."""
        groups = self.groups()
        copies = self.vectors.members.groupBy(F.col("rep").alias("num")).agg(F.count("*").alias("size"))
        sized = groups.join(copies, "num", "left").withColumn("size", F.coalesce("size", F.lit(1)))
        sizes = sized.groupBy(F.col("label").alias("key")).agg(F.count("*").alias("n"), F.sum("size").alias("records"), F.min("sure").alias("sure")).where(F.col("records") >= self.smallest)
        sizes = checkpoint(sizes)
        hot = sizes.where(F.col("n") > GROUP_ROWS).select("key", "sure")
        ids = groups.join(sizes.select(F.col("key").alias("label")), "label", "left_semi").join(self.vectors.numbers, "num").select("id", F.col("label").alias("key"))
        rows = self.vectors.reps.join(ids, "id").select("key", "num", "vec")  # the vectors stay where they are
        if hot.isEmpty():
            signed = self._signed(rows, None)
        else:
            shared = broadcast_within(hot, SUM_ROWS)
            signed = self._signed(rows.join(shared, "key", "left_anti"), None).unionByName(self._large(rows.join(shared, "key")))
        signed = checkpoint(signed)
        alike = signed.groupBy("key", "n", "s", "t").agg(F.count("*").alias("alike"), F.min("num").alias("cluster")).where("alike = n")
        found = signed.join(alike.drop("alike"), ["key", "n", "s", "t"]).select("num", "cluster")
        if self.vectors.copies:
            found = found.withColumnRenamed("num", "rep").join(self.vectors.members.select("rep", "num"), "rep", "left").select(F.coalesce("num", "rep").alias("num"), "cluster")
        # copies count: a cluster may be three records of two vectors
        enough = found.groupBy("cluster").agg(F.count("*").alias("records")).where(F.col("records") >= self.smallest).select("cluster")
        return found.join(enough, "cluster", "left_semi").select("num", "cluster")

    def _signed(self, rows: DataFrame, hot: DataFrame | None) -> DataFrame:
        """``(key, num, n, s, t)``: the signature of each row of ``(key, num, vec)`` within its group."""
        least, width = self.least, self.vectors.dimension

        def sign(table: pa.Table) -> pa.Table:
            nums, chunk = table["num"].to_numpy(), table["chunk"].to_numpy()
            crossing = table["low"][0].as_py() != table["high"][0].as_py()
            matrix = matrix_of(table["vec"], width=width)
            if not crossing and within_half(matrix, least):
                count, sums = np.full(len(nums), len(nums)), np.tile(_hashes(nums).sum(0).astype(np.int64), (len(nums), 1))
            else:
                count, sums = signatures(nums, matrix, chunk, crossing, least)
            return pa.table({"key": table["key"], "num": nums, "n": count, "s": sums[:, 0], "t": sums[:, 1]})

        signed = in_blocks(rows, hot, sign, "key bigint, num bigint, n bigint, s bigint, t bigint")
        return signed if hot is None else signed.groupBy("key", "num").agg(*[F.sum(c).alias(c) for c in "nst"])

    def _large(self, rows: DataFrame) -> DataFrame:
        """``_signed`` of groups of many rows: ``(key, num, vec, sure)``.

        The angle of each row to its group's mean direction is measured. Rows whose angle and the greatest of the group
        add up to less than the bound are similar to the whole group; only the others are compared with each
        other, in chunks. A sure group, which is all that its records are linked with, is a cluster only as a whole: it is left out if a record isn't
        similar to the one farthest from the mean, so that long chains cost one pass. The number of such groups is at most
        that of the rows by GROUP_ROWS."""
        width, bound = self.vectors.dimension, float(np.arccos(self.least)) - ANGLE_SLACK
        axes = [f"x{j}" for j in range(width)]

        def add(batches):
            for batch in batches:
                vectors, (key, at) = units(matrix_of(batch.column(1), width=width)), np.unique(batch.column(0).to_numpy(), return_inverse=True)
                sums = np.zeros((len(key), width))
                np.add.at(sums, at, vectors)
                yield pa.RecordBatch.from_arrays([pa.array(key), *[pa.array(c) for c in sums.T]], names=["key", *axes])

        def measure(batches):
            for batch in batches:
                vectors, mean = units(matrix_of(batch.column(2), width=width)), units(matrix_of(batch.column(3), width=width) + 0.0)
                angle = np.arccos(np.clip(np.einsum("ij,ij->i", vectors, mean), -1, 1))
                h = _hashes(batch.column(1).to_numpy()).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(angle), pa.array(h[:, 0]), pa.array(h[:, 1])], names=["key", "num", "angle", "s", "t"])

        sums = rows.select("key", "vec").mapInArrow(add, "key bigint, " + ", ".join(f"{x} double" for x in axes)).groupBy("key").agg(*[F.sum(x).alias(x) for x in axes])
        # a mean of nothing but zeros has no direction: any will do
        zero = F.array_max(F.transform(F.array(*axes), F.abs)) == 0
        means = checkpoint(sums.select("key", F.when(zero, F.array(F.lit(1.0), *[F.lit(0.0)] * (width - 1))).otherwise(F.array(*axes)).alias("mean")))
        measured = rows.join(broadcast_within(means, SUM_ROWS), "key").select("key", "num", "vec", "mean").mapInArrow(measure, "key bigint, num bigint, angle double, s bigint, t bigint")
        measured = checkpoint(measured)
        whole = measured.groupBy("key").agg(F.count("*").alias("n"), F.sum("s").alias("all_s"), F.sum("t").alias("all_t"), F.max("angle").alias("widest"))
        whole = checkpoint(whole.join(self._refuted(rows, measured, whole), "key", "left_anti"))
        placed = measured.join(broadcast_within(whole, SUM_ROWS), "key").withColumn("inner", F.col("angle") + F.col("widest") <= bound)
        inner = placed.where("inner").select("key", "num", "n", F.col("all_s").alias("s"), F.col("all_t").alias("t"))
        outside = checkpoint(placed.where("not inner").select("key", "num", "s", "t"))
        if outside.isEmpty():
            return inner
        totals = outside.groupBy("key").agg(F.count("*").alias("out"), F.sum("s").alias("out_s"), F.sum("t").alias("out_t")).join(whole, "key")
        hot = checkpoint(totals.select("key", F.ceil(F.col("out") / GROUP_ROWS).cast("int").alias("chunks")))
        signed = self._signed(rows.join(outside.select("key", "num"), ["key", "num"], "left_semi").select("key", "num", "vec"), hot)
        plus = totals.select("key", (F.col("n") - F.col("out")).alias("dn"), (F.col("all_s") - F.col("out_s")).alias("ds"), (F.col("all_t") - F.col("out_t")).alias("dt"))
        outer = signed.join(broadcast_within(plus, SUM_ROWS), "key").select("key", "num", (F.col("n") + F.col("dn")).alias("n"), (F.col("s") + F.col("ds")).alias("s"), (F.col("t") + F.col("dt")).alias("t"))
        return inner.unionByName(outer)

    def _refuted(self, rows: DataFrame, measured: DataFrame, whole: DataFrame) -> DataFrame:
        """``(key)`` of sure groups that hold two records that aren't similar: the one farthest from the mean and another."""
        width, least = self.vectors.dimension, self.least - 1e-9

        def compare(batches):
            for batch in batches:
                vectors, far = units(matrix_of(batch.column(1), width=width)), units(matrix_of(batch.column(2), width=width))
                apart = np.einsum("ij,ij->i", vectors, far) < least
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(batch.column(0).to_numpy()[apart]))], names=["key"])

        wide = whole.where(F.col("widest") > float(np.arccos(self.least)) / 2).select("key")
        far = measured.join(wide, "key", "left_semi").groupBy("key").agg(F.max_by("num", F.struct("angle", "num")).alias("num"))
        sure = rows.where("sure = 1").select("key", "num", "vec")
        far = sure.join(broadcast_within(far, SUM_ROWS), ["key", "num"]).select("key", F.col("vec").alias("far"))
        return sure.join(broadcast_within(far, SUM_ROWS), "key").select("key", "vec", "far").mapInArrow(compare, "key bigint").distinct()

    def found(self) -> DataFrame:
        """``(id, cluster_id)``: one row per member; ``cluster_id`` is the smallest id of the cluster."""
        members = checkpoint(self.members())
        self.vectors.release()
        return self.vectors.named(members, "num", "cluster").select(F.col("num").alias("id"), F.col("cluster").alias("cluster_id"))

    def described(self, shown: int = 3) -> DataFrame:
        """``(cluster_id, size, densest_cell_size, place, member)``: each cluster's size, the number of members in its
        densest grid cell, and its ``shown`` most typical members, a row for each.

        Typical are the members closest to the cluster's mean direction (cosine, rounded to nine digits; ties by id),
        which are those of greatest mean cosine to the cluster. All members are ranked: a cell shows a few features
        only, and its members needn't be central. The grid is the cluster's own: AXES features, quantised about
        its mean in steps of two of its standard deviations. Means and deviations come from sums aggregated by
        cluster before any shuffle."""
        width, members = self.vectors.dimension, checkpoint(self.members())
        axes = min(AXES, width)
        fields = [f"s{i}" for i in range(width)] + [f"q{j}" for j in range(axes)]

        def unit(batches):
            for batch in batches:
                vectors, (key, at) = units(matrix_of(batch.column(1), width=width)), np.unique(batch.column(0).to_numpy(), return_inverse=True)
                sums = np.zeros((len(key), len(fields)))
                np.add.at(sums, at, np.concatenate([vectors, np.square(vectors[:, :axes])], axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.bincount(at)), *[pa.array(c) for c in sums.T]], names=["cluster", "n", *fields])

        def place(batches):
            for batch in batches:
                vectors, n = units(matrix_of(batch.column(2), width=width)), batch.column(3).to_numpy()[:, None]
                sums = matrix_of(batch.column(4), width=len(fields))
                mean = sums[:, :width] / n
                length = np.sqrt(np.einsum("ij,ij->i", mean, mean))
                close = np.divide(np.einsum("ij,ij->i", vectors, mean), length, out=np.zeros(len(mean)), where=length > 0)
                step = 2 * np.sqrt(np.maximum(sums[:, width:] / n - np.square(mean[:, :axes]), 0))
                # rounded, so that the order of the sums decides no border; copies have one cell
                at = np.divide(vectors[:, :axes] - mean[:, :axes], step, out=np.zeros_like(step), where=step > LEAST_STEP)
                cell = pa.array(np.floor(np.round(at + 0.5, 6)).astype(np.int64).tolist(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.rint(close * 1e9).astype(np.int64)), cell], names=["num", "cluster", "close", "cell"])

        # the vectors stay where they are; ids and sums come to them
        rows = self.vectors.rows.join(members.join(self.vectors.numbers, "num").select("id", "cluster"), "id").select("num", "cluster", "vec")
        sums = rows.select("cluster", "vec").mapInArrow(unit, "cluster bigint, n bigint, " + ", ".join(f"{f} double" for f in fields))
        sums = checkpoint(sums.groupBy("cluster").agg(F.sum("n").alias("size"), *[F.sum(f).alias(f) for f in fields]).select("cluster", "size", F.array(*fields).alias("sums")))
        placed = rows.join(broadcast_within(sums, SUM_ROWS), "cluster").select("num", "cluster", "vec", "size", "sums")
        placed = checkpoint(placed.mapInArrow(place, "num bigint, cluster bigint, close bigint, cell array<bigint>"))
        self.vectors.release()
        cells = placed.groupBy("cluster", "cell").agg(F.count("*").alias("n"))
        sizes = cells.groupBy("cluster").agg(F.sum("n").alias("size"), F.max("n").alias("densest_cell_size"))
        nth = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("close"), "num"))
        top = placed.withColumn("place", nth).where(F.col("place") <= shown).select("cluster", "num", F.col("place").cast("bigint").alias("place")).join(sizes, "cluster")
        return self.vectors.named(top, "num", "cluster").select(F.col("cluster").alias("cluster_id"), "size", "densest_cell_size", "place", F.col("num").alias("member"))
